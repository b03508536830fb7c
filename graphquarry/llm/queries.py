"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return identify(docs, learn=docs.where(~held)).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mix import mixture

    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .perplexity import score

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return score(docs, docs.where(~held)).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


# The rules that the query judges by.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import judge

    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import chains, conversations, digests

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], rows.schema)
    found = digests(conversations(chains(rows.union(more))))
    conv = F.when(F.col("conv") != "", F.expr("substring(conv, 2)").cast(rows.schema["conv_id"].dataType))
    return found.select(conv.alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import joined, scan

    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.expr(f"cast(size(filter(base, x -> x.kind = {kind})) as bigint)")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}'), []) AS w FROM documents),
i AS (SELECT item_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '{_ALNUM}'), []) AS w FROM benchmark),
iw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (
  SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
),
m AS (SELECT doc_id, item_id, dw.n AS n, p FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


_SECRETS = [
    ("assign", 0, """[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"""),
]
_ASSIGN_RE = "(" + _SECRETS[0][2] + """)["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _duck_spans(text: str, pattern: str, kind: str, keep: str, order: int) -> str:
    """DuckDB SQL: rows (doc_id, kind, ord, s, e, m) of a pattern's matches."""
    return f"""
      SELECT doc_id, '{kind}' AS kind, {order} AS ord, s, s + len(m) AS e, m FROM (
        SELECT doc_id, hits[i] AS m, CAST(list_sum(list_transform(gaps[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: len(x))), 0) AS BIGINT) AS s
        FROM (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i
              FROM (SELECT doc_id, regexp_extract_all({text}, '{pattern}') AS hits, regexp_split_to_array({text}, '{pattern}') AS gaps FROM documents WHERE regexp_matches({text}, '{pattern}')))
      ) WHERE {keep}"""


_DUCK_F = "list_sum(list_transform(list_distinct(win), lambda c: len(list_filter(win, lambda y: y = c)) * log2(len(list_filter(win, lambda y: y = c)))))"
OP10_SQL = f"""
WITH base AS (
  {_duck_spans('text', _ASSIGN_RE, 'assign', "len(regexp_extract(m, '^" + _ASSIGN_RE + "$', 2)) >= 6", 0)}
  UNION ALL {_duck_spans('text', 'AKIA[A-Z0-9]+', 'access', 'len(m) >= 20', 1)}
  UNION ALL {_duck_spans('text', '[0-9a-f]{24,}', 'hex', 'true', 2)}
),
cand AS (
  {_duck_spans('text', '[A-Za-z0-9+/_=-]{20,}', 'entropy', "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT regexp_matches(m, 'EXAMPLE|example|0123456789|abcdefghijkl|ABCDEFGHIJKL|placeholder|changeme')", 3)}
),
free AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)),
wins AS (
  SELECT doc_id, kind, ord, s, m, p, string_split(substring(m, p, 20), '') AS win
  FROM (SELECT *, unnest(range(1, len(m) - 18)) AS p FROM free)
),
high AS (
  SELECT doc_id, kind, ord, s, min(s + p - 1) AS s1, max(s + p + 19) AS e1 FROM wins
  WHERE log2(20) - {_DUCK_F} / 20 >= CASE WHEN regexp_full_match(m, '[0-9a-fA-F]+') THEN 2.9 ELSE 3.6 END
  GROUP BY ALL
),
spans AS (SELECT doc_id, kind, ord, s, e FROM base UNION ALL SELECT doc_id, kind, ord, s1, e1 FROM high),
named AS (SELECT doc_id, kind, ord, s, concat(kind, ':', s, ':', e) AS t FROM spans)
SELECT d.doc_id,
  (SELECT count(*) FROM named n WHERE n.doc_id = d.doc_id AND ord = 0) AS n_assign,
  (SELECT count(*) FROM named n WHERE n.doc_id = d.doc_id AND ord = 1) AS n_access,
  (SELECT count(*) FROM named n WHERE n.doc_id = d.doc_id AND ord = 2) AS n_hex,
  sha256(coalesce((SELECT string_agg(t, ',' ORDER BY s, ord) FROM named n WHERE n.doc_id = d.doc_id AND ord < 3), '')) AS base_sha256,
  coalesce((SELECT string_agg(t, ',' ORDER BY s, ord) FROM named n WHERE n.doc_id = d.doc_id), '') AS spans
FROM documents d
"""


_RULES_SQL = ", ".join(f"('{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{verdict}')" for rule, verdict in URL_RULES)
OP6_SQL = f"""
WITH rules(rh, rp, v) AS (VALUES {_RULES_SQL}),
r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(substring(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM r),
m AS (
  SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(v, length(rh || rp)) AS v
  FROM h LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m
"""

_ESCAPED = "replace(replace(replace(replace(replace(text, '\\', '\\\\'), '<s>', '<\\s>'), '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]')"
OP9_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length({_ESCAPED}) + 8) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


# links, walked from every end: groups of the test tables are small
_WALK = """
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk(id, top) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT both_ways.b, top FROM walk JOIN both_ways ON both_ways.a = walk.id),
comp AS (SELECT id, min(top) AS top FROM walk GROUP BY id)"""
OP7_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format('text')}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + least(5, len(w)) - 1), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),{_WALK}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(top, d.doc_id) AS component_id, coalesce(top, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON id = d.doc_id
"""

OP8_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
e AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND len(x.v) = len(y.v) AND x.vec_id < y.vec_id
  WHERE list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v)) / sqrt(list_dot_product(y.v, y.v)) >= 0.93
),{_WALK},
links AS (SELECT a, count(*) AS n FROM both_ways GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(top, vec_id) AS component_id, coalesce(top, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN links ON a = vec_id LEFT JOIN comp ON id = vec_id
"""


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op6_url_filter": OP6_SQL, "op9_chat_format": OP9_SQL, "op3_benchmark_decontamination": OP3_SQL, "op10_secret_scan": OP10_SQL, "op7_near_dedup": OP7_SQL, "op8_embedding_dedup": OP8_SQL}
