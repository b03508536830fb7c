"""SQL for DuckDB that gives the rows of the queries in `testgraph`, written from their definitions."""

from __future__ import annotations

from ..functions.text import STOP_WORDS
from .testgraph import FILE, MODEL, QUANTITY, SYMBOL

_STOP = "('" + "', '".join(STOP_WORDS) + "')"

_GRAPH = f"""
functions AS (SELECT p_partkey AS key, p_name AS name, p_brand AS file, p_size % 2 = 0 AS exported, p_size % 10 = 0 AS is_test, p_type AS text, p_brand || '#' || p_type AS root FROM part),
types AS (SELECT p_type AS key, min(p_brand) AS file, length(p_type) % 2 = 0 AS exported FROM part GROUP BY p_type),
sites AS (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS dst,
    l_returnflag = 'R' AS render, l_linestatus = 'O' AS contains FROM lineitem WHERE l_quantity >= {QUANTITY}
),
calls AS (SELECT src, dst, bool_and(render) AS render, bool_and(contains) AS contains FROM sites WHERE dst IS NOT NULL AND src <> dst GROUP BY ALL),
touches AS (SELECT l_partkey AS src, l_suppkey AS dst, bool_or(l_returnflag = 'A') AS write FROM lineitem GROUP BY 1, 2),
handled AS (SELECT l_orderkey AS key, arg_min(l_partkey, (l_linenumber, l_partkey, l_suppkey)) AS handler FROM lineitem GROUP BY 1),
routes AS (SELECT o_orderkey AS key, o_orderpriority AS method, '/orders/' || o_custkey AS path, handler, o_orderstatus AS file FROM orders JOIN handled ON o_orderkey = key),
fields AS (SELECT s_name || '.' || n_name AS key, s_name AS model, n_name AS name, n_nationkey % 5 = 0 AS is_unique FROM supplier JOIN nation ON s_nationkey = n_nationkey),
files AS (SELECT DISTINCT p_brand AS path FROM part UNION ALL SELECT 'schema'),
imports AS (SELECT DISTINCT a.file AS src, b.file AS dst FROM calls JOIN functions a ON a.key = src JOIN functions b ON b.key = dst WHERE a.file <> b.file)
"""
_WITH, _RECURSIVE = f"WITH {_GRAPH}", f"WITH RECURSIVE {_GRAPH}"


def _limited(rows: str, by: str, order: str, limit: int, columns: str) -> str:
    return f"""{_WITH}, r AS ({rows}), n AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS nth, count(*) OVER (PARTITION BY {by}) > {limit} AS truncated FROM r)
    SELECT {columns}, truncated FROM n WHERE nth <= {limit}"""


def _terms(table: str, columns: str) -> str:
    """Rows (columns, nth, term) of a table with a column text: terms in order of their first place."""
    return rf"""(
      SELECT {columns}, min(nth) AS nth, term FROM (
        SELECT {columns}, generate_subscripts(ts, 1) AS nth, unnest(ts) AS term FROM (
          SELECT {columns}, list_transform(flatten(list_transform(
            list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9_\s/-]', ' ', 'g'), '[\s/_-]+'), lambda x: x <> ''),
            lambda w: list_append(string_split(trim(regexp_replace(w, '([A-Z])', ' \1', 'g')), ' '), w))), lambda x: lower(x)) AS ts FROM {table}))
      WHERE length(term) >= 3 AND term NOT IN {_STOP} GROUP BY ALL)"""


def _matches(term: str, name: str) -> str:
    without = lambda n: f"length({term}) - {n} >= 4 AND contains(lower({name}), left({term}, length({term}) - {n}))"
    endings = " OR ".join(f"(ends_with({term}, '{e}') AND {without(len(e))})" for e in ("s", "ing", "ed"))
    return f"(contains(lower({name}), {term}) OR {endings})"


_TASKS = f"""tasks AS (SELECT p_name AS task, p_name || ' ' || min(p_type) || ' nation' AS text FROM part GROUP BY 1), terms AS {_terms('tasks', 'task')}"""
_SCORES = f"""{_TASKS},
ms AS (
  SELECT task, r.key, 'type' AS kind, key AS name, file, count(*) * CASE WHEN exported THEN 4.0 ELSE 3.0 END AS score, 'interface name matches ' || string_agg(term, ', ' ORDER BY nth) AS why
  FROM terms JOIN types r ON {_matches('term', 'r.key')} GROUP BY task, r.key, file, exported
  UNION ALL SELECT task, CAST(r.key AS VARCHAR), 'route', method || ' ' || path, file, count(*) * 4.0, 'route path matches ' || string_agg(term, ', ' ORDER BY nth) FROM terms JOIN routes r ON {_matches('term', 'r.path')} GROUP BY task, r.key, method, path, file
  UNION ALL SELECT task, CAST(s_suppkey AS VARCHAR), 'model', s_name, NULL, count(*) * 3.0, 'model name matches ' || string_agg(term, ', ' ORDER BY nth) FROM terms JOIN supplier ON {_matches('term', 's_name')} GROUP BY task, s_suppkey, s_name
),
fo AS (SELECT task, key, count(*) AS n, string_agg(term, ', ' ORDER BY nth) AS hits FROM terms JOIN fields ON {_matches('term', 'name')} GROUP BY ALL),
fm AS (SELECT task, key, count(*) AS n, string_agg(term, ', ' ORDER BY nth) AS hits FROM terms JOIN fields ON {_matches('term', 'model')} GROUP BY ALL),
fs AS (
  SELECT fo.task, f.key, 'field' AS kind, f.key AS name, CAST(NULL AS VARCHAR) AS file, fo.n * 2.0 + CASE WHEN is_unique THEN fo.n * 2.0 ELSE 0 END + coalesce(fm.n * 3.0, -3.0) AS score,
    'field matches ' || fo.hits || CASE WHEN is_unique THEN ' (unique constraint)' ELSE '' END || coalesce(' on model matching ' || fm.hits, '') AS why
  FROM fo JOIN fields f USING (key) LEFT JOIN fm ON fm.task = fo.task AND fm.key = fo.key
),
fh AS (
  SELECT task, f.key, nth, term, {_matches('term', "regexp_extract(name, '[^.]*$')")} AS n, {_matches('term', 'file')} AS p, {_matches('term', 'text')} AS t, lower(regexp_extract(name, '[^.]*$')) IN (term, term || 's') AS e
  FROM terms, functions f
),
fa AS (
  SELECT task, key, count(*) FILTER (n) AS n, count(*) FILTER (p) AS p, count(*) FILTER (t) AS t, bool_or(n AND e) AS exact, bool_or(n AND p) AS both_, string_agg(term, ', ' ORDER BY nth) FILTER (n) AS nh,
    string_agg(term, ', ' ORDER BY nth) FILTER (p) AS ph, string_agg(term, ', ' ORDER BY nth) FILTER (t) AS th FROM fh GROUP BY ALL HAVING bool_or(n OR p OR t)
),
scored AS (
  FROM ms UNION ALL FROM fs
  UNION ALL SELECT task, CAST(key AS VARCHAR), 'function', name, file,
    (n * 3.0 + p + t * 2.0) * CASE WHEN exact THEN 2.5 ELSE 1 END * CASE WHEN both_ THEN 1.6 ELSE 1 END * CASE WHEN exported THEN 1.3 ELSE 1 END * CASE WHEN is_test THEN 0.5 ELSE 1 END * CASE WHEN t >= 2 THEN 1.8 ELSE 1 END,
    concat_ws('; ', 'name matches ' || nh, 'path matches ' || ph, 'says ' || th) FROM fa JOIN functions USING (key)
),
best AS (SELECT *, CAST(score AS DOUBLE) AS s, max(score) OVER (PARTITION BY task) AS top FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY s DESC, name, key) - 1 AS rank FROM best WHERE score >= greatest(2, 0.15 * top)),
anchors AS (SELECT * FROM ranked WHERE rank < 60)
"""
_MEMBERS = f"""{_SCORES},
shapes AS (
  SELECT task, a.key AS anchor, rank, name AS label, 'uses ' || name AS reason, p_partkey AS key FROM anchors a JOIN part ON p_type = a.key WHERE kind = 'type'
  UNION ALL SELECT task, a.key, rank, a.name, 'touches ' || a.name || ' — ' || why, src FROM anchors a JOIN supplier ON s_name = string_split(a.name, '.')[1] JOIN touches ON dst = s_suppkey WHERE kind IN ('model', 'field')
),
placed AS (SELECT s.*, root FROM shapes s JOIN functions f ON f.key = s.key),
wide AS (SELECT task, anchor, rank, count(DISTINCT root) AS places FROM placed GROUP BY ALL),
found AS (
  SELECT task, rank, 'anchor — ' || why AS reason, CAST(key AS BIGINT) AS key FROM anchors WHERE kind = 'function'
  UNION ALL SELECT task, rank, 'handles ' || a.name || ' — ' || why, handler FROM anchors a JOIN routes r ON CAST(r.key AS VARCHAR) = a.key WHERE kind = 'route'
  UNION ALL SELECT s.task, s.rank, reason, key FROM shapes s JOIN wide w ON w.task = s.task AND w.anchor = s.anchor AND w.rank = s.rank AND places <= 25
),
held AS (
  SELECT s.task, s.rank, 'uses ' || label AS reason, key FROM shapes s JOIN (SELECT task, arg_min(rank, (places, rank)) AS rank FROM wide WHERE places > 25 AND task NOT IN (SELECT task FROM found) GROUP BY 1) n ON n.task = s.task AND n.rank = s.rank
),
seeds AS (
  SELECT task, key, arg_min(reason, (rank, reason)) AS reason, min(rank) < 12 AS core FROM found GROUP BY ALL
  UNION ALL SELECT task, key, arg_min(reason, (rank, reason)), false FROM held GROUP BY task, key
),
step AS (
  SELECT task, dst AS key, CASE WHEN contains THEN 0 ELSE 1 END AS distance, CASE WHEN contains THEN 0 ELSE 1 END AS way, name, src AS other, CASE WHEN contains THEN 'declared inside ' ELSE 'called by ' END || name AS reason
  FROM seeds s JOIN functions f ON f.key = s.key JOIN calls ON src = s.key
  UNION ALL SELECT task, src, 1, 2, name, dst, 'calls ' || name FROM seeds s JOIN functions f ON f.key = s.key JOIN calls ON dst = s.key
),
members AS (
  SELECT task, key, 0 AS distance, reason, core FROM seeds
  UNION ALL SELECT task, key, min(distance), arg_min(reason, (distance, way, name, other, reason)), false FROM step WHERE (task, key) NOT IN (SELECT (task, key) FROM seeds) GROUP BY task, key
)
"""

_INWARD = "SELECT dst AS src, src AS dst FROM calls"


def _reach_each(depth: int, steps: str) -> str:
    return f"""{_RECURSIVE}, steps AS ({steps}),
    walk(origin, key, distance) AS (
      SELECT key, key, 0 FROM functions
      UNION SELECT w.origin, s.dst, w.distance + 1 FROM walk w JOIN steps s ON s.src = w.key WHERE w.distance < {depth}
    ) SELECT origin, key, min(distance) AS distance FROM walk GROUP BY origin, key"""


_CALLERS = f"""walk(key, level) AS (
  SELECT c.src, 1 FROM calls c JOIN functions f ON f.key = c.dst WHERE f.name = '{SYMBOL}'
  UNION SELECT c.src, level + 1 FROM walk JOIN calls c ON c.dst = walk.key WHERE level < 4
),
callers AS (SELECT key, min(level) AS level FROM walk GROUP BY key)"""
_SNAPSHOTS = """a AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_shipdate < '1996-01-01'), b AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_shipdate >= '1995-01-01'),
gone AS (FROM a EXCEPT FROM b), lost AS (SELECT DISTINCT src FROM gone)"""
_EDGES = """edges AS (
  SELECT 'CALLS' AS label, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, render, contains, CAST(NULL AS BOOLEAN) AS write FROM calls
  UNION ALL SELECT 'TOUCHES', CAST(src AS VARCHAR), CAST(dst AS VARCHAR), NULL, NULL, write FROM touches
  UNION ALL SELECT 'HANDLED_BY', CAST(key AS VARCHAR), CAST(handler AS VARCHAR), NULL, NULL, NULL FROM routes
  UNION ALL SELECT 'HAS_FIELD', CAST(s_suppkey AS VARCHAR), key, NULL, NULL, NULL FROM fields JOIN supplier ON s_name = model
  UNION ALL SELECT 'DECLARES', file, CAST(key AS VARCHAR), NULL, NULL, NULL FROM functions
  UNION ALL SELECT 'DECLARES', file, key, NULL, NULL, NULL FROM types
  UNION ALL SELECT 'DECLARES', 'schema', CAST(s_suppkey AS VARCHAR), NULL, NULL, NULL FROM supplier
  UNION ALL SELECT 'IMPORTS', src, dst, NULL, NULL, NULL FROM imports
  UNION ALL SELECT 'REFERENCES', CAST(p_partkey AS VARCHAR), p_type, NULL, NULL, NULL FROM part
)"""


def _plan(capped: bool) -> str:
    few = "(SELECT count(*) <= 60 FROM lost)" if capped else "true"
    return f"""WITH {_SNAPSHOTS} SELECT 'TOUCHES' AS label, src, dst, CASE WHEN {few} THEN 'delete' ELSE 'stale' END AS action FROM gone
    UNION ALL SELECT 'TOUCHES', src, dst, 'write' FROM b WHERE (src, dst) NOT IN (SELECT (src, dst) FROM a) OR ({few} AND (src IN (SELECT src FROM lost) OR dst IN (SELECT src FROM lost)))"""


_PROMPTS = """p AS (SELECT 'benchmark' AS source, CAST(item_id AS BIGINT) AS id, CAST(NULL AS BIGINT) AS turn, text FROM benchmark
    UNION ALL SELECT 'conversations', CAST(conv_id AS BIGINT), CAST(turn AS BIGINT), text FROM conversations WHERE role = 'user')"""
_QUOTE = "[\"''`“”‘’]"
_NOT_QUOTE = "[^\"''`“”‘’]"
_FNV = "list_reduce(list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substring({0}, i, 1)) AS UHUGEINT)), lambda h, b: CAST((CAST(xor(CAST(h AS UBIGINT), CAST(b AS UBIGINT)) AS UHUGEINT) * 1099511628211) % 18446744073709551616 AS UHUGEINT), CAST(14695981039346656037 AS UHUGEINT))"
_FOLD = "CAST(xor(CAST({0} AS UBIGINT), CAST({0} AS UBIGINT) >> 52) & 4503599627370495 AS BIGINT)"

SQL = {
    "call_edges": f"{_WITH} SELECT * FROM calls",
    "touch_edges": f"{_WITH} SELECT * FROM touches",
    "all_edges": f"{_WITH}, {_EDGES} SELECT * FROM edges",
    "label_counts": f"""{_WITH}, {_EDGES} SELECT label, count(*) AS n FROM edges GROUP BY 1 UNION ALL """
    + " UNION ALL ".join(f"SELECT '{n}', count(*) FROM {t}" for n, t in (("File", "files"), ("Function", "functions"), ("Type", "types"), ("Route", "routes"), ("Model", "supplier"), ("Field", "fields"))),
    "intact_calls": f"{_WITH} SELECT src, dst FROM calls WHERE src IN (SELECT key FROM functions WHERE exported) AND dst IN (SELECT key FROM functions WHERE exported)",
    "dropped_edges": f"""{_WITH}, e AS (SELECT key FROM functions WHERE exported), s AS (SELECT * FROM sites WHERE dst IS NOT NULL AND src <> dst)
      SELECT 'calls' AS relation, count(*) AS dropped FROM s WHERE NOT (src IN (FROM e) AND dst IN (FROM e))
      UNION ALL SELECT 'references', count(*) FROM part WHERE NOT (p_partkey IN (FROM e) AND p_type IN (SELECT key FROM types WHERE exported))
      UNION ALL SELECT 'touches', count(*) FROM lineitem WHERE l_partkey NOT IN (FROM e) OR l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
      UNION ALL SELECT 'imports', 0 UNION ALL SELECT 'routes', count(*) FROM routes WHERE handler NOT IN (FROM e)""",
    "functions_named": _limited("SELECT name, key, file FROM functions", "name", "key", 10, "name, key, file"),
    "direct_callers": _limited("SELECT dst AS key, src AS caller, name, file, render FROM calls JOIN functions f ON f.key = src", "key", "caller", 2, "key, caller, name, file, render"),
    "call_flags": f"{_WITH} SELECT src AS key, dst AS callee, name, file, render, contains FROM calls JOIN functions f ON f.key = dst",
    "routes_of_names": _limited("SELECT name, r.key AS route, method, path FROM routes r JOIN functions f ON f.key = handler", "name", "route", 40, "name, route, method, path"),
    "route_handlers": f"{_WITH} SELECT r.key AS route, f.key AS key, name, f.file AS file FROM routes r JOIN functions f ON f.key = handler",
    "touchers": _limited("SELECT s_name AS model, f.key AS key, write, name, file, root FROM touches JOIN supplier ON s_suppkey = dst JOIN functions f ON f.key = src", "model", "key", 40, "model, key, write, name, file, root"),
    "type_users": f"{_WITH} SELECT p_type AS type, key, name, file, root, false AS truncated FROM functions JOIN part ON p_partkey = key",
    "models_of_names": _limited("SELECT DISTINCT name, s_name AS model FROM touches JOIN supplier ON s_suppkey = dst JOIN functions f ON f.key = src", "name", "model", 20, "name, model"),
    "exported_surface": f"{_WITH} SELECT file AS path, key, name FROM functions WHERE exported",
    "models_declared": "SELECT 'schema' AS path, s_suppkey AS key, s_name AS name FROM supplier",
    "unique_fields": _limited("SELECT model, name FROM fields WHERE is_unique", "model", "name", 3, "model, name"),
    "data_of_files": _limited("SELECT DISTINCT file AS path, s_name AS model FROM touches JOIN supplier ON s_suppkey = dst JOIN functions f ON f.key = src", "path", "model", 50, "path, model"),
    "name_dependants": f"""{_WITH}, e AS (SELECT t.name, f.file FROM calls JOIN functions t ON t.key = dst JOIN functions f ON f.key = src)
      SELECT name, CAST(count(*) AS BIGINT) AS total, array_to_string(list_sort(list(DISTINCT file))[1:3], ',') AS files FROM e GROUP BY name""",
    "hubs": f"{_WITH} SELECT dst AS key, count(DISTINCT root) AS places FROM calls JOIN functions f ON f.key = src WHERE NOT contains GROUP BY 1 HAVING count(DISTINCT root) > 1",
    "callers": f"{_RECURSIVE}, {_CALLERS} SELECT key, name, file, level, CASE WHEN level = 1 THEN 'direct' ELSE 'indirect' END AS relation FROM callers JOIN functions USING (key)",
    "impact": f"""{_RECURSIVE}, {_CALLERS}, fn AS (SELECT * FROM functions WHERE name = '{SYMBOL}'), ty AS (SELECT * FROM types WHERE key = '{SYMBOL}')
      SELECT 'kind' AS part, CASE WHEN (SELECT count(*) FROM fn) > 0 AND (SELECT count(*) FROM ty) > 0 THEN 'both' WHEN (SELECT count(*) FROM fn) > 0 THEN 'function' WHEN (SELECT count(*) FROM ty) > 0 THEN 'type' ELSE 'unknown' END AS name, CAST(NULL AS VARCHAR) AS file, CAST(NULL AS VARCHAR) AS relation
      UNION ALL SELECT DISTINCT 'declared', NULL, file, NULL FROM (SELECT file FROM (SELECT * FROM fn ORDER BY key LIMIT 10) UNION ALL SELECT file FROM ty)
      UNION ALL SELECT 'caller', name, file, CASE WHEN level = 1 THEN 'direct' ELSE 'indirect' END FROM callers JOIN functions USING (key)
      UNION ALL SELECT 'route', method, path, NULL FROM routes WHERE handler IN (SELECT key FROM fn)
      UNION ALL SELECT 'dependant', name, file, NULL FROM functions JOIN part ON p_partkey = key WHERE p_type IN (SELECT key FROM ty)
      UNION ALL SELECT 'model', model, NULL, NULL FROM (SELECT DISTINCT s_name AS model FROM touches JOIN supplier ON s_suppkey = dst WHERE src IN (SELECT key FROM fn) ORDER BY 1 LIMIT 20)""",
    "callers_of_all": _reach_each(4, _INWARD),
    "neighbourhood_of_all": _reach_each(2, f"SELECT src, dst FROM calls UNION {_INWARD}"),
    "direct_touchers": f"{_WITH} SELECT f.key, name, file, write FROM touches JOIN functions f ON f.key = src JOIN supplier ON s_suppkey = dst WHERE s_name = '{MODEL}'",
    "route_to_model": f"""{_RECURSIVE}, walk(handler, key, n) AS (
      SELECT DISTINCT handler, handler, 0 FROM routes
      UNION SELECT w.handler, c.dst, w.n + 1 FROM walk w JOIN calls c ON c.src = w.key WHERE w.n < 4
    ) SELECT DISTINCT s_name AS model, r.key AS route, method, path, r.handler AS handler, w.key AS reacher, write FROM routes r JOIN walk w ON w.handler = r.handler AND w.n >= 1 JOIN touches t ON t.src = w.key JOIN supplier ON s_suppkey = t.dst WHERE s_name = '{MODEL}'""",
    "importers": f"""{_RECURSIVE}, walk(key, distance) AS (SELECT path, 0 FROM files WHERE path = '{FILE}' UNION SELECT i.src, distance + 1 FROM walk JOIN imports i ON i.dst = walk.key WHERE distance < 30)
      SELECT key, min(distance) AS distance FROM walk GROUP BY key""",
    "whole_paths": f"""{_RECURSIVE}, walk(path) AS (SELECT [key] FROM functions WHERE name = '{SYMBOL}' UNION ALL SELECT list_append(path, dst) FROM walk JOIN calls ON src = path[-1] WHERE len(path) <= 8 AND NOT list_contains(path, dst))
      SELECT array_to_string(list_transform(path, lambda x: CAST(x AS VARCHAR)), '>') AS path FROM walk WHERE len(path) > 1""",
    "touch_delta": f"WITH {_SNAPSHOTS} SELECT *, 'add' AS change FROM (FROM b EXCEPT FROM a) UNION ALL SELECT *, 'remove' FROM gone",
    "write_plan": _plan(False),
    "write_plan_capped": _plan(True),
    "pruned_nodes": "WITH g AS (SELECT CAST(p_partkey AS VARCHAR) AS key FROM part WHERE p_size <= 1) SELECT 'Function' AS label, key, CASE WHEN (SELECT count(*) FROM g) > 150 THEN 'skip' ELSE 'delete' END AS action FROM g",
    "changed_functions": f"{_WITH} SELECT key, name FROM functions WHERE file IN ('Brand#3', 'Brand#5')",
    "first_of_each_name": f"{_WITH} SELECT name, min(key) AS key, arg_min(file, key) AS file FROM functions GROUP BY name",
    "merged_types": "SELECT p_brand AS file, p_type AS name, bool_or(p_size % 2 = 0) AS exported, min(p_size) AS line, count(*) AS declarations FROM part GROUP BY 1, 2",
    "rarity_weights": f"""{_WITH}, {_TASKS}, names AS (SELECT regexp_extract(name, '[^.]*$') AS name FROM functions UNION ALL SELECT key FROM types UNION ALL SELECT s_name FROM supplier UNION ALL SELECT key FROM fields UNION ALL SELECT path FROM routes UNION ALL SELECT path FROM files),
      h AS (SELECT term, count(*) AS hits FROM (SELECT DISTINCT term FROM terms) JOIN names ON {_matches('term', 'name')} GROUP BY 1),
      r AS (SELECT task, term, coalesce(hits, 0) AS hits, CASE WHEN hits IS NULL THEN 0 ELSE least(1, 25.0 / hits) END AS raw FROM (SELECT DISTINCT task, term FROM terms) LEFT JOIN h USING (term))
      SELECT task, term, hits, round(CAST(CASE WHEN max(raw) OVER (PARTITION BY task) = 0 THEN 0 ELSE raw / max(raw) OVER (PARTITION BY task) END AS DOUBLE), 6) AS weight FROM r""",
    "anchor_scores": f"{_WITH}, {_SCORES} SELECT task, key, kind, name, file, round(CAST(score AS DOUBLE), 6) AS score, why FROM scored",
    "anchors": f"{_WITH}, {_SCORES} SELECT task, rank, key, kind, round(s, 6) AS score FROM anchors",
    "neighbourhood": f"{_WITH}, {_MEMBERS} SELECT * FROM members",
    "boundary_models": f"""{_WITH}, {_MEMBERS} SELECT task, s_name AS name, arg_min(name, (distance, name, m.key)) AS via, bool_or(core) AS core
      FROM members m JOIN functions f ON f.key = m.key JOIN touches ON src = m.key JOIN supplier ON s_suppkey = dst GROUP BY task, s_suppkey, s_name""",
    "nearest_member": f"{_WITH}, {_MEMBERS} SELECT task, file, arg_min(m.key, (distance, name, m.key)) AS key, min(distance) AS distance, max(distance) AS farthest FROM members m JOIN functions f ON f.key = m.key GROUP BY task, file",
    "prompt_terms": f"SELECT item_id, term FROM {_terms('benchmark', 'item_id')}",
    "all_prompt_terms": f"WITH {_PROMPTS} SELECT source, id, turn, term FROM {_terms('p', 'source, id, turn')}",
    "name_index": f"""{_WITH}, n AS (SELECT name, 'function' AS kind, file FROM functions UNION ALL SELECT method || ' ' || path, 'route', file FROM routes UNION ALL SELECT s_name, 'model', NULL FROM supplier
      UNION ALL SELECT key, 'type', file FROM types UNION ALL SELECT key, 'field', NULL FROM fields UNION ALL SELECT path, 'file', path FROM files) SELECT name, kind, file, count(*) AS n FROM n GROUP BY ALL""",
    "hash_ids": f"""WITH k AS (SELECT p_partkey, 'sf|function:' || p_brand || '#' || p_name || '.' || p_partkey AS key FROM part), h AS (SELECT *, {_FNV.format('key')} AS h, {_FNV.format('lower(key)')} AS l FROM k)
      , i AS (SELECT p_partkey, key, {_FOLD.format('h')} AS id, {_FOLD.format('l')} AS s FROM h)
      SELECT p_partkey, key, id, 'sf' AS repo, ltrim(list_reduce(list_transform(range(0, 12), lambda d: substring('0123456789abcdefghijklmnopqrstuvwxyz', CAST(s // CAST(36 ** d AS BIGINT) % 36 AS INTEGER) + 1, 1)), lambda a, x: x || a), '0') AS short FROM i""",
    "content_hashes": "SELECT doc_id, substring(base64(unhex(sha1(text))), 1, 16) AS hash FROM documents",
    "user_texts": r"""WITH l AS (SELECT doc_id, generate_subscripts(v, 1) - 1 AS line, unnest(v) AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS v FROM documents WHERE text IS NOT NULL)),
      t AS (SELECT doc_id, line, regexp_replace(value, '^\s+|\s+$', '', 'g') AS x FROM l), w AS (SELECT *, regexp_split_to_array(x, '\s+') AS ws FROM t)
      SELECT doc_id, CAST(line AS INTEGER) AS line FROM w WHERE length(x) BETWEEN 8 AND 400 AND regexp_matches(x, '\s') AND NOT regexp_matches(x, '[/{}<>|=_$\\]') AND NOT regexp_matches(x, '^(https?:|data:|\.)')
        AND length(regexp_replace(x, '[^a-zA-Z]', '', 'g')) >= 0.6 * length(x) AND len(list_filter(ws, lambda s: regexp_matches(s, '^[a-zA-Z][a-zA-Z''’.,!?-]*$'))) >= greatest(2, 0.7 * len(ws))""",
    "url_paths": r"""WITH f AS (SELECT page_id, url, 'src/app/(' || regexp_extract(url, '^([a-z]+)', 1) || ')/' || regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1) || '/route.ts' AS file FROM pages)
      SELECT page_id, regexp_replace('/' || regexp_replace(regexp_replace(regexp_replace(file, '^src/app/', ''), '/route\.ts$', ''), '/\([^)]+\)', '', 'g'), '/+', '/', 'g') AS path, regexp_matches(file, '(^|/)app/(.*/)?route\.tsx?$') AS route,
        regexp_replace(CASE WHEN starts_with(url, 'http:/') THEN substring(url, 7) ELSE url END, '^/', '') AS relative,
        array_to_string(list_append(list_filter(string_split(file, '/'), lambda x: x <> '')[:-3], 'x'), '/') AS target FROM f""",
    "prompt_features": rf"""WITH {_PROMPTS}, t AS (SELECT *, trim(text) AS x FROM p)
      SELECT source, id, turn, coalesce(x <> '' AND NOT regexp_matches(x, '(?i)^\s*(please\b|(can|could|would|will|why\s+don''?t|how\s+about)\s+(you|we|i)\b)') AND (regexp_matches(x, '(?i)^\s*(where|what|which|who|whom|whose|when|why|how)\b')
        OR regexp_matches(x, '(?i)^\s*(is|are|was|were)\s+(there|any)\b') OR (regexp_matches(x, '\?\s*$') AND NOT regexp_matches(x, '(?i)\b(add|fix|chang|updat|refactor|renam|remov|delet|implement|creat|writ|mak|mov|extract|replac|migrat|revert|wir|support|improv|clean|split|merg|introduc|build|switch)(e|es|ed|ing|s)?\b'))), false) AS question,
        coalesce(array_to_string(list_filter(list_transform(regexp_extract_all(text, '{_QUOTE}({_NOT_QUOTE}{{6,120}}){_QUOTE}', 1), lambda q: lower(trim(q))), lambda q: regexp_matches(q, '\s')), '|'), '') AS quoted,
        coalesce(array_to_string(regexp_extract_all(text, '(?:^|[\s`''"(\[])((?:[\w.@/-]*/)?[\w.-]+\.(?:tsx?|jsx?|prisma|json|css))', 1), '|'), '') AS paths FROM t""",
    "id_collisions": "SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS keys WHERE false",
}

_EVENTS = """e0 AS (
  SELECT user_id AS session, ts AS tat, event_id AS seq, CASE event_type WHEN 'signup' THEN 'open' WHEN 'click' THEN 'change' WHEN 'error' THEN 'challenge' WHEN 'purchase' THEN 'justify' ELSE 'turn' END AS kind,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, epoch_us(ts) // 1000 - CAST(floor(value * 100000) AS BIGINT) AS mtime_ms FROM events
),
e AS (SELECT *, 'f' || (k % 7) || CASE WHEN k % 5 = 0 THEN '.md' ELSE '.ts' END AS file, CAST(k % 3 AS BIGINT) AS size, k % 11 <> 0 AS exists_,
  count(*) FILTER (kind = 'open') OVER w AS task, max(epoch_us(tat) // 1000) FILTER (kind = 'open') OVER w AS started FROM e0 WINDOW w AS (PARTITION BY session ORDER BY tat, seq))"""
_EARLIER = "p.session = c.session AND p.task = c.task AND p.file = c.file AND (p.tat, p.seq) < (c.tat, c.seq)"
_OLD = "mtime_ms <= started - 2000"
SQL |= {
    "session_changes": f"""WITH {_EVENTS},
      c AS (SELECT *, EXISTS (SELECT 1 FROM e p WHERE {_EARLIER} AND p.kind IN ('challenge', 'justify')) AS settled FROM e c WHERE kind = 'change'),
      n AS (SELECT *, coalesce({_OLD}, false) AS old, ends_with(file, '.ts') AS reads, NOT settled AND exists_ AS plain FROM c),
      s AS (SELECT *, EXISTS (SELECT 1 FROM n p WHERE {_EARLIER} AND p.mtime_ms = c.mtime_ms AND p.size = c.size AND p.plain AND (p.old OR NOT p.reads)) AS known FROM n c),
      f AS (SELECT *, EXISTS (SELECT 1 FROM s p WHERE {_EARLIER} AND p.plain AND NOT p.old AND p.reads AND NOT p.known) AS had FROM s c)
      SELECT session, task, seq, file, CASE WHEN settled THEN 'forced' WHEN had THEN 'accounted' WHEN NOT exists_ THEN 'delete' WHEN old THEN 'pre-task' WHEN known THEN 'seen' WHEN NOT reads THEN 'unreadable' ELSE 'candidate' END AS found FROM f""",
    "session_marks": f"""WITH {_EVENTS}, m AS (SELECT *, kind = 'change' AND EXISTS (SELECT 1 FROM e p WHERE {_EARLIER} AND p.kind = 'challenge') AND NOT EXISTS (SELECT 1 FROM e p WHERE {_EARLIER} AND p.kind = 'justify') AS forces FROM e c WHERE task > 0)
      SELECT session, task, file, bool_or(kind = 'challenge') AS challenged, bool_or(kind = 'justify') AS justified, bool_or(kind = 'judge') AS judged, bool_or(forces) AS forced, max(mtime_ms) FILTER (kind = 'change' AND exists_) AS overlay_ms FROM m GROUP BY 1, 2, 3""",
    "unseen_changes": f"""WITH {_EVENTS} SELECT DISTINCT session, task, file, CASE WHEN exists_ THEN mtime_ms ELSE 0 END AS mtime_ms FROM e c
      WHERE kind = 'change' AND task > 0 AND (NOT exists_ OR mtime_ms > started - 2000) AND NOT EXISTS (SELECT 1 FROM e p WHERE p.session = c.session AND p.task = c.task AND p.file = c.file AND p.kind IN ('challenge', 'justify'))""",
    "prompt_actions": r"""WITH p AS (SELECT conv_id AS session, turn AS tat, left(text, 2) AS id, text, length(text) % 2 = 0 AS same FROM conversations WHERE role = 'user'),
      q AS (SELECT *, id IS NOT NULL AND row_number() OVER (PARTITION BY session, id ORDER BY tat) > 1 AS again, coalesce(trim(text) <> '' AND NOT regexp_matches(trim(text), '(?i)^\s*(please\b|(can|could|would|will|why\s+don''?t|how\s+about)\s+(you|we|i)\b)')
        AND (regexp_matches(trim(text), '(?i)^\s*(where|what|which|who|whom|whose|when|why|how)\b') OR regexp_matches(trim(text), '(?i)^\s*(is|are|was|were)\s+(there|any)\b') OR (regexp_matches(trim(text), '\?\s*$')
        AND NOT regexp_matches(trim(text), '(?i)\b(add|fix|chang|updat|refactor|renam|remov|delet|implement|creat|writ|mak|mov|extract|replac|migrat|revert|wir|support|improv|clean|split|merg|introduc|build|switch)(e|es|ed|ing|s)?\b'))), false) AS asks FROM p)
      SELECT session, tat AS turn, CASE WHEN again THEN 'duplicate' WHEN asks THEN 'question' WHEN sum(CASE WHEN again OR asks THEN 0 ELSE 1 END) OVER (PARTITION BY session ORDER BY tat) = 1 THEN 'opened' WHEN same THEN 'kept' ELSE 'redrawn' END AS action FROM q""",
    "changed_line_owners": f"""{_WITH}, l AS (SELECT DISTINCT 'Brand#' || (l_suppkey % 25 + 1) AS file, CAST(l_quantity + 1 AS INTEGER) AS line FROM lineitem)
      SELECT l.file, l.line, arg_min(p_partkey, (9, -p_size, p_partkey)) AS key FROM l LEFT JOIN part ON p_brand = l.file AND l.line BETWEEN p_size AND p_size + 9 GROUP BY ALL""",
    "boundary_recall": f"""{_WITH}, {_MEMBERS}, c AS (SELECT f.name AS task, count(*) AS changed, count(m.key) AS hit FROM functions f LEFT JOIN members m ON m.task = f.name AND m.key = f.key WHERE exported GROUP BY 1),
      r AS (SELECT c.task, hit / changed AS recall, (SELECT count(*) FROM members m WHERE m.task = c.task) / (SELECT count(*) FROM functions) AS area FROM c)
      SELECT count(*) AS cases, round(avg(recall), 6) AS recall, round(list_sort(list(area))[count(*) // 2 + 1], 6) AS median_area, round(max(area), 6) AS worst_area, count(*) FILTER (recall = 1) AS perfect,
        avg(recall) >= 0.9 AND list_sort(list(area))[count(*) // 2 + 1] < 0.05 AS passes FROM r""",
    "changed_files": """WITH a AS (SELECT DISTINCT p_brand FROM part WHERE p_brand <> 'Brand#7' AND p_size < 50), b AS (SELECT p_brand, bool_or(p_size >= 50) AS differs FROM part WHERE p_brand <> 'Brand#9' GROUP BY 1)
      SELECT coalesce(a.p_brand, b.p_brand) AS path, CASE WHEN a.p_brand IS NULL THEN 'new' WHEN b.p_brand IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM a FULL JOIN b USING (p_brand) WHERE a.p_brand IS NULL OR b.p_brand IS NULL OR differs""",
}
