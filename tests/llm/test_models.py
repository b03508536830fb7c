import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from graphquarry.llm.chat import chosen_paths, conversations, escape, format_turns, parse_turns, unescape
from graphquarry.llm.perplexity import score
from graphquarry.llm.queries import op1_token_counts, op5_lm_scoring, op8_embedding_dedup
from graphquarry.llm.tokens import LongestMatch, _PIECES, read_ranks, token_counts
from graphquarry.llm.urls import judge
from graphquarry.llm.vectors import near_vectors


@pytest.mark.parametrize("name", ["op6_url_filter", "op9_chat_format"])
def test_sql(same_as_sql, name):
    same_as_sql(name)


def greedy(words, vocabulary):
    longest = max(map(len, vocabulary))
    total = 0
    for w in words:
        i = 0
        while i < len(w):
            i += next((n for n in range(min(longest, len(w) - i), 0, -1) if w[i : i + n] in vocabulary), 1)
            total += 1
    return total


def test_longest_match_on_small_vocabulary():
    vocabulary = [b"a", b"abcdx", b"b", b"c", b"cdy", b"dz", b"bcd"]
    rng = np.random.default_rng(1)
    words = [b"".join(rng.choice([b"a", b"b", b"c", b"d", b"x", b"y", b"z", b"\xff"], rng.integers(1, 12))) for _ in range(500)] + [b""]
    assert LongestMatch(vocabulary).counts(words).tolist() == [greedy([w], set(vocabulary)) for w in words]


def test_token_counts_equal_greedy(spark, sf_dir):
    vocabulary = set(read_ranks("/opt/tokenizers/byte_bpe_50k.tiktoken"))
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in op1_token_counts(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for r in docs:
        words = _PIECES.findall((r.text or "").encode())
        assert b"".join(words) == (r.text or "").encode()
        assert got[r.doc_id] == (len(words), greedy(words, vocabulary))
    texts = [None, "", "  \n a", "a" * 70001, "\u4e2d\u6587" * 9000, "q\u00fcx-" * 8000 + " the end", "  \n a"]
    odd = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    want = [(i, len(w), greedy(w, vocabulary)) for i, w in enumerate(_PIECES.findall((t or "").encode()) for t in texts)]
    assert sorted(map(tuple, token_counts(odd).collect())) == want
    assert token_counts(odd.limit(0)).count() == 0


def tokens(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def kneser_ney(train):
    """The bigram model by its definition, over plain dictionaries: log10 probability of a text."""
    pairs = Counter(p for t in train for p in zip(["<b>", *tokens(t)], tokens(t)))
    totals, follow, cont = Counter(), {}, Counter()
    for (u, w), c in pairs.items():
        totals[u] += c
        follow.setdefault(u, Counter())[min(c, 3)] += 1
        cont[w] += 1

    def discounts(counts):
        n = [sum(c == i for c in counts) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(min(max(d, 0.05), j - 0.05) for j, d in enumerate((1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]), 1))]

    d2, d1 = discounts(pairs.values()), discounts(cont.values())
    types = sum(cont.values())
    spare = sum(d1[min(c, 3)] for c in cont.values()) / types

    def p(u, w):
        low = max(cont[w] - d1[min(cont[w], 3)], 0) / types + spare / (len(cont) + 1)
        if not totals[u]:
            return low
        c = pairs[u, w]
        return max(c - d2[min(c, 3)], 0) / totals[u] + sum(d2[i] * n for i, n in follow[u].items()) / totals[u] * low

    return p, cont


def test_lm_scores_equal_the_definition(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    p, cont = kneser_ney(train)
    for u in ("the", "<b>", "unseen"):
        assert abs(sum(p(u, w) for w in cont) + p(u, "never seen") - 1) < 1e-9
    count = Counter(w for t in train for w in tokens(t))
    n, v = sum(count.values()), len(count)
    got = {r.doc_id: r for r in op5_lm_scoring(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        ws = tokens(t)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(u, w)) for u, w in zip(["<b>", *ws], ws)), rel_tol=1e-9)


def test_lm_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a b a", "x")], "doc_id long, text string, score string")
    assert score(docs, docs).count() == 4
    assert {r.score for r in score(docs, docs.limit(0)).collect()} == {0.0}
    assert score(docs.limit(0), docs).count() == 0


def test_lm_with_many_volumes_and_few_maps(spark, sf_dir, monkeypatch):
    from graphquarry.llm import common, perplexity

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    long = spark.createDataFrame([(-1, "very long text " * 70000)], docs.schema)  # counts beyond 16 bits too
    docs = docs.union(long)
    want = {r.doc_id: (r.n_known, r.score) for r in score(docs, docs).collect()}
    for name, value in (("SHARD_BYTES", 1 << 12), ("VOLUME_BITS", 4), ("SHARD_ROWS", 1 << 7)):
        monkeypatch.setattr(perplexity, name, value)
    monkeypatch.setattr(common, "MAPS", 3)
    assert {r.doc_id: (r.n_known, r.score) for r in score(docs, docs).collect()} == want


def test_mapped_files_are_let_go(tmp_path, monkeypatch):
    from graphquarry.llm import common

    monkeypatch.setattr(common, "MAPS", 2)
    for i in range(5):
        common.save(f"{tmp_path}/{i}.npy", np.arange(i))
    for i in (0, 1, 2, 3, 4, 0, 4):
        assert common.mapped(f"{tmp_path}/{i}.npy").tolist() == list(range(i))
        assert len(common._maps) <= 2
    assert common.mapped(f"{tmp_path}/none.npy") is None


def brute_vectors(rows, cosine=0.93):
    good = [(i, np.array(v, float), l) for i, v, l in rows if v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = Counter(), {i: i for i, _, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a, la) in enumerate(good):
        for j, b, lb in good[x + 1 :]:
            if la == lb and len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= cosine:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (links[i], find(i), find(i) == i) for i, _, _ in rows}


def vector_rows(df):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in df.collect()}


def test_vectors_equal_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert vector_rows(op8_embedding_dedup(spark, sf_dir)) == brute_vectors(rows)


def test_vectors_in_dense_groups_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr("graphquarry.llm.vectors.BLOCK", 64)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.2).tolist(), i % 2) for i in range(700)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(40)]
    rows += [(2000, None, 0), (2001, [0.0] * 16, 0), (2002, [float("nan")] * 16, 0), (2003, [None] * 16, 0), (2004, rows[0][1], None), (2005, [1.0, 0.0], 0), (2006, [2.0, 0.1], 0), (2007, [], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    assert vector_rows(near_vectors(df)) == brute_vectors(rows)
    assert near_vectors(df.limit(0)).count() == 0


def test_vectors_that_share_an_id_and_string_ids(spark):
    rows = [("5", [1.0, 0.0]), ("5", [0.0, 1.0]), ("2", [0.05, 1.0]), ("9", [1.0, 0.05]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id string, embedding array<double>, label string")
    got = sorted((r.vec_id or "", r.n_links, r.component_id or "", r.kept) for r in near_vectors(df).collect())
    assert got == [("", 0, "", True), ("2", 1, "2", True), ("5", 1, "2", False), ("5", 1, "5", True), ("9", 1, "5", False)]


def test_vectors_of_64_dimensions_with_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr("graphquarry.llm.vectors.BLOCK_BYTES", 64 * 8 * 100)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 64))
    rows = [(i, (centres[i % 60] + rng.normal(size=64) * (0.05 + 0.3 * (i % 3 == 0))).tolist(), "hot" if i % 5 else str(i % 7)) for i in range(900)]
    rows += [(2000 + i, rng.normal(size=64).tolist(), "hot") for i in range(300)] + [(3000, [1.0] * 5000, "hot"), (3001, [1.0] * 5000, "hot")]
    want = brute_vectors(rows)
    assert sum(n > 0 for n, _, _ in want.values()) > 500 and sum(n == 0 for n, _, _ in want.values()) > 300
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert vector_rows(near_vectors(df)) == want
    # the SQL twin too, as the test tables hold no links
    import duckdb

    from graphquarry.llm.queries import OP8_SQL

    embeddings = df.toArrow()  # noqa: F841  DuckDB reads it by its name
    assert {r[0]: r[1:] for r in duckdb.connect().sql(OP8_SQL).fetchall()} == want


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/x?y", "http://www.example.com/en/", "http://example.com", "x://q.net/es/1#f", "http://notexample.org/?a://b.com/", "http://enet/es/"]
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    from graphquarry.llm.queries import URL_RULES

    got = [(r.rule, r.verdict) for r in judge(df, URL_RULES).orderBy("page_id").collect()]
    none = (None, "allow")
    assert got == [none, none, none, ("example.com/en/", "block"), ("www.example.com/en/", "allow"), none, ("net/es/", "block"), none, none]
    assert judge(df, []).where("rule is not null").count() == 0
    assert judge(df.limit(0), URL_RULES).count() == 0


def test_escaping_round_trip():
    rng = np.random.default_rng(2)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "/", "s", "<", ">", "\n", "ä", "<\\s>"]
    for _ in range(500):
        texts = ["".join(rng.choice(bits, rng.integers(0, 9))) for _ in range(6)]
        turns = [(a, b) for a, b in zip(texts[:3], texts[3:])]
        formatted, _ = format_turns(turns)
        assert parse_turns(formatted) == turns
        assert all(unescape(escape(t)) == t and "</s>" not in escape(t) for t in texts)


def test_reply_trees_take_the_best_branch(spark):
    m = [("a", 1, None, 0.0), ("a", 2, 1, 1.0), ("a", 3, 1, 2.0), ("a", 4, 2, 5.0), ("a", 5, 3, 3.0), ("b", 1, 7, None), ("c", 1, 2, 0.0), ("c", 2, 1, 0.0)]
    m += [("d", i, i - 1 if i else None, 0.0) for i in range(200)]
    df = spark.createDataFrame([(*x, "user", f"t{x[1]}") for x in m], "conv string, id long, parent long, score double, role string, text string")
    paths = {}
    for r in sorted(chosen_paths(df).collect(), key=lambda r: r.depth):
        paths.setdefault(r.conv, []).append(r.id)
    assert paths == {"a": [1, 2, 4], "b": [1], "d": list(range(200))}
    two = {(r.conv, r["rank"]): r.formatted for r in conversations(df, branches=2).collect()}
    assert two["a", 2] == "<s>user\nt1</s><s>user\nt3</s><s>user\nt5</s>"
    assert conversations(df.limit(0)).count() == 0


def test_packed_bigrams_are_short_and_come_back(spark, sf_dir, tmp_path):
    import pyarrow as pa

    from graphquarry.llm import perplexity

    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    bits = 2
    packed = list(perplexity._count(bits)([pa.record_batch([pa.array(texts)], names=["text"])]))
    pairs = Counter(p for t in texts for p in zip(["<b>", *tokens(t)], tokens(t)))
    assert sum(b.nbytes for b in packed) < 13 * len(pairs)
    rows = pa.Table.from_batches(packed).sort_by("shard")
    sums = pa.Table.from_batches(list(perplexity._add_up(str(tmp_path), bits, bits)(rows.to_batches())))
    assert sum(sums["c"].to_pylist()) == sum(sums["total"].to_pylist()) == sum(pairs.values())
    keys = [np.fromfile(f"{tmp_path}/pairs-{i}.keys", np.uint64) for i in range(1 << bits)]
    assert sum(map(len, keys)) == len(pairs)
    assert sorted(perplexity._find_pairs(str(tmp_path), bits, np.sort(np.concatenate(keys))).tolist()) == sorted(pairs.values())
