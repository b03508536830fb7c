import re
from collections import defaultdict

from graphquarry.llm.mix import mixed, mixture


def plain_targets(sizes, most=3):
    """Shares by weights 1, 2, 3 repeating; whoever is above the cap stops there and the rest is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped = set()
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: most * sizes[s] if s in capped else left * weight[s] / sum(weight[f] for f in free) for s in order}
        over = {s for s in free if target[s] > most * sizes[s]}
        if not over:
            return target
        capped |= over


def check(spark, docs, slack):
    got = [(r.doc_id, r.source, r["size"], r.source_size, r.target, r.taken) for r in mixture(docs).collect()]
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.collect()]
    assert sorted(map(repr, rows)) == sorted(repr(g[:3]) for g in got)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for g in got:
        sizes[g[1]] += g[2]
        taken[g[1]] += g[5]
        largest[g[1]] = max(largest[g[1]], g[2])
        assert 0 <= g[5] <= 3 * g[2] and (g[2] == 0 or g[5] % g[2] == 0)
    target = plain_targets(sizes)
    for g in got:
        assert g[3] == sizes[g[1]] and abs(g[4] - target[g[1]]) < 1e-6 * max(1, target[g[1]])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= slack * largest[s] + 1e-6
    assert sorted(map(repr, got)) == sorted(repr((r.doc_id, r.source, r["size"], r.source_size, r.target, r.taken)) for r in mixture(docs).collect())


def test_mixture_of_the_documents(spark, sf_dir):
    check(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), 1)


def test_mixture_of_odd_rows(spark):
    rows = [(i, "w " * (i % 9), "big", 0, "x") for i in range(300)] + [(900, None, "none", 0, "x"), (901, "a b", None, 0, "x"), (902, "", None, 0, "x"), (None, "a b c", "tiny", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string")
    check(spark, docs, 1)
    assert mixture(docs.limit(0)).count() == 0


def test_repeated_rows_are_split(spark):
    docs = spark.createDataFrame([(1, "a b c", "x")] * 300 + [(2, "d e", "y")] * 400, "doc_id long, text string, source string")
    check(spark, docs, 1)


def test_mixed_keeps_all_columns(spark):
    rows = [(i, "w " * (i % 9), "ab"[i % 2], 0, "x", i) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target string, _row long")
    got = mixed(docs, "_row")
    assert got.columns == [*docs.columns, "size_", "source_size", "target_", "copies", "taken"]
    assert sorted(tuple(r)[:6] for r in got.collect()) == sorted(rows)
    # ids and texts alone decide, so both forms take the same documents
    assert sorted((r.doc_id, r.copies) for r in got.collect()) == sorted((r.doc_id, r.copies) for r in mixture(docs).collect())
    assert mixed(docs.limit(0), "_row").count() == 0
