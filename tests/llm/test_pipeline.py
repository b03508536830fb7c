import random
import re

from test_near import SCHEMA, brute
from test_secrets import plain_redacted

from pyspark.sql import functions as F

import corpus_pipeline
from graphquarry.llm.mix import mixed


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contaminated(text, items):
    w, hit = words(text), set()
    for item in items:
        n = min(13, len(item))
        windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        hit |= {i + k for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(n)}
    return bool(hit) and 20 * len(hit) >= len(w)


def plain(rows, items):
    """What the stages before the mixture leave; every row is judged by its own text."""
    rows = [r for r in rows if re.search(r"[^\W\d_]", r["text"] or "")]
    order = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    group = brute([(i, r["text"]) for i, r in enumerate(order)])
    rows = [r for i, r in enumerate(order) if group[i][2]]
    return [{**r, "text": plain_redacted(r["text"])} for r in rows if not contaminated(r["text"], items)]


def check(spark, tmp_path, docs, items):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    want = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in plain([r.asDict() for r in docs.collect()], [words(r.text) for r in items.collect()])], docs.schema)
    left = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted(map(repr, left.collect())) == sorted(map(repr, want.collect()))
    taken = mixed(want.withColumn("_row", F.monotonically_increasing_id()), "_row").where("copies > 0").drop("_row")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == [*docs.columns, "size", "source_size", "target", "copies", "taken"]
    assert sorted(map(repr, got.collect())) == sorted(map(repr, taken.collect()))


def test_pipeline_equals_plain_versions(spark, sf_dir, tmp_path):
    check(spark, tmp_path, *(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


def test_pipeline_of_rows_without_id_and_repeated_ids(spark, tmp_path):
    rng = random.Random(11)
    text = lambda n=30: " ".join(f"w{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(n))
    passage, copied, shared, repeated = text(20), text(), text(), text()
    ids_texts = [
        (None, passage), (None, text()), (None, text()),  # one contaminated row without id, two clean ones
        (None, copied), (None, copied), (None, shared), (4, shared), (9, shared),
        (5, repeated), (5, repeated), (5, text()), (5, passage + " " + text(4)),
        (7, text() + " token=abcdef123456"), (8, None), (8, None), (None, ""), (6, "12 34"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in ids_texts], SCHEMA)
    check(spark, tmp_path, docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))


def test_repeated_rows_without_words_stay_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, None), (1, None), (1, ""), (2, ""), (None, " "), (None, " ")], "doc_id long, text string")
    left = corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()
    assert sorted(map(repr, map(tuple, left))) == sorted(map(repr, [(1, None), (1, ""), (2, ""), (None, " ")]))


def test_stages_keep_columns_of_their_own_names_and_empty_tables(spark, tmp_path):
    extra = ("score", "lang_pred", "component_id", "contaminated", "base", "copies", "_row")
    docs = spark.createDataFrame([(1, "the cat and the dog " * 4, "en", "web", 96, *extra)], f"{SCHEMA}, " + ", ".join(f"{c} string" for c in extra))
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            left = stage(spark, table, str(tmp_path))
            assert left.columns[: len(docs.columns)] == docs.columns, name
            assert [tuple(r)[: len(docs.columns)] for r in left.collect()] == [tuple(r) for r in table.collect()], name
