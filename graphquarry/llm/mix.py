"""Mixing sources to target weights by hash thresholds, without sorting.

A document's size is its number of words. Sources take shares of the whole in proportion to their weights, but no
more than `most` times what they hold; what that leaves over is shared again by weight. A target of 2.4 times a
source takes every document twice and a hashed part of them, 0.4 of its words, once more.

That part is found by histograms. Every document has a 63-bit hash of id and text, and a hashed number of its own
that tells rows apart whose id and text are equal. Sizes are summed by source and by the hash's leading bits; in each
source, running sums find the bucket in which the budget ends; the next bits, at last those of the number, split only
the documents of that bucket, until it holds a single one. A document is in if its hash (and number) is below its
source's threshold. Thresholds are nested: a larger budget keeps what a smaller one took.

Defined cases: null text has size 0, and however long a text is it counts whole; null is a source of its own, last in
order; of rows with equal id and text as many are in as come nearest to the target, whichever they are; sources of
equal cap-to-weight ratios are capped together; sources without words have target 0. An empty table gives an empty
result. `mixture` reads the columns that it is told; `mixed` keeps all columns, and the names of its results get
underscores until they differ from those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, small

LEVEL_BITS = (12, 12, 12, 12, 15)
_TOP = (1 << 63) - 1
RESULTS = ("size", "source_size", "target", "copies", "taken")


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _ranked(sizes: DataFrame) -> DataFrame:
    """`sizes` with `rank`: the sources' places in order of code points, null last; sorted by ranges, not in one task."""
    spark = sizes.sparkSession
    order = [F.col("source").isNull(), F.col("source")]
    many = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = sizes.repartitionByRange(many, *order).sortWithinPartitions(*order)
    dealt = cut(dealt.withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts, before = [], 0
    for part, n in sorted(tuple(r) for r in dealt.groupBy("part").count().collect()):  # one row for each partition
        counts.append((part, before))
        before += n
    starts = F.broadcast(spark.createDataFrame(counts, "part int, before long"))
    return dealt.join(starts, "part").withColumn("rank", F.col("nth") + F.col("before")).drop("part", "nth", "before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by repeating weights, capped at most * size.

    What capped sources leave over raises the level of the others, which may cap more of them, until none is above.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    t = cut(_ranked(sizes).select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    whole, level, capped = t.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], 0.0, -1
    while True:
        above = F.lit(level) * F.col("w") >= F.col("cap")
        n, taken, free = t.agg(F.count(F.when(above, 1)), F.coalesce(F.sum(F.when(above, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("w"))), F.lit(0.0))).first()
        if n == capped or not free:
            return t.select("source", "source_size", F.least(F.col("cap"), F.lit(level) * F.col("w")).alias("target"))
        capped, level = n, (whole - taken) / free


def _hashes(doc_id: str, text: str, number: Column) -> dict[str, Column]:
    return {
        "size": word_count(F.col(text)),
        "hash": F.xxhash64(F.col(doc_id), F.col(text)).bitwiseAND(F.lit(_TOP)),
        "nth": F.xxhash64(number).bitwiseAND(F.lit(_TOP >> 1)),
    }


def _bits(word: str, start: int, count: int) -> Column:
    """`count` bits of a 63-bit number, `start` from the top."""
    return F.shiftright(word, 63 - start - count).bitwiseAND(F.lit((1 << count) - 1))


def thresholds(rows: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """Per source: source_size, target, whole (copies of every document), low_hash, low_nth; from checkpointed (source, size, hash, nth)."""
    same = F.col("source").eqNullSafe(F.col("s"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("budget", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    zero = F.lit(0).cast("long")
    plan = small(cut(plan.withColumns({"low_hash": zero, "low_nth": zero, "open": F.lit(True)})))
    inside = rows
    for word in ("hash", "nth"):
        start = 0
        for bits in LEVEL_BITS:
            histogram = inside.groupBy("source", _bits(word, start, bits).alias("bucket")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs"))
            run = Window.partitionBy("source").orderBy("bucket")
            histogram = histogram.withColumn("upto", F.sum("n").over(run)).withColumn("before", F.col("upto") - F.col("n"))
            ended = (
                histogram.join(plan.where("open").select(F.col("source").alias("s"), "budget"), same)
                .where(F.col("upto") > F.col("budget"))
                .groupBy("s")
                .agg(F.min(F.struct("bucket", "before", "n", "docs")).alias("b"))
            )
            # a bucket of one document is in if that comes nearer to the budget
            left = F.col("budget") - F.col("b.before")
            nearer = F.when((F.col("b.docs") == 1) & (left > F.col("b.n") / 2), F.lit(1)).otherwise(F.lit(0))
            low = F.col(f"low_{word}") + (F.col("b.bucket") + nearer) * F.lit(1 << (63 - start - bits))
            met, all_in = F.col("open") & F.col("b").isNotNull(), F.col("open") & F.col("b").isNull()
            moved = {
                "budget": F.when(met, left).otherwise(F.col("budget")),
                f"low_{word}": F.when(met, low).when(all_in, F.lit(_TOP)).otherwise(F.col(f"low_{word}")),
                "open": met & (F.col("b.docs") > 1),
            }
            if word == "hash":
                moved["low_nth"] = F.when(all_in, F.lit(_TOP)).otherwise(F.col("low_nth"))
            plan = small(cut(plan.join(ended, same, "left").withColumns(moved).drop("s", "b")))
            if plan.where("open").isEmpty():
                return plan
            start += bits
            ends = plan.where("open").select(F.col("source").alias("s"), "low_hash", "low_nth")
            inside = cut(inside.join(ends, same & (F.shiftright(word, 63 - start) == F.shiftright(f"low_{word}", 63 - start))).drop("s", "low_hash", "low_nth"))
    return plan


def _applied(rows: DataFrame, plan: DataFrame, most: int, keep: list[Column], names: tuple[str, ...]) -> DataFrame:
    below = (F.col("hash") < F.col("low_hash")) | ((F.col("hash") == F.col("low_hash")) & (F.col("nth") < F.col("low_nth")))
    copies = F.least(F.col("whole") + F.when(below, F.lit(1)).otherwise(F.lit(0)), F.lit(most).cast("long"))
    columns = (F.col("size"), F.col("source_size"), F.col("target"), copies, copies * F.col("size"))
    return rows.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(*keep, *[c.alias(n) for c, n in zip(columns, names)])


def mixture(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3
) -> DataFrame:
    """Per document: id, source, size, source_size, target, copies, taken (= copies * size)."""
    slim = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(source).alias("source"))
    rows = cut(slim.withColumns(_hashes("id", "text", F.monotonically_increasing_id())).drop("text"))
    return _applied(rows, thresholds(rows, weights, most), most, [F.col("id").alias(doc_id), F.col("source").alias(source)], RESULTS)


def mixed(
    docs: DataFrame, number: str, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1.0, 2.0, 3.0), most: int = 3
) -> DataFrame:
    """All columns of `docs`, then size, source_size, target, copies and taken; texts are read twice and never shuffled.

    number: a column that numbers the rows, each time alike, as in a written table.
    """
    names = tuple(free_name(docs, n) for n in RESULTS)
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), F.col(f"`{source}`").alias("source"), F.col(f"`{number}`").alias("number"))
    wide = wide.withColumns(_hashes("id", "text", F.col("number")))
    plan = thresholds(cut(wide.select("source", "size", "hash", "nth")), weights, most)
    return _applied(wide, plan, most, [F.col("row")[c].alias(c) for c in docs.columns], names)
