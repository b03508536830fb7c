"""Near-duplicate documents by SetSketch registers.

A document's set is its distinct k-word shingles (fewer words: the whole sequence as one). Documents of equal sets
are one class from the start. Each class has a sketch: register i holds floor(1 - log_b of the least exponential
value that hash i gives an element), truncated to two bytes; registers of a union are the greater of two. Bands of
registers are the candidate search: documents that share a band meet in a bucket.

In a bucket all compare with its least member first, on their full sets; one pass of that settles groups of copies
of any size with one link for each member. Where members of a bucket are still in different components, its rows
are dealt into blocks: a component of many rows has blocks of its own, the others share some. Every pair of blocks
but those of one component meets in one task, first with the sketches alone: similarity is estimated from both
sketches by maximum likelihood, and rows with a near partner in another component go on. Those are dealt anew, now
with their texts, in blocks of bounded bytes, and pairs across components are confirmed there on full sets; a pair
whose components were joined meanwhile needs no link. Links are merged by passing on the least class number.

With bands of 3 of 120 registers a pair at the threshold of 0.75 shares no band with a probability of 3e-10. In
blocks it must also pass the estimate (at least 0.55) and have 45 % of registers equal; for sets of equal size the
estimate fails with a probability of about 6e-7 (fewer than 66 of 120 registers equal, each with probability 0.75),
so a pair that meets only in blocks is missed with about 6e-7 in all. Pairs with a bucket's least member skip that.

Defined cases: null texts and texts without words have an empty set, link with nothing and are kept. Every row is
judged by its own text, also where texts share an id; a component is named by the least id of its rows, and rows of
that id are kept. Rows without id link with nothing. Ids may be of any type that can be ordered. An empty table gives
no rows. Very long texts are compared whole. Columns other than id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, small, tidy
from .words import SPACED, U64, Words, grams, mix, slices, text_buffers

#: So near 1 that registers of unrelated sets are seldom equal; two bytes hold them.
BASE = 1.001
REGISTERS, ROWS = 120, 3
_OFFSET = 4096  # registers of a single element may lie below 0
_CHUNK = 1 << 19
_BLOCK = 2048
_BLOCK_BYTES = 4 << 20
_CONFIRM_BYTES = 1 << 20
_RESULTS = ("n", "s1", "s2", "sketch")
_rng = np.random.default_rng(7)
_SEEDS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_FACTORS = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) | U64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text in order, their first index by text)."""
    w = Words(data, offsets, SPACED)
    counts = w.counts()
    text = np.repeat(np.arange(len(counts)), counts)
    g = grams(w.hashes, k)
    at = np.flatnonzero(text[: len(g)] == text[k - 1 : k - 1 + len(g)])
    rows, values = [text[at]], [g[at]]
    for size in range(1, k):
        at = w.first[:-1][counts == size]
        if len(at):
            rows.append(text[at])
            values.append(grams(w.hashes, size)[at] ^ U64(size))
    row, value = np.concatenate(rows), np.concatenate(values)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    row, value = row[fresh], value[fresh]
    return value, np.searchsorted(row, np.arange(len(counts) + 1))


def _sets_by_parts(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """`shingle_sets` of a column, a few texts at a time: of the others only the sets are held."""
    values, firsts, at = [np.zeros(0, U64)], [np.zeros(1, np.int64)], 0
    for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), "text", _CHUNK):
        value, first = shingle_sets(*text_buffers(part.column(0)), k)
        values.append(value)
        firsts.append(first[1:] + at)
        at += len(value)
    return np.concatenate(values), np.concatenate(firsts)


def sketches(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Registers of sets, none of them empty: one row of bytes each."""
    out = np.empty((len(first) - 1, REGISTERS), np.uint16)
    for i in range(REGISTERS):
        h = (values ^ _SEEDS[i]) * _FACTORS[i]
        h ^= h >> U64(32)
        h *= U64(0xD6E8FEB86659FD93)
        least = np.minimum.reduceat(h, first[:-1])
        exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64 * (1 - 2.0**-53))
        out[:, i] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)) + _OFFSET, 0, 65535)
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sets, by joint likelihood of the counts of greater, smaller and equal registers."""
    more, less = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    likelihood = more * np.log(up + tiny) + less * np.log(down + tiny) + (a.shape[1] - more - less) * np.log(np.maximum(1 - up - down, tiny))
    return j[np.arange(len(j)), likelihood.argmax(axis=1)]


def _sketch_rows(k):
    def rows(batches):
        for batch in batches:
            for part in slices(batch, "text", _CHUNK):
                value, first = shingle_sets(*text_buffers(part.column(1)), k)
                n = np.diff(first)
                some = np.flatnonzero(n)
                regs = [None] * len(part)
                if len(some):
                    for row, r in zip(some, sketches(value, np.append(first[some], len(value)))):
                        regs[row] = r.tobytes()
                sums = []
                for salt in (1, 2):
                    s = np.concatenate([np.zeros(1, U64), np.cumsum(mix(value ^ U64(salt)), dtype=U64)])
                    sums.append(mix(s[first[1:]] - s[first[:-1]] + n.astype(U64)).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), pa.array(sums[0]), pa.array(sums[1]), pa.array(regs, pa.binary())], names=["id", "key", *_RESULTS])

    return rows


def _confirm(k, num, den):
    def rows(batches):
        for batch in batches:
            bytes_ = np.cumsum([0, *(pc.binary_length(batch.column("a_text")).to_numpy(zero_copy_only=False) + pc.binary_length(batch.column("b_text")).to_numpy(zero_copy_only=False))])
            start = 0
            while start < len(batch):
                stop = max(int(np.searchsorted(bytes_, bytes_[start] + _CONFIRM_BYTES, side="right")) - 1, start + 1)
                part = batch.slice(start, stop - start)
                (va, fa), (vb, fb) = (shingle_sets(*text_buffers(part.column(name)), k) for name in ("a_text", "b_text"))
                good = []
                for i in range(len(part)):
                    x, y = va[fa[i] : fa[i + 1]], vb[fb[i] : fb[i + 1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(den * both >= num * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(good)), part.column("b").filter(pa.array(good))], names=["a", "b"])
                start = stop

    return rows


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id that each end of an edge (a, b) reaches. Labels jump to their labels' labels."""
    both = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("l")))
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("l").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        stepped = labels.join(near, "a").select("a", "l", F.least("l", "m").alias("m"))
        jumped = stepped.join(labels.select(F.col("a").alias("m"), F.col("l").alias("far")), "m", "left")
        moved = cut(jumped.select("a", F.least("m", F.coalesce("far", "m")).alias("l"), (F.least("m", F.coalesce("far", "m")) < F.col("l")).alias("moved")))
        labels = moved.select("a", "l")
        done = moved.where("moved").isEmpty()
        tidy(edges.sparkSession)
        if done:
            return labels.select(F.col("a").alias("id"), F.col("l").alias("component"))


def _blocks(rows: DataFrame, size: Column | int = 0) -> tuple[DataFrame, int]:
    """Rows of (bucket, label, id) dealt for tasks: repeated for each pair of blocks (a, b) of their bucket that may hold
    rows of different labels; and a number of tasks. A block has about `_BLOCK` rows and `_BLOCK_BYTES` of `size`; `block`
    is the row's own. What else the tasks need is joined to these narrow rows afterwards.
    """
    rows = rows.withColumn("_size", F.lit(0).cast("long") if isinstance(size, int) else size.cast("long"))
    weight = F.greatest(F.count(F.lit(1)) / F.lit(_BLOCK), F.sum("_size") / F.lit(_BLOCK_BYTES))
    labels = rows.groupBy("bucket", "label").agg(weight.alias("weight"))
    pools = labels.groupBy("bucket").agg(F.ceil(F.sum(F.when(F.col("weight") <= 1, F.col("weight")).otherwise(0.0))).alias("pools"))
    labels = labels.join(pools, "bucket")
    part = lambda column, n: F.pmod(F.xxhash64(column), F.greatest(n, F.lit(1)).cast("long"))
    own = F.when(F.col("weight") > 1, F.col("label"))
    block = F.when(F.col("weight") > 1, F.concat_ws(":", F.col("label"), part("id", F.ceil("weight")))).otherwise(F.concat_ws(":", F.lit("pool"), part("label", F.col("pools"))))
    dealt = rows.join(labels, ["bucket", "label"]).withColumn("own", own).withColumn("block", block).select("bucket", "label", "id", "own", "block")
    blocks = dealt.select("bucket", "block", "own").distinct()
    other = blocks.select("bucket", F.col("block").alias("b"), F.col("own").alias("b_own"))
    apart = F.col("own").isNull() | F.col("b_own").isNull() | (F.col("own") != F.col("b_own"))
    pairs = cut(blocks.withColumnRenamed("block", "a").join(other, "bucket").where((F.col("a") <= F.col("b")) & apart).select("bucket", "a", "b"))
    sides = pairs.withColumn("block", F.col("a")).union(pairs.where("a <> b").withColumn("block", F.col("b")))
    many = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.count() // 64)
    return dealt.drop("own").join(sides, ["bucket", "block"]), many


class _Pairs:
    """The pairs of rows of a task's two blocks whose sketches come near the threshold, and whose labels differ."""

    def __init__(self, rows: pa.Table, num: int, den: int):
        self.ids, self.label, block = (rows.column(c).to_numpy() for c in ("id", "label", "block"))
        self.label = self.label.copy()
        self.n = rows.column("n").to_numpy().astype(float)
        self.regs = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        a, b = rows.column("a")[0].as_py(), rows.column("b")[0].as_py()
        self.left, self.right, self.same = np.flatnonzero(block == a), np.flatnonzero(block == b), a == b
        self.share, self.floor = num / den, num / den - 0.2

    def partners(self, x: int) -> np.ndarray:
        """Rows near row x, the nearest first."""
        y, n, regs = self.right, self.n, self.regs
        y = y[(self.label[y] != self.label[x]) & (np.minimum(n[y], n[x]) >= self.share * np.maximum(n[y], n[x]))]
        if self.same:
            y = y[self.ids[y] > self.ids[x]]
        y = y[(regs[y] == regs[x]).sum(axis=1) >= (self.floor - 0.1) * REGISTERS]
        if not len(y):
            return y
        guess = estimate(np.broadcast_to(regs[x], (len(y), REGISTERS)), regs[y], np.full(len(y), n[x]), n[y])
        return y[np.argsort(-guess)][: int((guess >= self.floor).sum())]


def _near(num: int, den: int):
    """Rows with a near partner in another component: (bucket, id), no row twice in a task."""

    def near(rows: pa.Table) -> pa.Table:
        pairs, found = _Pairs(rows, num, den), np.zeros(len(rows), bool)
        for x in pairs.left:
            y = pairs.partners(x)
            if len(y):
                found[x] = found[y] = True
        at = pa.array(np.flatnonzero(found))
        return rows.select(["bucket", "id"]).take(at)

    return near


def _links(k: int, num: int, den: int):
    """Links between the components in a pair of blocks: as many as join those that belong together, no more."""

    def links(rows: pa.Table) -> pa.Table:
        pairs = _Pairs(rows, num, den)
        ids, label = pairs.ids, pairs.label
        value, first = _sets_by_parts(rows.column("text").combine_chunks(), k)
        out = []
        for x in pairs.left:
            mine = value[first[x] : first[x + 1]]
            for z in pairs.partners(x):
                if label[z] == label[x]:
                    continue
                other = value[first[z] : first[z + 1]]
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if den * both >= num * (len(mine) + len(other) - both):
                    out.append((ids[x], ids[z]))
                    label[label == label[z]] = label[x]
        return pa.table({"a": pa.array([o[0] for o in out], pa.int64()), "b": pa.array([o[1] for o in out], pa.int64())})

    return links


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """Per row: id, n_shingles, component_id (the least id that links reach), kept (it is its component's least)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    # `key` tells apart texts that share an id
    d = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("key"))
    rows = cut(d.mapInArrow(lean(_sketch_rows(k)), f"id {kind}, key long, n long, s1 long, s2 long, sketch binary"))
    classes = rows.where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min(F.struct("id", "key")).alias("of"), F.first("sketch").alias("sketch"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", i * ROWS * 2 + 1, ROWS * 2)) for i in range(REGISTERS // ROWS)])
    spread = classes.select("id", F.explode(bands).alias("bucket"))
    pivots = cut(spread.groupBy("bucket").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    met = cut(spread.join(small(pivots.select("bucket", "pivot")), "bucket").where("id <> pivot"))

    def texts_of(ids: DataFrame) -> DataFrame:
        tidy(docs.sparkSession)
        wanted = small(cut(classes.select("id", F.col("of.id").alias("_id"), F.col("of.key").alias("key")).join(ids.distinct(), "id")))
        same = d.withColumnRenamed("id", "_id").join(wanted, ["_id", "key"])
        return cut(same.groupBy("id").agg(F.min("text").alias("text")))

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs.distinct())
        texts = texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))))
        joined = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("a_text")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b")
        return joined.mapInArrow(lean(_confirm(k, num, den)), "a long, b long")

    edges = cut(confirmed(met.select(F.col("pivot").alias("a"), F.col("id").alias("b"))))
    labels = components(edges)
    named = met.join(labels, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("label"))
    open_ = cut(named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket"))
    if not open_.isEmpty():
        left, sketch = cut(named.join(open_, "bucket")), classes.select("id", "n", "sketch")
        dealt, many = _blocks(left)
        tasks = dealt.join(sketch, "id").repartition(many, "bucket", "a", "b").groupBy("bucket", "a", "b")
        near = cut(tasks.applyInArrow(_near(num, den), "bucket long, id long").distinct())
        texts = texts_of(near.select("id"))
        left = cut(left.join(near, ["bucket", "id"]).join(texts.select("id", F.octet_length("text").alias("size")), "id"))
        dealt, many = _blocks(left, F.col("size"))
        tasks = dealt.join(sketch, "id").join(texts, "id").repartition(many, "bucket", "a", "b").groupBy("bucket", "a", "b")
        more = tasks.applyInArrow(_links(k, num, den), "a long, b long")
        labels = components(cut(edges.union(more)))
    least = classes.join(labels, "id").groupBy("component").agg(F.min("of.id").alias("least"))
    member = classes.join(labels.join(least, "component"), "id", "left").select("n", "s1", "s2", F.coalesce("least", "of.id").alias("component"))
    of = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return rows.join(member, ["n", "s1", "s2"], "left").select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), of.alias("component_id"), F.coalesce(of == F.col("id"), F.lit(True)).alias("kept")
    )
