"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2c). Vectors are projected on leading principal directions,
put into grid cells of width eps, and sorted by label and cell. Runs of the sorted sequence form blocks. Pairs of
blocks of a label meet if their boxes, in the projection, are no further apart than eps: projections only shorten
distances, so no link is lost. In a task a pair of intervals is halved again and again, halves that are provably
apart are skipped, and small intervals are multiplied out in double precision.

Equal vectors of a label are one class from the start, numbered, counted, and not compared. The directions come from
a sample of about `sample` vectors; they decide speed only. A block is bounded in rows and in bytes.

Defined cases: vectors that are null, zero, empty, or hold null or non-finite components, and those without label,
have no links and are kept; so have rows without id. Vectors of different length are never compared, long ones fill
smaller blocks. Rows that repeat an id are judged each by its own vector; a component is named by its least id. Ids
may be of any type that can be ordered. Every row is returned; an empty table gives no rows. Columns other than id,
vector and label are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .near import components

BLOCK, LEAF = 8192, 256
BLOCK_BYTES = 4 << 20
_BLOCKS = "block long, label string, dim int, lo array<double>, hi array<double>, ids binary, copies binary, vecs binary, proj binary"


def _directions(classes: DataFrame, dims: int, sample: int) -> dict[int, np.ndarray]:
    """Principal directions for the commonest vector length; other lengths use their first coordinates."""
    count = classes.count()
    share = min(1.0, sample / max(count, 1))
    hashed = F.col("h1").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    rows = [r[0] for r in classes.where(hashed < share).select("v").collect()]
    if not rows:
        return {}
    lengths = [len(r) for r in rows]
    dim = max(set(lengths), key=lengths.count)
    m = np.array([r for r in rows if len(r) == dim], float)
    m /= np.abs(m).max(axis=1)[:, None]
    m /= np.linalg.norm(m, axis=1)[:, None]
    return {dim: np.linalg.eigh(np.cov(m.T, bias=True).reshape(dim, dim))[1][:, ::-1][:, :dims]}


def _units(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(axis=1)[:, None]  # no square may overflow
    return values / np.linalg.norm(values, axis=1)[:, None]


def _pairs(cosine, eps):
    def leaf_links(mask, a, b, root):
        """Join linked rows; labels pass along rows and columns until they rest."""
        x, y = np.arange(len(a)), np.arange(len(a), len(a) + len(b))
        big = len(a) + len(b)
        while True:
            ny = np.minimum(y, np.where(mask, x[:, None], big).min(axis=0))
            nx = np.minimum(x, np.where(mask, ny[None, :], big).min(axis=1))
            if (nx == x).all() and (ny == y).all():
                break
            x, y = nx, ny
        ids = np.concatenate([a, b])
        for one, other in zip(ids, ids[np.concatenate([x, y])]):
            if one != other:
                p, q = _top(root, one), _top(root, other)
                root[max(p, q)] = min(p, q)

    def rows(batches):
        for batch in batches:
            for r in range(len(batch)):
                get = lambda name: batch.column(name)[r].as_py()  # noqa: E731, B023
                same, dim = get("a_block") == get("b_block"), get("dim")
                side = []
                for s in "ab":
                    ids, copies = np.frombuffer(get(f"{s}_ids"), np.int64), np.frombuffer(get(f"{s}_copies"), np.int64)
                    side.append((ids, copies, _units(np.frombuffer(get(f"{s}_vecs")).reshape(-1, dim)), np.frombuffer(get(f"{s}_proj")).reshape(len(ids), -1)))
                (ia, ca, va, pa_), (ib, cb, vb, pb) = side
                links, root = (np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)), {}
                todo = [(0, len(ia), 0, len(ib))]
                while todo:
                    a0, a1, b0, b1 = todo.pop()
                    if same and b1 <= a0:
                        continue  # the mirrored interval has it
                    x, y = pa_[a0:a1], pb[b0:b1]
                    gap = np.maximum(0, np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)))
                    if gap @ gap > eps * eps:
                        continue
                    if same and (a0, a1) == (b0, b1) and a1 - a0 > LEAF:
                        m = (a0 + a1) // 2
                        todo += [(a0, m, a0, m), (a0, m, m, a1), (m, a1, m, a1)]
                        continue
                    if max(a1 - a0, b1 - b0) > LEAF:
                        if a1 - a0 >= b1 - b0:
                            m = (a0 + a1) // 2
                            todo += [(a0, m, b0, b1), (m, a1, b0, b1)]
                        else:
                            m = (b0 + b1) // 2
                            todo += [(a0, a1, b0, m), (a0, a1, m, b1)]
                        continue
                    mask = va[a0:a1] @ vb[b0:b1].T >= cosine
                    within = same and a0 == b0
                    if within:
                        np.fill_diagonal(mask, False)
                    if mask.any():
                        links[0][a0:a1] += mask @ cb[b0:b1]
                        if not within:
                            links[1][b0:b1] += mask.T @ ca[a0:a1]
                        leaf_links(mask, ia[a0:a1], ib[b0:b1], root)
                counted = links[0] if not same else links[0] + links[1]
                out = [(ia, counted)] if same else [(ia, links[0]), (ib, links[1])]
                ids, n = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
                ids, n = ids[n > 0], n[n > 0]
                tops = np.array([_top(root, i) for i in ids], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(tops, pa.int64())], names=["a", "n", "b"])

    return rows


def _top(root, i):
    while i in root and root[i] != i:
        i = root[i]
    return i


def near_vectors(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = 0.93, dims: int = 4, sample: int = 4096
) -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    v = F.col("v")
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).cast("array<double>").alias("v"), F.col(label).cast("string").alias("label"))
    # two hashes name label and vector; rows that link with nothing have the first alone, spread by their ids
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("h1", F.when(F.col("good"), F.xxhash64("label", "v")).otherwise(F.xxhash64("id"))).withColumn("h2", F.when(F.col("good"), F.xxhash64(F.lit(1), "v", "label")))
    rows = cut(rows.select("id", "h1", "h2", "label", F.when(F.col("good"), v).alias("v")))
    classes = rows.where("h2 is not null").groupBy("h1", "h2").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    eps = math.sqrt(2 - 2 * cosine) + 1e-6
    shared = vectors.sparkSession.sparkContext.broadcast(_directions(classes, dims, sample))

    def place(batches):
        for batch in batches:
            lists = batch.column("v")
            values, first = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            sizes = np.diff(first)
            p, raw = np.zeros((len(batch), dims)), [b""] * len(batch)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                m = values[first[:-1][at][:, None] + np.arange(size)]
                way, unit = shared.value.get(int(size)), _units(m)
                p[at, : min(dims, size)] = unit @ way if way is not None else unit[:, :dims]
                for i, x in zip(at, m):
                    raw[i] = x.tobytes()
            cells = np.floor(p / eps).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("copies"), batch.column("label"), pa.array(sizes.astype(np.int32)), pa.array(raw, pa.binary()), pa.array([x.tobytes() for x in p], pa.binary()), pa.array(list(cells), pa.list_(pa.int32()))],
                names=["id", "copies", "label", "dim", "vec", "proj", "cell"],
            )

    order = ["label", "dim", "cell", "id"]
    placed = classes.select("id", "copies", "label", "v").mapInArrow(place, "id long, copies long, label string, dim int, vec binary, proj binary, cell array<int>").repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches):
        number = TaskContext.get().partitionId() << 33
        held, key = [], None

        def block():
            nonlocal number
            p = np.frombuffer(b"".join(h[5] for h in held)).reshape(-1, dims)
            number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in (number, held[0][2])]
                + [pa.array([held[0][3]], pa.int32()), pa.array([p.min(axis=0).tolist()]), pa.array([p.max(axis=0).tolist()])]
                + [pa.array([x], pa.binary()) for x in (np.array([h[0] for h in held], np.int64).tobytes(), np.array([h[1] for h in held], np.int64).tobytes(), b"".join(h[4] for h in held), p.tobytes())],
                names=["block", "label", "dim", "lo", "hi", "ids", "copies", "vecs", "proj"],
            )

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("id", "copies", "label", "dim", "vec", "proj"))):
                if held and (len(held) >= min(BLOCK, max(BLOCK_BYTES // (8 * r[3]), 1)) or key != (r[2], r[3])):
                    yield block()
                    held = []
                key = (r[2], r[3])
                held.append(r)
        if held:
            yield block()

    blocks = cut(placed.mapInArrow(pack, _BLOCKS))
    # blocks meet by the cells of the first direction that their boxes touch
    cell = lambda c: F.floor(F.get(c, F.lit(0)) / eps)
    meta = blocks.select("block", "label", "dim", "lo", "hi")
    a = meta.select(F.col("block").alias("a_block"), "label", "dim", F.col("lo").alias("a_lo"), F.col("hi").alias("a_hi"), F.explode(F.sequence(cell("lo") - 1, cell("hi") + 1)).alias("at"))
    b = meta.select(F.col("block").alias("b_block"), "label", "dim", F.col("lo").alias("b_lo"), F.col("hi").alias("b_hi"), F.explode(F.sequence(cell("lo"), cell("hi"))).alias("at"))
    gap = F.expr("aggregate(sequence(0, size(a_lo) - 1), 0D, (s, i) -> s + pow(greatest(0D, get(a_lo, i) - get(b_hi, i), get(b_lo, i) - get(a_hi, i)), 2))")
    pairs = cut(a.join(b, ["label", "dim", "at"]).where((F.col("a_block") <= F.col("b_block")) & (gap <= eps * eps)).select("a_block", "b_block").distinct())
    data = ("ids", "copies", "vecs", "proj")
    one = blocks.select(F.col("block").alias("a_block"), "dim", *[F.col(c).alias(f"a_{c}") for c in data])
    two = blocks.select(F.col("block").alias("b_block"), *[F.col(c).alias(f"b_{c}") for c in data])
    many = max(8, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = pairs.join(one, "a_block").join(two, "b_block").repartition(many, "a_block", "b_block")
    found = cut(met.mapInArrow(_pairs(cosine, eps), "a long, n long, b long"))
    labels = components(found)
    links = found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    numbered = classes.select("id", "h1", "h2", "copies", "least")
    named = numbered.join(labels, "id")
    named = named.select("id", "component").join(named.groupBy("component").agg(F.min("least").alias("top")), "component").select("id", "top")
    classed = numbered.join(links, "id", "left").join(named, "id", "left")
    classed = classed.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("top", "least").alias("component"))
    return rows.select("id", "h1", "h2").join(classed, ["h1", "h2"], "left").select(
        F.col("id").alias(vec_id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept")
    )
