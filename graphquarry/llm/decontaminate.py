"""Benchmark decontamination by winnowing.

Both sides are cut into words. In each run of consecutive k-word hashes the least is kept as a fingerprint
(the last of equals). With k-word hashes and runs of `span - k + 1` of them, two texts that share `span` words
share a fingerprint at the same place of that passage, whatever surrounds it. Fingerprints are joined, each hit
is extended word by word, and extensions that cover a whole benchmark window count.

Items shorter than `span` words are one window of their own length; for each such length the documents' hashes
of exactly that many words are looked up, so short items are found as surely as long ones.

Defined cases: null and empty texts have no words, no hits, and are not contaminated. An item without words has
no window. Items with a null id are not named. Rows that repeat an id and a text give equal rows, one for each; rows
of one id and different texts, and rows without id, are judged each by its own text. Ids are whole numbers. Very long
texts are read whole. Other columns of either table are ignored, whatever their names. An empty benchmark hits
nothing; an empty table of documents gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, small
from .words import ALNUM, U64, Words, grams, mix, slices, text_buffers

_CHUNK = 4 << 20
_MAP_BITS = 1 << 22
_PART_BITS = 1 << 15  # of a bitmap that Spark builds
_SIDE = "id long, n_words long, text_key long, base boolean, at int, size int, fp long, left array<long>, right array<long>"
_ARROW = pa.schema(
    [("id", pa.int64()), ("n_words", pa.int64()), ("text_key", pa.int64()), ("base", pa.bool_()), ("at", pa.int32()), ("size", pa.int32()), ("fp", pa.int64()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64()))]
)


def winnow(hashes: np.ndarray, first: np.ndarray, k: int, run: int) -> np.ndarray:
    """Positions of the winnowed k-word hashes of texts that begin at word numbers `first`."""
    g = grams(hashes, k)
    if not len(g):
        return np.zeros(0, np.int64)
    n = len(g) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, where = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, run):
        later = g[j : j + n]
        take = later <= least
        least = np.where(take, later, least)
        where[take] = j
    # a run that would cross from one text into the next is no run
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = text[:n] == text[run + k - 2 : run + k - 2 + n]
    return np.unique((np.arange(n) + where)[inside])


def _fingerprints(hashes, first, span, k, lengths, whole_only):
    """(position, words, fingerprint) of the winnowed k-word hashes, then of every run of one of `lengths` words.

    whole_only: such runs count only where they are a text's all words.
    """
    counts = np.diff(first)
    at = winnow(hashes, first, k, span - k + 1)
    found = [(at, np.zeros(len(at), np.int32), grams(hashes, k)[at] if len(at) else np.zeros(0, U64))]
    text = np.repeat(np.arange(len(counts)), counts)
    for size in lengths:
        g = grams(hashes, size)
        if whole_only:
            at = first[:-1][counts == size]
        else:
            at = np.flatnonzero(text[: len(g)] == text[size - 1 : size - 1 + len(g)])
        found.append((at, np.full(len(at), size, np.int32), g[at]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _text_keys(w: Words, offsets: np.ndarray) -> np.ndarray:
    """A hash of each text's words and length, to tell apart texts that share an id."""
    counts, first = w.counts(), w.first
    placed = mix(w.hashes + np.arange(len(w.hashes), dtype=U64) - np.repeat(first[:-1], counts).astype(U64))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(placed, dtype=U64)])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(offsets).astype(U64))


def _sides(batch: pa.RecordBatch, k: int, span: int, lengths, item_side: bool, bitmap: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """A base row for each text, then a row for each fingerprint, with the words' hashes around it."""
    reach = span - k
    for part in slices(batch, "text", _CHUNK):
        data, offsets = text_buffers(part.column(1))
        w = Words(data, offsets, ALNUM)
        counts, hashes, first, m = w.counts(), w.hashes, w.first, len(part)
        at, size, fp = _fingerprints(hashes, first, span, k, lengths, item_side)
        if bitmap is not None:
            keep = np.flatnonzero(bitmap[(fp & U64(_MAP_BITS - 1)).astype(np.int64)])
            at, size, fp = at[keep], size[keep], fp[keep]
        row = np.searchsorted(first, at, side="right") - 1
        signed = hashes.view(np.int64)
        none = signed[:0]
        left = [none if s else signed[max(a, p - reach) : p][::-1] for a, p, s in zip(first[row], at, size)]
        right = [none if s else signed[p + k : min(b, p + k + reach)] for b, p, s in zip(first[row + 1], at, size)]
        keys = _text_keys(w, offsets)
        # base rows get fingerprints of their own that spread them over the join's partitions and match nothing
        spread = mix(keys + np.arange(m, dtype=U64))
        every = np.concatenate([np.arange(m), row]).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                part.column(0).take(pa.array(every)),
                pa.array(counts[every]),
                pa.array(keys.view(np.int64)[every]),
                pa.array(np.arange(len(every)) < m),
                pa.array(np.concatenate([np.zeros(m, np.int64), at - first[row]]).astype(np.int32)),
                pa.array(np.concatenate([np.zeros(m, np.int32), size])),
                pa.array(np.concatenate([spread, fp]).view(np.int64)),
                pa.array([none] * m + left, pa.list_(pa.int64())),
                pa.array([none] * m + right, pa.list_(pa.int64())),
            ],
            schema=_ARROW,
        )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans in order, those that overlap or touch as one, and the number of words in them."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        out, hits = [], []
        for spans in batch.column("spans").to_pylist():
            merged: list[dict[str, int]] = []
            for s in sorted(spans, key=lambda s: s["start"]):
                if merged and merged[-1]["end"] >= s["start"]:
                    merged[-1]["end"] = max(merged[-1]["end"], s["end"])
                else:
                    merged.append(s)
            out.append(merged)
            hits.append(sum(s["end"] - s["start"] for s in merged))
        columns = {name: batch.column(name) for name in batch.schema.names} | {"spans": pa.array(out, kind), "n_hit": pa.array(hits, pa.int64())}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def contamination(
    docs: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = 13,
    k: int = 5,
    share: int = 20,
) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, item_ids (sorted as strings), spans (word ranges hit), contaminated.

    contaminated: n_hit > 0 and share * n_hit >= n_words.
    """
    if not 1 <= k <= span:
        raise ValueError("k must be between 1 and span")
    spark = docs.sparkSession
    item_side = cut(
        items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"))
        .mapInArrow(lambda batches: (out for b in batches for out in _sides(b, k, span, range(1, span), True, None)), _SIDE)
        .where("not base")
        .select("size", "fp", F.col("id").alias("item"), F.col("left").alias("i_left"), F.col("right").alias("i_right"))
        .distinct()
    )
    short = tuple(sorted(r[0] for r in item_side.where("size > 0").select("size").distinct().collect()))
    # one bit for each fingerprint modulo a fixed number, set in the JVM: half a megabyte whatever the size of the benchmark
    place = F.col("fp").bitwiseAND(F.lit(_MAP_BITS - 1)) + 1
    parts = item_side.groupBy(F.bitmap_bucket_number(place).alias("nth")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    packed = np.zeros((_MAP_BITS // _PART_BITS, _PART_BITS // 8), np.uint8)
    for nth, bits in parts:
        packed[nth - 1] = np.frombuffer(bits, np.uint8)
    shared = spark.sparkContext.broadcast(packed.ravel())

    def doc_rows(batches):
        bitmap = np.unpackbits(shared.value, bitorder="little").astype(bool)
        for batch in batches:
            yield from _sides(batch, k, span, short, False, bitmap)

    d = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(lean(doc_rows), _SIDE)
    b = small(item_side.select(F.lit(False).alias("base"), "*"), 20_000)
    prefix = lambda x, y: F.expr(  # noqa: E731  length of the common prefix
        f"array_position(transform(sequence(0, least(size({x}), size({y}))), i -> i = least(size({x}), size({y})) or get({x}, i) <> get({y}, i)), true) - 1"
    )
    joined = d.join(b, ["base", "fp", "size"], "left").withColumn("l", prefix("left", "i_left")).withColumn("r", prefix("right", "i_right"))
    whole = F.col("i_left").isNotNull() & ((F.col("size") > 0) | (F.col("l") + F.lit(k) + F.col("r") >= span))
    start = F.when(F.col("size") > 0, F.col("at")).otherwise(F.col("at") - F.col("l"))
    end = F.when(F.col("size") > 0, F.col("at") + F.col("size")).otherwise(F.col("at") + F.lit(k) + F.col("r"))
    found = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    kind = "id long, n_words long, copies long, spans array<struct<start:int,end:int>>, item_ids array<string>"
    grouped = joined.groupBy("id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.sum(F.col("base").cast("int")).alias("copies"),
        F.collect_set(F.when(whole, found)).alias("spans"),
        F.array_sort(F.collect_set(F.when(whole, F.col("item").cast("string")))).alias("item_ids"),
    )
    return (
        grouped.select("id", "n_words", "copies", "spans", "item_ids")
        .mapInArrow(lean(_merged), f"{kind}, n_hit long")
        .withColumn("n_items", F.size("item_ids").cast("long"))
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words")))
        .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(F.col("id").alias(doc_id), "n_words", "n_hit", "n_items", "item_ids", "spans", "contaminated")
    )
