"""Language-model scores: an interpolated modified Kneser-Ney bigram model, counted in Spark.

Tokens are words, then one end; a begin mark stands before each text. Workers count bigrams of whole texts and send
them on by leading bits of the bigram's hash, packed by shard, so that no word or bigram, however common, makes a
shard large; the number of shards follows the size of the text. Neighbouring shards form a volume, which one task
gets: it adds up one shard after the other, appends them to the volume's sorted array of 64-bit hashes in the shared
folder, and passes on the words' and contexts' sums, which Spark adds up and writes likewise. There are never more
than some thousands of volumes. Scoring workers memory-map volumes, the last used ones only, and look words up by
binary search, one volume after the other. Nothing but a dozen totals reaches the driver. A task that runs again
writes the same files again.

Defined cases: null text is empty and scores its end token; texts that were not learned from are scored alike; if
nothing was learned, all words are unknown and every token scores log10(1). Rows are scored one by one, so repeats
stay; very long texts are learned and scored whole; an empty table gives no rows. Columns other than id and text are
ignored.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped, mapped_folder, save, tidy
from .words import SPACED, U64, Words, mix, slices, text_buffers

BEGIN, END = U64(0x0123456789ABCDEF), U64(0xFEDCBA9876543210)
SHARD_ROWS = 1 << 21
SHARD_BYTES = 12 << 20
VOLUME_BITS = 13  # at most
_WIDE = (1 << 8) - 1  # counts from here on stand in a list of their own
_HELD = 1 << 21
_CHUNK = 2 << 20
_SENT = 8 << 20  # bytes of packed shards that leave a worker at once
_WORDS = ("hash", "c", "cont", "total", "n1", "n2", "n3")
#: What a shard of bigrams passes on: the saved columns, and how many of a context's bigrams have count 3 and 4.
_SUMS = (*_WORDS, "x3", "x4")


def _tokens(data, offsets):
    """(previous tokens, tokens, first token of each text): words and an end each."""
    w = Words(data, offsets, SPACED)
    counts = w.counts() + 1
    first = np.concatenate([[0], np.cumsum(counts)])
    token = np.empty(first[-1], U64)
    ends = first[1:] - 1
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner], token[ends] = w.hashes, END
    previous = np.empty_like(token)
    previous[1:] = token[:-1]
    previous[first[:-1]] = BEGIN
    return previous, token, first


_CONTEXT = U64(0xD6E8FEB86659FD93)


def _pair(previous, token):
    """Hashes of bigrams; with the context's hash, the token's can be had back."""
    return previous * _CONTEXT + token


def _token(key, previous):
    return key - previous * _CONTEXT


def _merge(held):
    """One (keys, contexts, counts) of many, which are let go; keys sorted, each once."""
    columns = [list(x) for x in zip(*held)]
    held.clear()
    key, previous, n = (np.concatenate(columns.pop(0)) for _ in range(3))
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[starts], previous[order][starts], np.add.reduceat(n[order], starts)


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type that holds them."""
    return values.astype(np.min_scalar_type(int(values.max())))


def _squeezed(keys: np.ndarray) -> tuple[bytes, int]:
    """Sorted keys as differences in as few bytes each as the largest needs."""
    gaps = np.diff(keys, prepend=U64(0))
    width = max(1, -(-int(gaps.max()).bit_length() // 8))
    return gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes(), width


def _unsqueezed(data: bytes, width: int) -> np.ndarray:
    narrow = np.frombuffer(data, np.uint8).reshape(-1, width)
    gaps = np.zeros((len(narrow), 8), np.uint8)
    gaps[:, :width] = narrow
    return np.cumsum(gaps.view(U64).ravel(), dtype=U64)


def _packed(held, bits: int):
    """A row for each shard, some at a time: the distinct contexts and tokens, how many bigrams each context has, and of each bigram the token and count."""
    key, previous, n = _merge(held)
    shard = (key >> U64(64 - bits)).astype(np.int32) if bits else np.zeros(len(key), np.int32)
    starts = np.flatnonzero(np.diff(shard, prepend=-1))
    rows, size = [], 0
    send = lambda: pa.RecordBatch.from_pylist([dict(zip(_PACK.names, r)) for r in rows], schema=_PACK)
    for a, b in zip(starts, [*starts[1:], len(key)]):
        contexts, of = np.unique(previous[a:b], return_inverse=True)
        tokens, which = np.unique(_token(key[a:b], previous[a:b]), return_inverse=True)
        order = np.argsort(of, kind="stable")
        row = [int(shard[a]), *_squeezed(contexts), *_squeezed(tokens)]
        for values in map(_narrow, (np.bincount(of), which[order], n[a:b][order])):
            row += values.tobytes(), values.itemsize
        rows.append(row)
        size += 16 * int(b - a)
        if size >= _SENT:
            yield send()
            rows, size = [], 0
    if rows:
        yield send()


_FIELDS = ("contexts", "tokens", "runs", "which", "n")
_PACK = pa.schema([("shard", pa.int32()), *[x for f in _FIELDS for x in ((f, pa.binary()), (f"{f}_width", pa.int32()))]])
_PACKED = "shard int, " + ", ".join(f"{f} binary, {f}_width int" for f in _FIELDS)


def _count(bits: int):
    def rows(batches):
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", _CHUNK):
                previous, token, _ = _tokens(*text_buffers(part.column(0)))
                key, at, n = np.unique(_pair(previous, token), return_index=True, return_counts=True)
                held.append((key, previous[at], n.astype(np.int32)))
                size += len(key)
                if size >= _HELD:
                    yield from _packed(held, bits)
                    held, size = [], 0
        if size:
            yield from _packed(held, bits)

    return rows


class _Volume:
    """Files of sorted keys and their counts, to which shards are appended; readers see them when all are written."""

    def __init__(self, folder: str, number: int):
        self.path, self.mark, self.rows = f"{folder}/pairs-{number}", uuid.uuid4().hex, 0
        self.files = {kind: open(f"{self.path}.{kind}.{self.mark}", "wb") for kind in ("keys", "counts")}
        self.wide: list[tuple[np.ndarray, np.ndarray]] = []

    def append(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.files["keys"].write(keys.tobytes())
        self.files["counts"].write(np.minimum(counts, _WIDE).astype(np.uint8).tobytes())
        at = np.flatnonzero(counts >= _WIDE)
        self.wide.append((at + self.rows, counts[at]))
        self.rows += len(keys)

    def close(self) -> None:
        save(f"{self.path}.wide.npy", np.array([np.concatenate(x) for x in zip(*self.wide)], np.int64))
        for kind, file in self.files.items():
            file.close()
            os.replace(file.name, f"{self.path}.{kind}")


def _add_up(folder: str, bits: int, volume_bits: int):
    """From packed rows in order of shard: write each volume, and pass on the sums of its words and contexts, shard by shard."""

    def sums(key, previous, n):
        for of, masks in (
            (_token(key, previous), {"c": n, "cont": np.ones_like(n)}),
            (previous, {"total": n, "n1": n == 1, "n2": n == 2, "n3": n >= 3, "x3": n == 3, "x4": n == 4}),
        ):
            order = np.argsort(of, kind="stable")
            of = of[order]
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            found = {name: np.add.reduceat(m[order].astype(np.int64), starts) for name, m in masks.items()}
            none = np.zeros(len(starts), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(of[starts].view(np.int64)), *[pa.array(found.get(x, none)) for x in _SUMS[1:]]], names=_SUMS)

    def rows(batches):
        held, size, at, volume = [], 0, None, None

        def finish():
            key, previous, n = _merge(held)
            volume.append(key, n)
            yield from sums(key, previous, n)

        for batch in batches:
            for r in range(len(batch)):
                get = lambda name: batch.column(name)[r].as_py()  # noqa: E731, B023
                shard = get("shard")
                if shard != at:
                    if held:
                        yield from finish()
                        held, size = [], 0
                    if volume is None or shard >> (bits - volume_bits) != at >> (bits - volume_bits):
                        if volume is not None:
                            volume.close()
                        volume = _Volume(folder, shard >> (bits - volume_bits))
                    at = shard
                contexts, tokens = (_unsqueezed(get(x), get(f"{x}_width")) for x in _FIELDS[:2])
                runs, which, n = (np.frombuffer(get(x), f"u{get(f'{x}_width')}") for x in _FIELDS[2:])
                previous = np.repeat(contexts, runs)
                keys = _pair(previous, tokens[which])
                held.append((keys, previous, n.astype(np.int64)))
                size += len(keys)
                if size > _HELD:
                    held = [_merge(held)]
                    size = len(held[0][0]) // 2
        if held:
            yield from finish()
            volume.close()

    return rows


def _write(df: DataFrame, key: str, names, folder: str, table: str, rows: int) -> int:
    """Write sorted shards of a table, keys and all other columns side by side; the number of leading bits that name a shard."""
    bits = min(max(0, (rows // SHARD_ROWS).bit_length()), VOLUME_BITS)
    shard = F.shiftrightunsigned(F.col(key), 64 - bits).cast("int") if bits else F.lit(0)

    def put(part: pa.Table) -> pa.Table:
        number = part.column("_shard")[0].as_py()
        keys = part.column(key).to_numpy().view(U64)
        order = np.argsort(keys)
        columns = [_narrow(part.column(name).to_numpy()[order]) for name in names if name != key]
        save(f"{folder}/{table}-{number}.keys.npy", keys[order])
        save(f"{folder}/{table}-{number}.npy", np.rec.fromarrays(columns))
        return pa.table({"shard": pa.array([number], pa.int32())})

    df.withColumn("_shard", shard).groupBy("_shard").applyInArrow(put, "shard int").count()
    return bits


def _runs(wanted: np.ndarray, bits: int):
    """(number, from, to) of the parts of sorted keys that share their leading bits."""
    numbers = (wanted >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(wanted), np.int64)
    starts = np.flatnonzero(np.diff(numbers, prepend=-1))
    return zip(numbers[starts], starts, [*starts[1:], len(wanted)])


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of the wanted are among sorted keys, the places of those)."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, at[hit]


def _find_words(folder: str, bits: int, wanted: np.ndarray) -> list[np.ndarray]:
    """The words' columns by sorted hashes; zero where a word is missing."""
    out = [np.zeros(len(wanted), np.int64) for _ in _WORDS[1:]]
    for number, a, b in _runs(wanted, bits):
        keys = mapped(f"{folder}/words-{number}.keys.npy")
        if keys is not None:
            hit, at = _at(keys, wanted[a:b])
            found = mapped(f"{folder}/words-{number}.npy")[at]
            for o, name in zip(out, found.dtype.names):
                o[a:b][hit] = found[name]
    return out


def _find_pairs(folder: str, bits: int, wanted: np.ndarray) -> np.ndarray:
    """Counts of bigrams by sorted hashes; zero where one is missing."""
    out = np.zeros(len(wanted), np.int64)
    for number, a, b in _runs(wanted, bits):
        keys = mapped(f"{folder}/pairs-{number}.keys", U64)
        if keys is not None:
            hit, at = _at(keys, wanted[a:b])
            found = mapped(f"{folder}/pairs-{number}.counts", np.uint8)[at].astype(np.int64)
            wide = np.flatnonzero(found == _WIDE)
            if len(wide):
                places, counts = mapped(f"{folder}/pairs-{number}.wide.npy")
                found[wide] = counts[np.searchsorted(places, at[wide])]
            out[a:b][hit] = found
    return out


def _discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 0, 1, 2 and 3 or more, from the numbers of counts 1 to 4."""
    n1, n2, n3, n4 = (max(x, 0) for x in n)
    if not n1 or not n2 or not n3:
        return [0.0, 0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    return [0.0, *(min(max(d, 0.05), j - 0.05) for j, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))]


def _of_counts(df: DataFrame, c: str):
    return df.agg(*[F.count(F.when(F.col(c) == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count(F.when(F.col(c) >= 3, 1)).alias("more"), F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(c), F.lit(0)).alias("sum")).first()


def score(docs: DataFrame, learn: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: id, n_tokens, n_known, train_tokens, base_score, score (log10), perplexity."""
    spark = docs.sparkSession
    folder = mapped_folder(spark, "ngrams")
    size = learn.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    bits = (size // SHARD_BYTES).bit_length()
    volume_bits = min(bits, VOLUME_BITS)  # a volume is one shard until there are thousands
    packed = learn.select(F.col(text).alias("text")).mapInArrow(_count(bits), _PACKED)
    dealt = packed.withColumn("volume", F.shiftright("shard", bits - volume_bits)).repartition(2 << volume_bits, "volume").sortWithinPartitions("shard").drop("volume")
    sums = dealt.mapInArrow(_add_up(folder, bits, volume_bits), ", ".join(f"{x} long" for x in _SUMS))
    words = cut(sums.groupBy("hash").agg(*[F.sum(x).alias(x) for x in _SUMS[1:]]))
    tidy(spark)  # the packed bigrams and sums, most of the disk that is used, have been read
    all_of = words.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in ("n1", "n2", "x3", "x4", "c")], F.count(F.lit(1))).first()
    two, total, one = list(all_of[:4]), all_of[4], _of_counts(words.where("c > 0"), "cont")
    word_bits = _write(words.select(*_WORDS), "hash", _WORDS, folder, "words", all_of[5])
    d2, d1 = np.array(_discounts(two)), np.array(_discounts(list(one[:4])))
    types, known_words = one["sum"], one["rows"]
    spare = (d1[1] * one["n1"] + d1[2] * one["n2"] + d1[3] * one["more"]) / types if types else 1.0

    def rate(batches):
        for batch in batches:
            for part in slices(batch, "text", _CHUNK):
                previous, token, first = _tokens(*text_buffers(part.column(1)))
                hashes, where = np.unique(np.concatenate([token, previous]), return_inverse=True)
                c, cont, totals, n1, n2, n3 = _find_words(folder, word_bits, hashes)
                low = np.maximum(cont - d1[np.minimum(cont, 3)], 0) / max(types, 1) + spare / (known_words + 1)
                back = np.where(totals > 0, (d2[1] * n1 + d2[2] * n2 + d2[3] * n3) / np.maximum(totals, 1), 1.0)
                keys, of = np.unique(_pair(previous, token), return_inverse=True)
                seen = _find_pairs(folder, volume_bits, keys)
                word, context, n = where[: len(token)], where[len(token) :], seen[of]
                p = np.maximum(n - d2[np.minimum(n, 3)], 0) / np.maximum(totals[context], 1) + back[context] * low[word]
                base = np.log10((c[word] + 1) / (total + known_words + 1))
                add = lambda x: np.add.reduceat(x, first[:-1]) if len(part) else x[:0]
                n_tokens, scores = np.diff(first), add(np.log10(p))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n_tokens), pa.array(add((c[word] > 0).astype(np.int64))), pa.array(np.full(len(part), total)), pa.array(add(base)), pa.array(scores), pa.array(10.0 ** np.minimum(-scores / n_tokens, 300))],
                    names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    rated = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(rate, f"id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
    return rated.withColumnRenamed("id", doc_id)
