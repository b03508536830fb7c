"""Word boundaries and 64-bit word hashes, computed over Arrow buffers.

Texts stay UTF-8 bytes throughout. Both word definitions used here split only
on ASCII characters, and no byte of a multi-byte character is ASCII, so
classifying bytes is the same as classifying code points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SEGMENT = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that belong to a word: anything but white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes that belong to a word: digits, letters and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, length: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < length:
        size = max(length, _SEGMENT + 1)
        table = np.full(size, base, dtype=U64)
        table[0] = 1
        np.cumprod(table, out=table)
        if size == _SEGMENT + 1:
            _powers[base] = table
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; nulls become empty rows."""
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most `limit` bytes of text each (one longer row stands alone)."""
    values = batch.column(batch.schema.get_field_index(column))
    _, offsets = text_buffers(values)
    row = 0
    while row < len(values):
        last = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        last = min(max(last, row + 1), len(values))
        yield batch.slice(row, last - row)
        row = last


class Words:
    """The words of consecutive texts: their hashes, byte spans, and the first word of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, member: np.ndarray, spans: bool = False):
        starts_of, ends_of, hashes = [], [], []
        total = int(offsets[-1])
        edges = offsets[(offsets > 0) & (offsets < total)]
        at = 0
        while at < total:
            stop = self._cut(data, member, edges, at, min(at + _SEGMENT, total), total)
            piece = LOWER[data[at:stop]]
            inside = member[piece]
            first = inside.copy()
            first[1:] &= ~inside[:-1]
            last = inside.copy()
            last[:-1] &= ~inside[1:]
            lo, hi = np.searchsorted(edges, (at, stop), side="left")
            breaks = edges[lo:hi] - at
            first[breaks] |= inside[breaks]
            breaks = breaks[breaks > 0]
            last[breaks - 1] |= inside[breaks - 1]
            start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
            n = stop - at
            sums = np.empty(n + 1, dtype=U64)
            sums[0] = 0
            np.cumsum((piece.astype(U64) + U64(1)) * _power_table(_BASE, n)[:n], out=sums[1:])
            hashed = (sums[end] - sums[start]) * _power_table(_BASE_INVERSE, n + 1)[start]
            hashes.append(mix(hashed + (end - start).astype(U64)))
            starts_of.append(start + at)
            if spans:
                ends_of.append(end + at)
            at = stop
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        starts = np.concatenate(starts_of) if starts_of else np.zeros(0, np.int64)
        self.first = np.searchsorted(starts, offsets).astype(np.int64)
        if spans:
            self.starts = starts
            self.ends = np.concatenate(ends_of) if ends_of else np.zeros(0, np.int64)

    @staticmethod
    def _cut(data, member, edges, at, stop, total):
        """Where a segment may end: not inside a word."""
        if stop == total:
            return stop
        back = np.flatnonzero(~member[LOWER[data[max(at, stop - 4096) : stop]]])
        if len(back):
            return max(at, stop - 4096) + int(back[-1]) + 1
        ahead = stop
        while ahead < total:
            gap = np.flatnonzero(~member[LOWER[data[ahead : ahead + 65536]]])
            if len(gap):
                return ahead + int(gap[0]) + 1
            ahead += 65536
        return total

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(column: pa.Array, member: np.ndarray, spans: bool = False) -> tuple[Words, np.ndarray]:
    data, offsets = text_buffers(column)
    return Words(data, offsets, member, spans), data


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` words from each position (positions too near the end are left out)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = words[:n].copy()
    for j in range(1, size):
        out *= U64(0xD6E8FEB86659FD93)
        out += words[j : j + n]
    return mix(out)
