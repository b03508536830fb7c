"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a sample of labelled text. A text is parsed greedily, from its
first byte to its last, into longest phrases that occur in a language's sample. A phrase is named by a place in the
sample or by a byte of its own, so it costs log2(sample bytes + 256) bits; the language whose phrases cost fewest
bits wins. Texts are lower-cased and runs of anything but letters become one space.

A long text is parsed from many places at once, `CHUNK` bytes apart; then each of these parses goes on until it
begins a phrase where a later one does, after which both are the same, and the parse from the first byte is put
together from them. Its phrases are exactly those of a parse from left to right, whatever the text's length.

The sample is bounded in rows and bytes: about `docs_per_lang` documents of each language, picked by a hash of id and
text, taken whole in order of that hash as far as they fit into `bytes_per_lang`; where none fits, the shortest of
them is taken whole. Rows that repeat id and text count once. An automaton takes about 30 bytes for a byte of sample.

Defined cases: null texts and texts without a letter are `und` with score 0, as is every text if nothing was
learned. Ties go to the language that sorts first. Rows are treated one by one, so repeats do not matter; an empty
table gives no rows. Long texts are parsed whole. All columns are kept; the results' names get underscores until they
differ from those of the columns. The language is read in training only.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, lean, small, tidy
from .states import LOW, Edges, double_array
from .words import slices, text_buffers

CHUNK = 1024
_BYTES = 4 << 20  # of text times languages that are parsed at once
UNDETERMINED = "und"


def letters(column: pa.Array) -> pa.Array:
    """Lower-cased texts with runs of other characters as one space."""
    return pc.replace_substring_regex(pc.utf8_lower(column.fill_null("")), pattern=r"[^\p{L}\p{M}]+", replacement=" ")


def automaton(codes: list[int]) -> Edges:
    """Edges (code to state) of the suffix automaton of a sequence of codes; state 0 is the root and no target."""
    step, link, length = Edges(), array("i", [-1]), array("i", [0])
    last = step.new()
    for c in codes:
        new = step.new()
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and not (target := step.get(at, c)):
            step.put(at, c, new)
            at = link[at]
        if at >= 0:
            if length[target] != length[at] + 1:
                copy = step.copy(target)
                link.append(link[target])
                length.append(length[at] + 1)
                while at >= 0 and step.get(at, c) == target:
                    step.put(at, c, copy)
                    at = link[at]
                link[target] = copy
                target = copy
            link[new] = target
        last = new
    return step


class Model:
    """Automata of all languages in one array of slots, over one coding of bytes; code 0 is a byte that no sample holds."""

    def __init__(self, samples: dict[str, bytes]):
        self.langs = sorted(samples)
        seen = np.unique(np.frombuffer(b"".join(samples.values()), np.uint8))
        self.codes = np.zeros(256, np.uint8)
        self.codes[seen] = np.arange(1, len(seen) + 1)
        width, parts, self.at, self.begin = len(seen) + 1, [], [], []
        for lang in self.langs:
            edges = automaton(self.codes[np.frombuffer(samples[lang], np.uint8)].tolist())
            slots, base = double_array(edges, width)
            self.at.append(sum(map(len, parts)))
            parts.append(slots)
            first = np.zeros(width, np.int64)
            for c, target in edges[0].items():
                first[c] = base[target]
            self.begin.append(first)
        self.slots = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.at = np.array(self.at, np.int64)
        self.begin = np.array(self.begin, np.int64).reshape(len(self.langs), width)
        self.bits = np.array([np.log2(len(samples[lang]) + 256) for lang in self.langs])

    def _step(self, k, state, c):
        """(whether a phrase begins with code c, the state after it), for automata k."""
        entry = self.slots[self.at[k] + state + c]
        begins = (state == 0) | (entry >> 32 != state)
        return begins, np.where(begins, self.begin[k, c], entry & LOW)

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases that each text needs, by language."""
        langs, texts, total = len(self.langs), len(offsets) - 1, int(offsets[-1])
        pieces = -(-np.diff(offsets) // CHUNK)
        head = np.cumsum(pieces) - pieces  # the first piece of each text
        row = np.repeat(np.arange(texts), pieces)
        start = offsets[row] + (np.arange(len(row)) - head[row]) * CHUNK
        size = np.minimum(CHUNK, offsets[row + 1] - start)
        order = np.argsort(-size, kind="stable")
        begin, live = start[order], np.searchsorted(-size[order], -np.arange(1, CHUNK + 1), side="right")
        coded = self.codes[data].astype(np.int64)
        marks = np.zeros((langs, total), bool)
        state = np.zeros((langs, len(row)), np.int64)
        every = np.arange(langs)[:, None]
        for t, n in enumerate(live):
            if n == 0:
                break
            place = begin[:n] + t
            marks[:, place], state[:, :n] = self._step(every, state[:, :n], coded[place][None, :])
        upto = np.zeros((langs, total + 1), np.int32)
        np.cumsum(marks, axis=1, out=upto[:, 1:])
        out = upto[:, offsets[1:]].astype(np.int64) - upto[:, offsets[:-1]]
        long = np.flatnonzero(pieces > 1)
        if len(long):
            at_end = np.empty_like(state)
            at_end[:, order] = state
            more = _Joined(self, coded, marks, at_end, offsets, row, start)
            for i in long:
                for k in range(langs):
                    out[k, i] = more.count(k, upto[k], head[i], offsets[i], offsets[i + 1])
        return out


class _Joined:
    """For each language and piece with a successor in its text: where its parse joins a later one, and the phrases till then."""

    def __init__(self, model: Model, coded, marks, state, offsets, row, start):
        self.model, self.coded, self.marks, self.start = model, coded, marks, start
        langs = len(model.langs)
        stop = offsets[row + 1]
        self.meets = np.full((langs, len(row)), -1, np.int64)
        self.extra = np.zeros((langs, len(row)), np.int64)
        self.state, self.place = state, np.broadcast_to(start + CHUNK, (langs, len(row))).copy()
        k, piece = np.nonzero(np.broadcast_to(start + CHUNK < stop, (langs, len(row))))
        for _ in range(2 * CHUNK):
            if not len(k):
                break
            at, now = self.place[k, piece], self.state[k, piece]
            begins, new = model._step(k, now, coded[at])
            met = begins & marks[k, at]
            self.meets[k[met], piece[met]] = at[met]
            k, piece, at, begins, new = k[~met], piece[~met], at[~met] + 1, begins[~met], new[~met]
            self.extra[k, piece] += begins
            self.place[k, piece], self.state[k, piece] = at, new
            ended = at == stop[piece]
            self.meets[k[ended], piece[ended]] = at[ended]
            k, piece = k[~ended], piece[~ended]

    def _walk(self, k: int, piece: int, stop: int) -> None:
        """Go on alone with a parse that did not join another for long; only those on the way from a text's first byte do."""
        at, state, extra = int(self.place[k, piece]), int(self.state[k, piece]), int(self.extra[k, piece])
        slots, first, marks, coded = memoryview(self.model.slots), self.model.begin[k].tolist(), memoryview(self.marks[k]), memoryview(self.coded)
        shift = int(self.model.at[k])
        while at < stop:
            c = coded[at]
            entry = slots[shift + state + c]
            if state == 0 or entry >> 32 != state:
                if marks[at]:
                    break
                extra += 1
                state = first[c]
            else:
                state = entry & LOW
            at += 1
        self.meets[k, piece], self.extra[k, piece] = at, extra

    def count(self, k: int, upto: np.ndarray, head: int, begin: int, stop: int) -> int:
        found, at = 0, begin
        while True:
            piece = head + (at - begin) // CHUNK
            end = min(int(self.start[piece]) + CHUNK, stop)
            found += int(upto[end]) - int(upto[at])
            if end == stop:
                return found
            if self.meets[k, piece] < 0:
                self._walk(k, piece, stop)
            found += int(self.extra[k, piece])
            at = int(self.meets[k, piece])
            if at == stop:
                return found


def train(docs: DataFrame, *, doc_id: str, text: str, lang: str, docs_per_lang: int, bytes_per_lang: int) -> Model:
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(F.col(doc_id), F.col(text)).alias("hash"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    share = small(cut(labelled.groupBy("lang").agg((F.lit(float(docs_per_lang)) / F.count(F.lit(1))).alias("share"))))
    part = F.col("hash").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    picked = labelled.join(share, "lang").where(part < F.col("share")).groupBy("lang", "hash").agg(F.min("text").alias("text"))
    size, of = F.octet_length("text"), Window.partitionBy("lang")
    fits = size <= bytes_per_lang
    picked = picked.withColumns({
        "upto": F.sum(F.when(fits, size)).over(of.orderBy("hash")),
        "none": ~F.max(fits).over(of),
        "place": F.row_number().over(of.orderBy(size, "hash")),
    })
    rows = picked.where((fits & (F.col("upto") <= bytes_per_lang)) | (F.col("none") & (F.col("place") == 1))).select("lang", "hash", "text").toArrow()
    found: dict[str, list[bytes]] = {}
    clean = letters(rows.column("text").combine_chunks()).to_pylist()
    for name, _, value in sorted(zip(rows.column("lang").to_pylist(), rows.column("hash").to_pylist(), clean)):
        if value.strip():
            found.setdefault(name, []).append(value.encode())
    return Model({name: b" ".join(texts) for name, texts in found.items()})


def identify(
    docs: DataFrame,
    *,
    learn: DataFrame | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    docs_per_lang: int = 64,
    bytes_per_lang: int = 1 << 18,
) -> DataFrame:
    """All columns of `docs`, then lang_pred and score (share of the runner-up's bits in those of the best two).

    learn: the rows to learn from (by default all of `docs`).
    """
    model = train(docs if learn is None else learn, doc_id=doc_id, text=text, lang=lang, docs_per_lang=docs_per_lang, bytes_per_lang=bytes_per_lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    tidy(docs.sparkSession)
    results = [free_name(docs, "lang_pred"), free_name(docs, "score")]

    def predict(batches):
        m = shared.value
        for batch in batches:
            for part in slices(batch, text, max(_BYTES // max(len(m.langs), 1), 1 << 16)):
                column = part.column(part.schema.get_field_index(text))
                clean = letters(column)
                known = pc.match_substring_regex(clean, r"\p{L}").to_numpy(zero_copy_only=False)
                if m.langs:
                    need = m.phrases(*text_buffers(clean)) * m.bits[:, None]
                    best = need.argmin(axis=0)
                    two = np.sort(need, axis=0)[:2] if len(m.langs) > 1 else np.vstack([need, need])
                    score = np.where(known, two[-1] / np.maximum(two.sum(axis=0), 1), 0.0)
                    names = [m.langs[b] if k else UNDETERMINED for b, k in zip(best, known)]
                else:
                    score, names = np.zeros(len(part)), [UNDETERMINED] * len(part)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(score)], names=[*part.schema.names, *results])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{results[0]}` string", f"`{results[1]}` double"])
    return docs.mapInArrow(lean(predict), schema)
