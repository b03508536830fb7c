"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes. Each node has a failure link, the node to go on from when no edge fits, and the
number of tokens that taking the link pops; both are computed once. Greedy longest-match lengths of a word then come
from one pass over its bytes, and no piece is ever built. Distinct words of a batch go through the automaton side by
side, one byte at a time; the few that are longer than all others go on one by one.

A word is a run of other characters than white space with the one space before it, or a run of white space that no
word takes. Bytes where no token fits are one unknown token each.

Defined cases: null and empty texts have no tokens; rows are counted one by one, so repeats stay; very long words are
counted whole, in time linear in their length; an empty table gives no rows. Columns other than id and text are
ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .states import LOW, double_array
from .words import slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_CHUNK = 1 << 20
_FEW = 32  # so many words are worth a step side by side
_PIECES = regex.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+?(?= ?[^\x20\x09-\x0D])|[\x20\x09-\x0D]+$")


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a vocabulary file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class LongestMatch:
    """A trie as a double array, with failure links and popped counts by state."""

    def __init__(self, vocabulary: list[bytes]):
        edges: list[dict[int, int]] = [{}]
        token, parent, byte = [False], [0], [0]
        # with every single byte in the trie, a byte that no token covers is one unknown token
        for word in [bytes([b]) for b in range(256)] + vocabulary:
            at = 0
            for b in word:
                nxt = edges[at].get(b)
                if nxt is None:
                    nxt = edges[at][b] = len(token)
                    edges.append({})
                    token.append(False)
                    parent.append(at)
                    byte.append(b)
                at = nxt
            token[at] = at != 0
        depth = [0] * len(token)
        for v in range(1, len(token)):
            depth[v] = depth[parent[v]] + 1
        fail, pops = [0] * len(token), [0] * len(token)
        for v in sorted(range(1, len(token)), key=depth.__getitem__):
            if token[v]:
                pops[v] = 1
                continue
            z, n = fail[parent[v]], pops[parent[v]]
            while byte[v] not in edges[z]:
                n += pops[z]
                z = fail[z]
            fail[v], pops[v] = edges[z][byte[v]], n
        self.slots, base = double_array(edges, 256)
        self.fail, self.pops = np.zeros(int(base.max()) + 1, np.int64), np.zeros(int(base.max()) + 1, np.int64)
        self.fail[base], self.pops[base] = base[fail], pops

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word."""
        lengths = np.array([len(w) for w in words], np.int64)
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = (np.cumsum(lengths) - lengths)[order]
        node, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
        t = 0
        while t < len(live) and live[t] >= _FEW:
            c = data[start[: live[t]] + t]
            todo = np.arange(live[t])
            while len(todo):
                entry = self.slots[node[todo] + c[todo]]
                fits = entry >> 32 == node[todo]
                node[todo[fits]] = entry[fits] & LOW
                todo = todo[~fits]
                count[todo] += self.pops[node[todo]]
                node[todo] = self.fail[node[todo]]
            t += 1
        for i in range(live[t] if t < len(live) else 0):
            node[i], n = self._walk(int(node[i]), data[start[i] + t : start[i] + size[i]].tolist())
            count[i] += n
        todo = np.flatnonzero(node > 0)
        while len(todo):
            count[todo] += self.pops[node[todo]]
            node[todo] = self.fail[node[todo]]
            todo = todo[node[todo] > 0]
        out = np.empty(len(words), np.int64)
        out[order] = count
        return out

    def _walk(self, node: int, codes: list[int]) -> tuple[int, int]:
        """(the state after more bytes of one word, tokens popped on the way)."""
        slots, fail, pops, n = memoryview(self.slots), memoryview(self.fail), memoryview(self.pops), 0
        for c in codes:
            entry = slots[node + c]
            while entry >> 32 != node:
                n += pops[node]
                node = fail[node]
                entry = slots[node + c]
            node = entry & LOW
        return node, n


def token_counts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row: id, n_words (pieces between white space), n_tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(LongestMatch(read_ranks(vocabulary)))

    def count(batches):
        machine = shared.value
        for batch in batches:
            for part in slices(batch, "text", _CHUNK):
                number: dict[bytes, int] = {}
                ids, sizes = [], []
                for value in part.column(1).to_pylist():
                    found = _PIECES.findall(value.encode()) if value else []
                    ids.extend([number.setdefault(w, len(number)) for w in found])
                    sizes.append(len(found))
                each = machine.counts(list(number))[np.array(ids, np.int64)] if ids else np.zeros(0, np.int64)
                sums = np.concatenate([[0], np.cumsum(each)])
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends)), pa.array(np.diff(sums[ends]))], names=["id", "n_words", "n_tokens"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(count, f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", doc_id)
