"""State machines as double arrays: one array of 64-bit entries, one gather a step.

A state is named by a number b, its base; its edge of code c lies in slot b + c, which holds the base of the state
that the edge leads to and, in the upper half, b itself, so that a slot of another state is told apart. Codes are
from 0 to width - 1. Two states never share a base, and every slot that a lookup can reach exists.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import numpy as np

_TRIES = 64
LOW = (1 << 32) - 1
_NONE, _SEVERAL = -1, -2


class Edges(Sequence):
    """The edges (code to state) of each state of a machine that is being built; state 0 is no target.

    Most states of large machines have one edge, which takes eight bytes here; only the others have a dictionary.
    """

    def __init__(self):
        self.only, self.more = array("q"), {}

    def __len__(self) -> int:
        return len(self.only)

    def __getitem__(self, state: int) -> dict[int, int]:
        edge = self.only[state]
        return {edge >> 32: edge & LOW} if edge >= 0 else self.more[state] if edge == _SEVERAL else {}

    def __iter__(self) -> Iterator[dict[int, int]]:
        return map(self.__getitem__, range(len(self.only)))

    def new(self) -> int:
        self.only.append(_NONE)
        return len(self.only) - 1

    def copy(self, state: int) -> int:
        """A new state with the edges of another."""
        self.only.append(self.only[state])
        if state in self.more:
            self.more[len(self.only) - 1] = dict(self.more[state])
        return len(self.only) - 1

    def get(self, state: int, code: int) -> int:
        """Where an edge leads, 0 if there is none."""
        edge = self.only[state]
        if edge >= 0:
            return edge & LOW if edge >> 32 == code else 0
        return self.more[state].get(code, 0) if edge == _SEVERAL else 0

    def put(self, state: int, code: int, target: int) -> None:
        edge = self.only[state]
        if edge == _SEVERAL:
            self.more[state][code] = target
        elif edge == _NONE or edge >> 32 == code:
            self.only[state] = code << 32 | target
        else:
            self.more[state] = {edge >> 32: edge & LOW, code: target}
            self.only[state] = _SEVERAL


def double_array(edges: Sequence[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots, base of each state) of a machine; state 0 has base 0. An empty slot holds -1."""
    many = sorted((s for s in range(1, len(edges)) if len(edges[s]) > 1), key=lambda s: -len(edges[s]))
    room = sum(map(len, edges)) + width * (len(many) + 2) + len(edges)
    taken, named = bytearray(room + 2 * width), bytearray(room + 2 * width)
    base, named[0] = np.zeros(len(edges), np.int64), 1
    for c in edges[0]:
        taken[c] = 1
    at, end = 1, width
    for s in many:
        codes = sorted(edges[s])
        least = codes[0]
        for _ in range(_TRIES):
            at = taken.find(0, at)
            b = at - least
            if b > 0 and not named[b] and not any(taken[b + c] for c in codes):
                break
            at += 1
        else:
            at = taken.find(0, end)
            b = max(at - least, end)
            while named[b]:
                b += 1
        for c in codes:
            taken[b + c] = 1
        base[s], named[b], end = b, 1, max(end, b + codes[-1])
    # states of one edge fill the gaps, those without any take a free name
    waiting: dict[int, list[int]] = {}
    for s in range(len(edges) - 1, 0, -1):
        if len(edges[s]) == 1:
            waiting.setdefault(next(iter(edges[s])), []).append(s)
    for c, states in waiting.items():
        at = max(c, 1)
        while states:
            at = taken.find(0, at)
            if at > c and not named[at - c]:
                s = states.pop()
                base[s], named[at - c], taken[at] = at - c, 1, 1
            at += 1
    at = 1
    for s in range(1, len(edges)):
        if not edges[s]:
            at = named.find(0, at)
            base[s], named[at] = at, 1
    slots = np.full(int(base.max(initial=0)) + width + 1, -1, np.int64)
    owner = np.repeat(base, np.fromiter(map(len, edges), np.int64, len(edges)))
    codes = np.fromiter((c for e in edges for c in e), np.int64, len(owner))
    target = base[np.fromiter((t for e in edges for t in e.values()), np.int64, len(owner))]
    slots[owner + codes] = (owner << 32) | target
    return slots, base
