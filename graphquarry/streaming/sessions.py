"""Changes of files judged event by event: a state machine for each session, kept by Structured Streaming.

The state of a session is its running task only, and ends with it. Events must come in order of (at, seq) across
batches; within a batch they are sorted. The answers are those of `operators.sessions.detected`.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sessions import ACCOUNTED, BEFORE, CANDIDATE, DELETED, FORCED, SEEN, SLACK_MS, UNREAD

EVENT = "session long, at timestamp, seq long, kind string, file string, mtime_ms long, size long, exists boolean"
FOUND = "session long, task long, seq long, file string, found string"
_ANALYSED = re.compile(r"\.(ts|tsx|prisma)$")


def analysed(file: str) -> bool:
    return bool(_ANALYSED.search(file))


class Session:
    """The running task of a session: when it began, and what became of its files."""

    def __init__(self, state: dict | None = None):
        state = state or {"task": 0, "started": None, "settled": [], "judged": [], "seen": []}
        self.task, self.started = state["task"], state["started"]
        self.settled, self.judged, self.seen = set(state["settled"]), set(state["judged"]), {tuple(s) for s in state["seen"]}

    def dump(self) -> dict:
        return {"task": self.task, "started": self.started, "settled": sorted(self.settled), "judged": sorted(self.judged), "seen": sorted(self.seen)}

    def open(self, at_ms: int) -> None:
        self.__init__({"task": self.task + 1, "started": at_ms, "settled": [], "judged": [], "seen": []})

    def change(self, file: str, mtime_ms: int, size: int, exists: bool, reads: Callable[[str], bool]) -> str:
        signature = (file, mtime_ms, size)
        if file in self.settled:
            return FORCED
        if file in self.judged:
            return ACCOUNTED
        if not exists:
            return DELETED
        if self.started is not None and mtime_ms <= self.started - SLACK_MS:
            self.seen.add(signature)
            return BEFORE
        if signature in self.seen:
            return SEEN
        if not reads(file):
            self.seen.add(signature)
            return UNREAD
        self.judged.add(file)
        return CANDIDATE

    def take(self, event, reads: Callable[[str], bool]) -> str | None:
        if event.kind == "open":
            self.open(int(event.at_ms))
        elif event.kind in ("challenge", "justify"):
            self.settled.add(event.file)
        elif event.kind == "judge":
            self.judged.add(event.file)
        elif event.kind == "change":
            return self.change(event.file, int(event.mtime_ms), int(event.size), bool(event.exists), reads)
        return None


def detected(events: DataFrame, reads: Callable[[str], bool] = analysed) -> DataFrame:
    """(session, task, seq, file, found) for a stream of events."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        session = Session(json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(batches)).sort_values(["at", "seq"])
        out = []
        for event in rows.itertuples(index=False):
            found = session.take(event, reads)
            if found is not None:
                out.append((key[0], session.task, event.seq, event.file, found))
        state.update((json.dumps(session.dump()),))
        yield pd.DataFrame(out, columns=["session", "task", "seq", "file", "found"])

    timed = events.withColumn("at_ms", F.unix_millis("at"))
    return timed.groupBy("session").applyInPandasWithState(step, FOUND, "state string", "append", "NoTimeout")
