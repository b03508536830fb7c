"""Reading a code base again after some of its files have changed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from .edges import intact_facts
from .retrieve import importers
from .traverse import cut

FULL = 0.5


@dataclass(frozen=True)
class Plan:
    #: `full` or `incremental`
    mode: str
    #: path: files to read again; all of them if the mode is full
    affected: DataFrame
    read: int
    total: int


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change) of files (path, hash): `changed`, `new` or `deleted`."""
    sides = before.select("path", F.col("hash").alias("old")).join(now.select("path", F.col("hash").alias("new")), "path", "full")
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed")
    return sides.select("path", change.alias("change")).where("change is not null")


def plan(before: DataFrame | None, now: DataFrame, files: DataFrame | None = None, imports: DataFrame | None = None, full: float = FULL) -> Plan:
    """What to read: changed files and all that import them, directly or not; everything if a file is gone or most are affected.

    before, now: (path, hash) of the last snapshot and of today; files and imports are the last snapshot's.
    """
    total = now.count()
    if before is None or files is None or imports is None:
        return Plan("full", now.select("path"), total, total)
    found = cut(changes(before, now))
    if not found.where("change = 'deleted'").isEmpty():
        return Plan("full", now.select("path"), total, total)
    paths = files.select("key", "path")
    changed = found.select("path").join(paths, "path", "left").select(F.coalesce("key", F.concat(F.lit("new:"), "path")).alias("key"), "path")
    reached = importers(imports, changed.select("key")).join(paths, "key").select("path")
    affected = cut(reached.union(changed.select("path")).distinct())
    n = affected.count()
    if n > full * max(total, 1):
        return Plan("full", now.select("path"), total, total)
    return Plan("incremental", affected, n, total)


def merged(previous: Facts, fresh: Facts, reread: DataFrame) -> Facts:
    """The previous facts with those of the files that were read again (path) replaced; edges without both ends are dropped."""
    again = reread.select(F.col("path").alias("_path"))
    out = {}
    for name, old in previous.relations().items():
        new = getattr(fresh, name)
        if name == "files":
            kept = old.join(again, F.col("path") == F.col("_path"), "left_anti")
        elif name in ("models", "fields"):
            kept, new = old, new.limit(0)  # schemas are read whole, not file by file
        elif name == "imports":
            owner = previous.files.select(F.col("key").alias("from_file_key"), "path")
            kept = old.join(owner.join(again, F.col("path") == F.col("_path"), "left_semi"), "from_file_key", "left_anti")
        else:
            kept = old.join(again, F.col("file") == F.col("_path"), "left_anti")
        out[name] = kept.unionByName(new.select(*kept.columns))
    return intact_facts(Facts(**out))[0]
