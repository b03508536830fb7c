"""How well boundaries fit: against changes that were really made, and against another way to compute the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..facts import RELATIONS, Facts
from . import anchors as anchor_ops
from .edges import difference, edge_groups
from .neighbourhood import Bounds, neighbourhood
from .traverse import cut

LEAST_RECALL, MOST_AREA = 0.9, 0.05


def chosen_commits(commits: DataFrame, most: int = 30, depth: int = 400) -> DataFrame:
    """Commits (nth, sha, subject, files) whose subject names a task: no housekeeping, 18 characters or more, 1 to 8 files."""
    bare = F.regexp_replace("subject", r"^\w+(\([^)]*\))?:\s*", "")
    files = F.filter("files", lambda f: (F.trim(f) != "") & ~f.rlike(r"\.d\.ts$"))
    s = F.col("subject")
    keep = ~s.rlike(r"(?i)^(chore|ci|build|release|docs|style|test|revert)\b") & ~s.rlike(r"(?i)\b(bump|merge|wip|lint|format|prettier|eslint|version)\b") & ~s.rlike(r"^v?\d+\.\d+") & (F.length(bare) >= 18)
    return commits.where(F.col("nth") < depth).where(keep).withColumn("files", files).where(F.size("files").between(1, 8)).orderBy("nth").limit(most)


def owners(lines: DataFrame, functions: DataFrame) -> DataFrame:
    """(…, key, name): the innermost function around each line (file, line); null outside of all.

    Lines meet functions by file; of those that hold a line the one of the smallest range, then the last to begin, owns it.
    """
    spans = functions.select("file", "key", "name", F.col("line").alias("_from"), F.col("end_line").alias("_to"))
    numbered = lines.withColumn("_row", F.monotonically_increasing_id())
    numbered = cut(numbered)
    held = numbered.join(spans, "file").where(F.col("line").between(F.col("_from"), F.col("_to")))
    best = held.groupBy("_row").agg(F.min_by(F.struct("key", "name"), F.struct(F.col("_to") - F.col("_from"), -F.col("_from"), F.col("key"))).alias("o"))
    return numbered.join(best, "_row", "left").select(*lines.columns, "o.key", "o.name")


def enclosing(positions: DataFrame, spans: DataFrame) -> DataFrame:
    """(…, key): the span (file, start, end, key) around each position (file, pos) that begins last; null outside of all."""
    numbered = cut(positions.withColumn("_row", F.monotonically_increasing_id()))
    held = numbered.join(spans.select("file", "start", "end", "key"), "file").where((F.col("start") <= F.col("pos")) & (F.col("end") >= F.col("pos")))
    best = held.groupBy("_row").agg(F.max_by("key", F.struct(F.col("start"), -F.col("end"))).alias("key"))
    return numbered.join(best, "_row", "left").select(*positions.columns, "key")


def case_recalls(facts: Facts, cases: DataFrame, members: DataFrame) -> DataFrame:
    """(task, changed, hit, recall, area, missed) of cases (task, key): which changed functions a boundary holds, and how much it is.

    Functions that are gone are no part of a case; cases without any left are dropped.
    """
    total = facts.functions.agg(F.count(F.lit(1)).alias("total"))
    known = cases.select("task", "key").distinct().join(facts.functions.select("key", "name"), "key")
    inside = members.select("task", "key", F.lit(True).alias("inside"))
    met = known.join(inside, ["task", "key"], "left")
    sizes = members.groupBy("task").agg(F.count(F.lit(1)).alias("size"))
    per = met.groupBy("task").agg(F.count(F.lit(1)).alias("changed"), F.count("inside").alias("hit"), F.sort_array(F.collect_list(F.when(F.col("inside").isNull(), F.col("name")))).alias("missed"))
    per = per.join(sizes, "task", "left").join(total)
    return per.select("task", "changed", "hit", (F.col("hit") / F.col("changed")).alias("recall"), (F.coalesce("size", F.lit(0)) / F.col("total")).alias("area"), "missed")


def summary(recalls: DataFrame, *by: str) -> DataFrame:
    """(…, cases, recall, median_area, worst_area, perfect, passes); the median is the upper of two."""
    nth = F.element_at(F.sort_array(F.collect_list("area")), (F.floor(F.count(F.lit(1)) / 2) + 1).cast("int"))
    out = recalls.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), F.avg("recall").alias("recall"), nth.alias("median_area"), F.max("area").alias("worst_area"), F.count(F.when(F.col("recall") == 1, 1)).alias("perfect"))
    return out.withColumn("passes", (F.col("recall") >= LEAST_RECALL) & (F.col("median_area") < MOST_AREA))


def sweep(facts: Facts, tasks: DataFrame, cases: DataFrame, candidates: dict[str, dict]) -> DataFrame:
    """(candidate, …summary) for settings {name: {limit, weighting, bounds}} of anchors and boundaries."""
    out = None
    for name, c in candidates.items():
        found = anchor_ops.anchors(facts, tasks, limit=c.get("limit", anchor_ops.LIMIT), weighting=c.get("weighting", False))
        members = neighbourhood(facts, found, c.get("bounds", Bounds())).members
        one = summary(case_recalls(facts, cases, members)).select(F.lit(name).alias("candidate"), "*")
        out = one if out is None else out.union(one)
    return out


def misses(recalls: DataFrame) -> DataFrame:
    """Cases that miss something, the worst first."""
    return recalls.where("recall < 1").orderBy("recall", "task").select("task", "recall", "missed")


def false_alarms(verdicts: DataFrame) -> DataFrame:
    """(decision, rule, extension, n, challenged) of verdicts on changes that belonged to their tasks."""
    extension = F.regexp_extract("file", r"(\.[^./]+)$", 1)
    return verdicts.groupBy("decision", "rule", extension.alias("extension")).agg(F.count(F.lit(1)).alias("n")).withColumn("challenged", F.col("decision").isin("SUSPICIOUS", "HUMAN_REVIEW"))


def same_facts(left: Facts, right: Facts) -> DataFrame:
    """(relation, missing, extra): how many rows, with repeats, only one of two snapshots holds."""
    out = None
    for name in RELATIONS:
        diff = difference(getattr(left, name), getattr(right, name))
        one = diff.agg(F.count(F.when(F.col("side") == "missing", 1)).alias("missing"), F.count(F.when(F.col("side") == "extra", 1)).alias("extra")).select(F.lit(name).alias("relation"), "missing", "extra")
        out = one if out is None else out.union(one)
    return out


def edge_check(facts: Facts, ledger: DataFrame) -> DataFrame:
    """(label, facts, ledger, missing, extra): edges that the facts imply against those that were written (label, src, dst)."""
    implied = edge_groups(facts).select("label", "src", "dst", F.lit(True).alias("i"))
    sides = implied.join(ledger.select("label", "src", "dst", F.lit(True).alias("w")).distinct(), ["label", "src", "dst"], "full")
    n = lambda when, name: F.count(F.when(when, 1)).alias(name)
    return sides.groupBy("label").agg(F.count("i").alias("facts"), F.count("w").alias("ledger"), n(F.col("w").isNull(), "missing"), n(F.col("i").isNull(), "extra"))


def same_boundary(left: DataFrame, right: DataFrame) -> DataFrame:
    """Members (name, file, distance, reason) that only one of two boundaries holds."""
    columns = ("task", "name", "file", "distance", "reason")
    return difference(left.select(*columns), right.select(*columns))


def task_area(members: DataFrame, most: int = 4) -> DataFrame:
    """(task, file, nth): the files that most members of a task are in."""
    per = members.groupBy("task", "file").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("nth", F.row_number().over(Window.partitionBy("task").orderBy(F.desc("n"), "file"))).where(F.col("nth") <= most)
