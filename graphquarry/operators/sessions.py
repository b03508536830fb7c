"""What happens to files while a task runs, from a log of events; in batch, with windows.

Events are (session, at, seq, kind, file, mtime_ms, size, exists): `open` starts a task, `challenge`, `justify` and
`judge` settle or account for a file, `change` reports a file that has changed on disk. A task lasts until its
session's next `open`. `streaming.sessions` gives the same answers event by event.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import is_analysed
from ..functions.text import is_question

SLACK_MS = 2000
FORCED, ACCOUNTED, DELETED, BEFORE, SEEN, UNREAD, CANDIDATE = "forced", "accounted", "delete", "pre-task", "seen", "unreadable", "candidate"


def with_tasks(events: DataFrame) -> DataFrame:
    """Events with `task` (0 before the first open) and `started_ms`, the time of its open."""
    order = Window.partitionBy("session").orderBy("at", "seq")
    opened = F.col("kind") == "open"
    return events.withColumn("task", F.count(F.when(opened, 1)).over(order)).withColumn("started_ms", F.max(F.when(opened, F.unix_millis("at"))).over(order))


def detected(events: DataFrame, analysed: Column | None = None) -> DataFrame:
    """(session, task, seq, file, found): what each change is. First match wins: forced (the file was challenged or justified),
    accounted (judged, or a candidate before), delete, pre-task, seen (the same time and size again), unreadable, candidate.
    """
    analysed = is_analysed(F.col("file")) if analysed is None else analysed
    of_file = Window.partitionBy("session", "task", "file").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    e = with_tasks(events)
    before = lambda when: F.coalesce(F.max(when).over(of_file), F.lit(False))
    e = e.withColumn("settled", before(F.col("kind").isin("challenge", "justify"))).withColumn("judged", before(F.col("kind") == "judge"))
    change = F.col("kind") == "change"
    plain = change & ~F.col("settled") & ~F.col("judged") & F.col("exists")
    old = F.coalesce(F.col("mtime_ms") <= F.col("started_ms") - SLACK_MS, F.lit(False))
    same = Window.partitionBy("session", "task", "file", "mtime_ms", "size").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # a signature is noted when the file is left alone for its age or kind
    noted = plain & (old | ~analysed)
    e = e.withColumn("known", F.coalesce(F.max(noted).over(same), F.lit(False)))
    first = plain & ~old & analysed & ~F.col("known")
    e = e.withColumn("candidate_before", F.coalesce(F.max(first).over(of_file), F.lit(False)))
    found = (
        F.when(F.col("settled"), FORCED).when(F.col("judged") | F.col("candidate_before"), ACCOUNTED).when(~F.col("exists"), DELETED).when(old, BEFORE).when(F.col("known"), SEEN).when(~analysed, UNREAD).otherwise(CANDIDATE)
    )
    return e.where(change).select("session", "task", "seq", "file", found.alias("found"))


def unseen(events: DataFrame) -> DataFrame:
    """(session, task, file, mtime_ms): at the end of a task, changes that nothing accounted for, each time of change once;
    those from before the task are left out, deletions count as time 0.
    """
    e = with_tasks(events)
    known = e.where("kind in ('challenge', 'justify', 'judge')").select("session", "task", "file").distinct()
    late = ~F.col("exists") | (F.col("mtime_ms") > F.col("started_ms") - SLACK_MS)
    changed = e.where((F.col("kind") == "change") & late & (F.col("task") > 0)).select("session", "task", "file", F.when(F.col("exists"), F.col("mtime_ms")).otherwise(0).alias("mtime_ms")).distinct()
    return changed.join(known, ["session", "task", "file"], "left_anti")


def unseen_summary(found: DataFrame, most: int = 3) -> DataFrame:
    """(session, task, files, said): a line for each task that has unseen changes."""
    listed = F.sort_array(F.collect_set("file"))
    per = found.groupBy("session", "task").agg(listed.alias("files"))
    more = F.when(F.size("files") > most, F.concat(F.lit(" and "), F.size("files") - most, F.lit(" more"))).otherwise(F.lit(""))
    return per.withColumn("said", F.concat(F.size("files"), F.lit(" changed without being seen: "), F.array_join(F.slice("files", 1, most), ", "), more))


def marks(events: DataFrame) -> DataFrame:
    """(session, task, file, challenged, justified, judged, forced, overlay_ms): what is known of each file at the end of a task.

    A change of a challenged file that nobody justified before makes it forced; the overlay keeps its latest time.
    """
    e = with_tasks(events).where("file is not null and task > 0")
    of_file = Window.partitionBy("session", "task", "file").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda kind: F.coalesce(F.max(F.col("kind") == kind).over(of_file), F.lit(False))
    e = e.withColumn("forces", (F.col("kind") == "change") & before("challenge") & ~before("justify"))
    has = lambda kind: F.bool_or(F.col("kind") == kind).alias({"challenge": "challenged", "justify": "justified", "judge": "judged"}[kind])
    latest = F.max(F.when((F.col("kind") == "change") & F.col("exists"), F.col("mtime_ms")))
    return e.groupBy("session", "task", "file").agg(has("challenge"), has("justify"), has("judge"), F.bool_or("forces").alias("forced"), latest.alias("overlay_ms"))


def prompt_actions(prompts: DataFrame, explicit: bool = False) -> DataFrame:
    """(…, action) for prompts (session, at, prompt_id, text, verdict): `duplicate` of an id that was handled, `question`, `opened`
    for the first of a session, `kept` for the same job or no signal, then `redrawn`, or `reported` where tasks are set explicitly.
    """
    same = Window.partitionBy("session", "prompt_id").orderBy("at")
    p = prompts.withColumn("_again", F.col("prompt_id").isNotNull() & (F.row_number().over(same) > 1)).withColumn("_asks", is_question(F.col("text")))
    order = Window.partitionBy("session").orderBy("at")
    nth = F.sum(F.when(~F.col("_again") & ~F.col("_asks"), 1).otherwise(0)).over(order)
    action = (
        F.when(F.col("_again"), "duplicate").when(F.col("_asks"), "question").when(nth == 1, "opened").when(F.col("verdict").isin("SAME", "NO_SIGNAL"), "kept").otherwise(F.lit("reported" if explicit else "redrawn"))
    )
    return p.withColumn("action", action).drop("_again", "_asks")


def is_stale(built_ms: Column, now_ms: Column, overlay_ms: Column, changed_ms: Column, missing: Column, throttle_ms: int = 30_000) -> Column:
    """Whether a snapshot must be built again: there is none; it is older than the throttle and a file changed after it, or is gone."""
    newer = (F.coalesce(overlay_ms, F.lit(0)) > built_ms) | (F.coalesce(changed_ms, F.lit(0)) > built_ms) | F.coalesce(missing, F.lit(False))
    return F.when(built_ms.isNull(), True).when(now_ms - built_ms < throttle_ms, False).otherwise(newer)
