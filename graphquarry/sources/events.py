"""Logs and events as tables: tool calls that edit files, patches, version control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import normalise_path
from ..functions.text import first_said

PAYLOAD = (
    "hook_event_name string, session_id string, tool_name string, prompt string, user_prompt string, prompt_id string, turn_id string, "
    "tool_input struct<file_path:string, filePath:string, path:string, content:string, new_string:string, newString:string, old_string:string, oldString:string, command:string>"
)
_PATCH = r"\*\*\*\s*(Begin Patch|Add File|Update File|Delete File)"
_HEADER = r"^\*\*\*\s*(Add|Update|Delete)\s+File:\s*(.+?)\s*$"


def payloads(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of JSON with their fields; lines that are no JSON have nulls."""
    return lines.withColumn("p", F.from_json(column, PAYLOAD))


def prompt_text(p: str = "p") -> Column:
    return first_said(F.col(f"{p}.user_prompt"), F.col(f"{p}.prompt"))


def prompt_id(p: str = "p") -> Column:
    return first_said(F.col(f"{p}.prompt_id"), F.col(f"{p}.turn_id"))


def _relative(path: Column, root: Column) -> Column:
    """A path below the root, relative to it; null for others."""
    p, r = F.replace(path, F.lit("\\"), F.lit("/")), F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), "/$", "")
    absolute = p.rlike("^(/|[A-Za-z]:)")
    below = F.startswith(F.lower(p), F.concat(F.lower(r), F.lit("/")))
    inner = F.when(~absolute, F.regexp_replace(p, r"^(\./)+", "")).when(below, F.substring(p, F.length(r) + 2, F.length(p)))
    return F.when(~F.startswith(inner, F.lit("../")) & (inner != ".."), inner)


def intents(events: DataFrame, root: str) -> DataFrame:
    """(event, nth, operation, file, content, old, new, outside): files that events (event, p) are about to change.

    A single call names one file; a patch may name several, and only files that it adds have their whole content.
    Paths outside the root have no file and stand in `outside`.
    """
    r, i = F.lit(root), "p.tool_input"
    patched = F.coalesce(F.col(f"{i}.command").rlike(_PATCH), F.lit(False))
    path = F.coalesce(*[F.when(F.col(f"{i}.{c}") != "", F.col(f"{i}.{c}")) for c in ("file_path", "filePath", "path")])
    content = F.coalesce(*[F.when(F.col(f"{i}.{c}") != "", F.col(f"{i}.{c}")) for c in ("content", "new_string", "newString")])
    old = F.coalesce(*[F.when(F.col(f"{i}.{c}") != "", F.col(f"{i}.{c}")) for c in ("old_string", "oldString")])
    new = F.col(f"{i}.new_string")
    both = old.isNotNull() & new.isNotNull()
    operation = F.when((F.col("p.tool_name") == "Write") & F.col(f"{i}.content").isNotNull(), "create").otherwise("edit")
    single = events.where(~patched & path.isNotNull()).select("event", F.lit(0).alias("nth"), operation.alias("operation"), path.alias("named"), content.alias("content"), F.when(both, old).alias("old"), F.when(both, new).alias("new"))
    lines = events.where(patched).select("event", F.posexplode(F.split(f"{i}.command", r"\r?\n")).alias("line", "text"))
    is_header = F.col("text").rlike(_HEADER)
    order = Window.partitionBy("event").orderBy("line")
    lines = lines.withColumn("nth", F.count(F.when(is_header, 1)).over(order)).withColumn("ends", F.max(F.col("text").rlike(r"^\*\*\*\s*End Patch")).over(order))
    body = F.transform(F.sort_array(F.collect_list(F.when(~is_header & ~F.col("ends") & F.startswith("text", F.lit("+")), F.struct("line", F.expr("substring(text, 2)").alias("t"))))), lambda x: x["t"])
    files = lines.where("nth > 0").groupBy("event", "nth").agg(F.max(F.when(is_header, F.regexp_extract("text", _HEADER, 1))).alias("kind"), F.max(F.when(is_header, F.regexp_extract("text", _HEADER, 2))).alias("named"), body.alias("added"))
    kinds = F.when(F.col("kind") == "Add", "create").when(F.col("kind") == "Delete", "delete").otherwise("edit")
    whole = F.when((F.col("kind") == "Add") & (F.size("added") > 0), F.array_join("added", "\n"))
    none = F.lit(None).cast("string")
    several = files.select("event", (F.col("nth") - 1).cast("int").alias("nth"), kinds.alias("operation"), "named", whole.alias("content"), none.alias("old"), none.alias("new"))
    file = _relative(F.col("named"), r)
    return single.union(several).select("event", "nth", "operation", file.alias("file"), "content", "old", "new", F.when(file.isNull(), F.col("named")).alias("outside"))


def changed_paths(status: DataFrame, prefix: str = "", state_folder: str | None = None) -> DataFrame:
    """(status, path) from lines (value) of short version-control status: renames take the new path, quotes go, paths are
    taken relative to `prefix`, and files of the tool's own state folder are left out.
    """
    raw = F.expr("substring(value, 4)")
    path = F.regexp_replace(F.when(F.contains(raw, F.lit(" -> ")), F.substring_index(raw, " -> ", -1)).otherwise(raw), '^"|"$', "")
    found = status.where(F.length("value") > 3).select(F.substring("value", 1, 2).alias("status"), path.alias("path"))
    if prefix:
        found = found.where(F.startswith("path", F.lit(prefix))).withColumn("path", normalise_path(F.col("path"), F.lit(prefix)))
    if state_folder is not None:
        found = found.where(~F.startswith("path", F.lit(state_folder.rstrip("/") + "/")))
    return found


def changed_lines(diff: DataFrame) -> DataFrame:
    """(file, line) on the new side, from lines (nth, value) of a diff without context; a pure deletion yields the line it is at."""
    shape = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    file = F.last(F.when(F.col("value").rlike(r"^\+\+\+ "), F.regexp_extract("value", r"^\+\+\+ (?:b/)?(.*)$", 1)), ignorenulls=True).over(Window.orderBy("nth"))
    hunks = diff.withColumn("file", file).where(F.col("value").rlike(shape))
    start = F.regexp_extract("value", shape, 1).cast("int")
    count = F.coalesce(F.when(F.regexp_extract("value", shape, 2) != "", F.regexp_extract("value", shape, 2)).cast("int"), F.lit(1))
    return hunks.select("file", F.explode(F.sequence(start, start + F.greatest(count, F.lit(1)) - 1)).alias("line"))
