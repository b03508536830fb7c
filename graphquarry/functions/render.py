"""What people and programs are told, as columns: decisions, challenges, briefings, questions to a model and its answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The answers that an opinion may give.
OPINIONS = ("SUPPORTED_EXPANSION", "EXPECTED", "SUSPICIOUS", "HUMAN_DECISION")


def challenge(reason: Column, question: Column, evidence: Column, opinion: Column | None = None) -> Column:
    """A challenge's text: the reason, what speaks for it, an opinion if there is one, and the question."""
    said = F.transform(evidence, lambda e: F.concat(F.lit("  - "), e["text"]))
    parts = [F.array(reason), said]
    if opinion is not None:
        parts.append(F.array(F.concat(F.lit("Opinion: "), opinion)))
    parts.append(F.array(question))
    return F.array_join(F.filter(F.concat(*parts), lambda line: line.isNotNull()), "\n")


def decision_json(denied: Column, text: Column, event: str = "PreToolUse") -> Column:
    """What a hook prints: nothing where a change is allowed, else JSON that denies it."""
    inner = F.struct(F.lit(event).alias("hookEventName"), F.lit("deny").alias("permissionDecision"), text.alias("permissionDecisionReason"))
    return F.when(denied, F.to_json(F.struct(inner.alias("hookSpecificOutput"))))


def context_json(text: Column, event: str = "UserPromptSubmit") -> Column:
    return F.to_json(F.struct(F.struct(F.lit(event).alias("hookEventName"), text.alias("additionalContext")).alias("hookSpecificOutput")))


def briefing(tasks: DataFrame, members: DataFrame, models: DataFrame, names: int = 12, files: int = 8) -> DataFrame:
    """(task, briefing): what a boundary covers, the nearest first."""
    near = Window.partitionBy("task").orderBy("distance", "name", "key")
    listed = members.withColumn("nth", F.row_number().over(near)).where(F.col("nth") <= names).groupBy("task").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "name"))), lambda x: x["name"]).alias("names"))
    sizes = members.groupBy("task").agg(F.count(F.lit(1)).alias("n"))
    per = members.groupBy("task", "file").agg(F.min("distance").alias("d"))
    paths = per.withColumn("nth", F.row_number().over(Window.partitionBy("task").orderBy("d", "file"))).where(F.col("nth") <= files).groupBy("task").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "file"))), lambda x: x["file"]).alias("files"))
    data = models.where("core").groupBy("task").agg(F.sort_array(F.collect_set("name")).alias("data"))
    t = tasks.join(sizes, "task", "left").join(listed, "task", "left").join(paths, "task", "left").join(data, "task", "left")
    line = lambda label, column: F.when(F.size(column) > 0, F.concat(F.lit(label), F.array_join(column, ", ")))
    more = F.when(F.col("n") > names, F.concat(F.lit(" (+"), F.col("n") - names, F.lit(")"))).otherwise(F.lit(""))
    text = F.concat_ws("\n", F.concat(F.lit("Task: "), "text"), F.concat(line("Functions: ", F.col("names")), more), line("Files: ", F.col("files")), line("Data: ", F.col("data")))
    return t.select("task", text.alias("briefing"))


def opinion_prompt(verdicts: DataFrame, members: DataFrame, tasks: DataFrame, most: int = 15) -> DataFrame:
    """(intent, prompt): what a model is asked about a challenged change, with the task's nearest members."""
    nearest = F.row_number().over(Window.partitionBy("task").orderBy("distance", "name", "key"))
    around = members.withColumn("nth", nearest).where(F.col("nth") <= most)
    line = F.concat(F.lit("- "), "name", F.lit(" ("), "file", F.lit("), distance "), "distance")
    around = around.groupBy("task").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", line.alias("l")))), lambda x: x["l"]), "\n").alias("around"))
    text = F.concat_ws(
        "\n", F.concat(F.lit("Task: "), F.coalesce("text", F.lit(""))), F.lit("In scope:"), F.coalesce("around", F.lit("- nothing")), F.concat(F.lit("Change: "), "file"), F.concat(F.lit("Concern: "), "reason"),
        F.lit("Answer in JSON with decision (" + ", ".join(OPINIONS) + "), reason and evidence."),
    )
    return verdicts.join(tasks.select("task", "text"), "task", "left").join(around, "task", "left").select("intent", text.alias("prompt"))


def opinion(answer: Column, most: int = 6) -> Column:
    """(decision, reason, evidence) read from a model's answer, in a fence or among other words; null if it is not one."""
    inner = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    parsed = F.from_json(inner, "struct<decision:string, reason:string, evidence:array<string>>")
    decision = F.upper(F.trim(parsed["decision"]))
    said = F.slice(F.filter(F.coalesce(parsed["evidence"], F.array().cast("array<string>")), lambda e: F.trim(e) != ""), 1, most)
    return F.when(decision.isin(*OPINIONS) & (F.trim(parsed["reason"]) != ""), F.struct(decision.alias("decision"), F.trim(parsed["reason"]).alias("reason"), said.alias("evidence")))
