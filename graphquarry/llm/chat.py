"""Chat formatting of reply trees.

Messages name their parents. Iterative self-joins double each message's known ancestry, so that a tree of depth d
takes about log2(d) joins to give every leaf its root and its path's score. Leaves are ranked in their trees by
score; the same jumps, taken back from the largest, mark the messages of each chosen path, and every path is
formatted as one conversation.

Template: <s>role, a line feed, the text, </s>. Inside roles and texts a backslash is put before each backslash and
inside the strings <s>, </s>, [INST], [/INST] (and before a role's line feeds), and removing one backslash before
each character takes it back. The loss mask covers the texts of assistant turns, nothing else.

Defined cases: null texts and roles are empty; messages whose parent is missing or null are roots; equal scores
rank by leaf id; messages in a cycle reach no root and are on no path; ids are unique in a conversation. Flat rows
without conversation id are one conversation of their own; null turns come last, repeated rows stay. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

# Control strings, each with the form it takes inside a text.
CONTROL = {"<s>": "<\\s>", "</s>": "<\\/s>", "[INST]": "[\\INST]", "[/INST]": "[\\/INST]"}
OPEN, CLOSE, LOSS_ROLE = "<s>", "</s>", "assistant"
_BACK = regex.compile(r"\\(.)", regex.DOTALL)
_TURN = regex.compile(r"<s>((?:[^\\\n]|\\.)*+)\n(.*?)</s>", regex.DOTALL)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control, form in CONTROL.items():
        text = text.replace(control, form)
    return text


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask: spans of code points."""
    parts, at, mask = [], 0, []
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}".replace("\n", "\\\n") + "\n", escape(text)
        if role == LOSS_ROLE:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), mask


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def chosen_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(conv, leaf, rank, id, depth) of the best paths of each tree; from (conv, id, parent, score)."""
    m = messages.select("conv", "id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("sum"))
    known = m.select("conv", F.col("id").alias("anc"), F.lit(True).alias("there"))
    state = m.withColumnRenamed("parent", "anc").join(known, ["conv", "anc"], "left").select("conv", "id", F.when(F.col("there"), F.col("anc")).alias("anc"), "sum", F.lit(0).alias("depth"), F.col("id").alias("root"))
    state = cut(state.withColumn("root", F.when(F.col("anc").isNull(), F.col("id"))).withColumn("depth", F.when(F.col("anc").isNull(), 0).otherwise(1)))
    jumps, left = [], -1
    while True:
        open_ = state.where("anc is not null").count()
        if open_ == 0 or (1 << max(len(jumps) - 1, 0)) > max(left, 1):
            break  # what is still open after more jumps than there are messages goes in circles
        left = state.count() if left < 0 else left
        jumps.append(state.where("anc is not null").select("conv", "id", "anc"))
        far = state.select("conv", F.col("id").alias("anc"), F.col("anc").alias("f_anc"), F.col("sum").alias("f_sum"), F.col("depth").alias("f_depth"), F.col("root").alias("f_root"))
        # only messages that have not reached their root go on; an ancestor's sum covers the ancestor up to below its own
        hopped = state.where("anc is not null").join(far, ["conv", "anc"])
        hopped = hopped.select("conv", "id", F.col("f_anc").alias("anc"), (F.col("sum") + F.col("f_sum")).alias("sum"), (F.col("depth") + F.col("f_depth")).alias("depth"), F.col("f_root").alias("root"))
        state = cut(state.where("anc is null").select("conv", "id", "anc", "sum", "depth", "root").union(hopped))
    parents = messages.select("conv", F.col("parent").alias("id")).where("id is not null").distinct()
    leaves = state.where("root is not null").join(parents, ["conv", "id"], "left_anti")
    if branches == 1:
        best = leaves.groupBy("conv", "root").agg(F.max_by("id", F.struct("sum", -F.col("id"))).alias("leaf")).withColumn("rank", F.lit(1))
    else:
        order = Window.partitionBy("conv", "root").orderBy(F.desc("sum"), "id")
        best = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches).withColumnRenamed("id", "leaf")
    marked = cut(best.select("conv", "leaf", "rank", F.col("leaf").alias("id")))
    for jump in reversed(jumps):
        up = marked.join(jump, ["conv", "id"]).select("conv", "leaf", "rank", F.col("anc").alias("id"))
        marked = cut(marked.union(up).distinct())
    return marked.join(state.select("conv", "id", "depth"), ["conv", "id"])


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Per chosen path: conv, leaf, rank, formatted text and loss mask; from (conv, id, parent, role, text, score)."""
    paths = chosen_paths(messages, branches)
    turns = paths.join(messages.select("conv", "id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["conv", "id"])
    grouped = turns.groupBy("conv", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))

    def write(batches):
        for batch in batches:
            for i in range(len(batch)):
                formatted, mask = format_turns([(t["role"], t["text"]) for t in batch.column("turns")[i].as_py()])
                row = batch.slice(i, 1)
                spans = pa.array([[{"start": a, "end": b} for a, b in mask]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
                yield pa.RecordBatch.from_arrays([row.column(c) for c in ("conv", "leaf", "rank")] + [pa.array([formatted]), spans], names=["conv", "leaf", "rank", "formatted", "mask"])

    return grouped.mapInArrow(write, "conv string, leaf long, rank int, formatted string, mask array<struct<start:long,end:long>>")


def chains(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Messages (conv, id, parent, role, text, score) of flat conversations: each turn answers the one before it.

    conv is the id as text after an equals sign, and empty where the id is null.
    """
    order = Window.partitionBy("conv").orderBy(F.col(turn).asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    d = rows.select(F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("")).alias("conv"), F.col(turn), "role", "text")
    d = d.withColumn("id", F.row_number().over(order).cast("long"))
    return cut(d.select("conv", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")))


def digests(formatted: DataFrame) -> DataFrame:
    """Read conversations back from their formatted text: (conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)."""

    def read(batches):
        for batch in batches:
            out = []
            for conv, text, mask in zip(batch.column("conv").to_pylist(), batch.column("formatted").to_pylist(), batch.column("mask").to_pylist()):
                turns = parse_turns(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in mask)
                whole = "".join(f"{r}\n{t}\n" for r, t in turns)
                out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    return formatted.select("conv", "formatted", "mask").mapInArrow(read, "conv string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
