"""Sites to edges: merging, deriving, checking, comparing, and what a write changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions.ids import hash_id

#: So many sources may lose edges before a write leaves stale edges alone, and so many nodes may go.
MOST_REBUILT, MOST_PRUNED = 60, 150


def merge_sites(sites: DataFrame, src: str = "src", dst: str = "dst", every: tuple[str, ...] = (), some: tuple[str, ...] = ()) -> DataFrame:
    """One edge for each (src, dst): a flag in `every` holds if it holds at all sites, one in `some` if at any. Null is false."""
    flag = lambda f, n: f(F.coalesce(F.col(n), F.lit(False))).alias(n)
    return sites.groupBy(src, dst).agg(F.count(F.lit(1)).alias("n_sites"), *[flag(F.bool_and, n) for n in every], *[flag(F.bool_or, n) for n in some])


def intact(edges: DataFrame, nodes: DataFrame, src: str = "src", dst: str = "dst", key: str = "key") -> DataFrame:
    """Edges both of whose ends are nodes."""
    keys = nodes.select(F.col(key).alias("_key"))
    return edges.join(keys, F.col(src) == F.col("_key"), "left_semi").join(keys, F.col(dst) == F.col("_key"), "left_semi")


def intact_facts(facts: Facts) -> tuple[Facts, DataFrame]:
    """Facts whose edges have both ends, and (relation, dropped): how many edges of each relation had not."""
    keys = lambda *tables: [t.select(F.col("key").cast("string").alias("_key")) for t in tables]

    def semi(df: DataFrame, column: str, tables: list[DataFrame]) -> DataFrame:
        known = tables[0]
        for t in tables[1:]:
            known = known.union(t)
        return df.join(known, F.col(column).cast("string") == F.col("_key"), "left_semi")

    functions, types, models, files = keys(facts.functions, facts.types, facts.models, facts.files)
    kept = {
        "calls": semi(semi(facts.calls, "from_key", [functions]), "to_key", [functions]),
        "references": semi(semi(facts.references, "from_key", [functions, types]), "to_key", [types]),
        "touches": semi(semi(facts.touches, "from_key", [functions]), "model_key", [models]),
        "imports": semi(semi(facts.imports, "from_file_key", [files]), "to_file_key", [files]),
        "routes": semi(facts.routes, "handler_key", [functions]),
    }
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    counts = None
    for name, df in kept.items():
        one = n(getattr(facts, name), "a").join(n(df, "b")).select(F.lit(name).alias("relation"), (F.col("a") - F.col("b")).alias("dropped"))
        counts = one if counts is None else counts.union(one)
    return facts.replaced(**kept), counts


def delta(old: DataFrame, new: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Keys that only one of two snapshots holds: change is `add` or `remove`. Both are read and shuffled once."""
    both = old.select(*keys, F.lit(True).alias("_old")).unionByName(new.select(*keys, F.lit(False).alias("_old")))
    sides = both.groupBy(*keys).agg(F.bool_and("_old").alias("_gone"), F.bool_or("_old").alias("_was"))
    return sides.where("_gone or not _was").select(*keys, F.when(F.col("_gone"), F.lit("remove")).otherwise(F.lit("add")).alias("change"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows, with repeats, that only one side holds: `side` is `missing` (only left) or `extra` (only right)."""
    right = right.select(*left.columns)
    return left.exceptAll(right).withColumn("side", F.lit("missing")).union(right.exceptAll(left).withColumn("side", F.lit("extra")))


def edge_groups(facts: Facts) -> DataFrame:
    """(label, src, dst, render, contains, write): every edge of the graph once, in ten groups of seven labels; keys as text.

    CALLS keep render and contains if all sites have them, TOUCHES write if any has it; other labels have no flags.
    """

    def group(label: str, df: DataFrame, src: str, dst: str, **flags: str) -> DataFrame:
        columns = [F.col(flags[f]).alias(f) if f in flags else F.lit(None).cast("boolean").alias(f) for f in ("render", "contains", "write")]
        return df.select(F.lit(label).alias("label"), F.col(src).cast("string").alias("src"), F.col(dst).cast("string").alias("dst"), *columns)

    paths = facts.files.select(F.col("key").alias("_file"), F.col("path").alias("_path"))
    declared = lambda t: t.join(paths, F.col("file") == F.col("_path"))
    models = facts.models.select(F.col("key").alias("_model"), F.col("name").alias("_name"))
    of_types, of_functions = (t.select(F.col("key").cast("string").alias("_key")) for t in (facts.types, facts.functions))
    source = lambda kind: facts.references.join(kind, F.col("from_key").cast("string") == F.col("_key"), "left_semi")
    groups = [
        group("CALLS", facts.calls, "from_key", "to_key", render="via_render", contains="via_contains"),
        group("TOUCHES", facts.touches, "from_key", "model_key", write="is_write"),
        group("HANDLED_BY", facts.routes, "key", "handler_key"),
        group("HAS_FIELD", facts.fields.join(models, F.col("model") == F.col("_name")), "_model", "key"),
        group("DECLARES", declared(facts.functions), "_file", "key"),
        group("DECLARES", declared(facts.types), "_file", "key"),
        group("DECLARES", declared(facts.models), "_file", "key"),
        group("IMPORTS", facts.imports, "from_file_key", "to_file_key"),
        group("REFERENCES", source(of_functions), "from_key", "to_key"),
        group("REFERENCES", source(of_types), "from_key", "to_key"),
    ]
    every = groups[0]
    for g in groups[1:]:
        every = every.union(g)
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    calls, touches = F.col("label") == "CALLS", F.col("label") == "TOUCHES"
    return every.where("src is not null and dst is not null").groupBy("label", "src", "dst").agg(
        F.bool_and(F.when(calls, no("render"))).alias("render"), F.bool_and(F.when(calls, no("contains"))).alias("contains"), F.bool_or(F.when(touches, no("write"))).alias("write")
    )


def edge_id(label: Column, src: Column, dst: Column) -> Column:
    return hash_id(F.concat(F.lit("edge:"), label, F.lit(":"), src, F.lit("->"), dst))


def first_of_each(rows: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(the first row of each key, (label-free) number of rows that were dropped)."""
    numbered = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(order)))
    return numbered.where("_nth = 1").drop("_nth"), numbered.agg(F.count(F.when(F.col("_nth") > 1, 1)).alias("dropped"))


def changed_rows(current: DataFrame, previous: DataFrame, key: str = "key", forced: DataFrame | None = None) -> DataFrame:
    """Rows that are new, differ from the previous row of their key, or whose key is forced (key)."""
    digest = lambda df: F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])))
    before = previous.select(F.col(key).alias("_key"), digest(previous.select(*current.columns)).alias("_before"))
    rows = current.withColumn("_now", digest(current)).join(before, F.col(key) == F.col("_key"), "left")
    differs = ~F.col("_now").eqNullSafe(F.col("_before"))
    if forced is not None:
        rows = rows.join(forced.select(F.col("key").alias("_forced")).distinct(), F.col(key) == F.col("_forced"), "left")
        differs = differs | F.col("_forced").isNotNull()
    return rows.where(differs).select(*current.columns)


def write_plan(previous: DataFrame, current: DataFrame, most: int = MOST_REBUILT) -> DataFrame:
    """(label, src, dst, action): what to do with the edges of two snapshots (label, src, dst).

    Edges that are gone make their sources be rebuilt, and with these all edges at them be written again: `write`. If more
    than `most` sources lose edges, none is rebuilt and what is gone stays: `stale`. New edges are `write` in any case, gone
    ones otherwise `delete`; an edge that stays as it is has no row.
    """
    keys = ("label", "src", "dst")
    sides = previous.select(*keys, F.lit(True).alias("_old")).unionByName(current.select(*keys, F.lit(False).alias("_old")))
    sides = sides.groupBy(*keys).agg(F.bool_or("_old").alias("was"), F.bool_or(~F.col("_old")).alias("now"))
    lost = sides.where("was and not now").select(F.col("src").alias("_lost")).distinct()
    many = lost.limit(most + 1).agg((F.count(F.lit(1)) > most).alias("many"))
    rebuilt = lost.join(many).where("not many").select("_lost")
    marked = sides.join(rebuilt.withColumnRenamed("_lost", "_s"), F.col("src") == F.col("_s"), "left").join(rebuilt.withColumnRenamed("_lost", "_d"), F.col("dst") == F.col("_d"), "left")
    gone = F.when(F.col("_s").isNotNull(), F.lit("delete")).otherwise(F.lit("stale"))
    write = ~F.col("was") | F.col("_s").isNotNull() | F.col("_d").isNotNull()
    action = F.when(~F.col("now"), gone).when(write, F.lit("write"))
    return marked.select(*keys, action.alias("action")).where("action is not null")


def pruned(previous: DataFrame, current: DataFrame, most: int = MOST_PRUNED) -> DataFrame:
    """(label, key, action) of nodes (label, key) that are gone: `delete`, or `skip` where more than `most` of all are."""
    gone = previous.select("label", "key").distinct().join(current.select("label", "key"), ["label", "key"], "left_anti")
    many = gone.limit(most + 1).agg((F.count(F.lit(1)) > most).alias("many"))
    return gone.join(many).select("label", "key", F.when(F.col("many"), F.lit("skip")).otherwise(F.lit("delete")).alias("action"))


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges (src, dst) that have no end among nodes that are gone (key)."""
    keys = gone.select(F.col("key").alias("_gone"))
    return edges.join(keys, F.col("src") == F.col("_gone"), "left_anti").join(keys, F.col("dst") == F.col("_gone"), "left_anti")


def node_list(facts: Facts) -> DataFrame:
    """(label, key) of all nodes; keys as text."""
    out = None
    for label, name in (("File", "files"), ("Function", "functions"), ("Type", "types"), ("Route", "routes"), ("Model", "models"), ("Field", "fields")):
        one = getattr(facts, name).select(F.lit(label).alias("label"), F.col("key").cast("string").alias("key"))
        out = one if out is None else out.union(one)
    return out
