"""The part of a graph that a task is about: a bounded walk from its anchors, for many tasks at once.

Anchors (task, key, kind, name, rank, why) seed functions at distance 0. A type, model or field that more than
`shared` places use is held back; where a task has no other seeds, the narrowest of those held back seeds it after
all. Then each level takes in what functions call (`called by`), what they hold inside (`declared inside`, at their
own distance and not expanded) and, for the first `inbound` levels, who calls them (`calls`). A function that was
reached only by rendering does not lead on to what it renders. Seeds of the first `core` anchors are the task's core.

Where a function is reached in several ways the least (distance, distance of the other, direction, name of the
other, key of the other) gives the reason. The cap on members is looked at after each level.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..facts import Facts
from .retrieve import call_edges, calling_places, touch_edges
from .traverse import cut


@dataclass(frozen=True)
class Bounds:
    depth: int = 1
    inbound: int = 1
    members: int = 800
    shared: int = 25
    core: int = 12
    hubs: bool = False
    render_chains: bool = False


@dataclass(frozen=True)
class Neighbourhood:
    #: task, key, name, file, distance, reason, core
    members: DataFrame
    #: task, key, name, via (the first member that touches it), core
    models: DataFrame
    #: task, members, max_distance, truncated, hubs_skipped
    stats: DataFrame


def seeds(facts: Facts, anchors: DataFrame, bounds: Bounds = Bounds()) -> DataFrame:
    """(task, key, reason, core): functions that anchors stand for, each with its first anchor's reason."""
    a = anchors.select("task", F.col("key").cast("string").alias("anchor"), "kind", F.col("name").alias("label"), "rank", "why")
    who = facts.functions.select("key", F.coalesce("root", F.col("key").cast("string")).alias("root"))
    text = lambda c: F.col(c).cast("string")
    own = a.where("kind = 'function'").join(facts.functions.select("key", text("key").alias("anchor")), "anchor").withColumn("reason", F.concat(F.lit("anchor — "), "why"))
    handled = facts.routes.select(text("key").alias("anchor"), F.col("handler_key").alias("key"))
    handled = a.where("kind = 'route'").join(handled, "anchor").withColumn("reason", F.concat(F.lit("handles "), "label", F.lit(" — "), "why"))
    using = facts.references.select(text("to_key").alias("anchor"), F.col("from_key").alias("key")).distinct()
    using = a.where("kind = 'type'").join(using, "anchor").withColumn("reason", F.concat(F.lit("uses "), "label"))
    touching = touch_edges(facts).join(facts.models.select(F.col("key").alias("dst"), F.col("name").alias("model")), "dst").select("model", F.col("src").alias("key"))
    touching = a.where("kind in ('model', 'field')").join(touching, F.substring_index("label", ".", 1) == F.col("model")).drop("model").withColumn("reason", F.concat(F.lit("touches "), "label", F.lit(" — "), "why"))
    columns = ["task", "anchor", "rank", "label", "reason", "key"]
    shapes = using.select(*columns).union(touching.select(*columns)).join(who, "key")
    places = shapes.groupBy("task", "anchor", "rank").agg(F.count_distinct("root").alias("places"))
    shapes = cut(shapes.join(places, ["task", "anchor", "rank"]))
    direct = own.select(*columns).union(handled.select(*columns)).join(who.select("key"), "key")
    found = cut(direct.select(*columns).union(shapes.where(F.col("places") <= bounds.shared).select(*columns)))
    held = shapes.where(F.col("places") > bounds.shared).join(found.select("task").distinct(), "task", "left_anti")
    narrowest = held.groupBy("task").agg(F.min(F.struct("places", "rank")).alias("n")).select("task", F.col("n.rank").alias("rank"))
    fallback = held.join(narrowest, ["task", "rank"]).select("task", "anchor", "rank", "label", F.concat(F.lit("uses "), "label").alias("reason"), "key")
    first = lambda df, core: df.groupBy("task", "key").agg(F.min(F.struct("rank", "reason")).alias("f")).select("task", "key", "f.reason", core.alias("core"))
    return first(found, F.col("f.rank") < bounds.core).union(first(fallback, F.lit(False)))


def neighbourhood(facts: Facts, anchors: DataFrame, bounds: Bounds = Bounds()) -> Neighbourhood:
    edges = cut(call_edges(facts))
    who = facts.functions.select("key", "name", "file")
    start = seeds(facts, anchors, bounds).join(who, "key")
    members = cut(start.select("task", "key", "name", "file", F.lit(0).alias("distance"), "reason", "core"))
    skipped = None
    hubs = None
    if bounds.hubs:
        hubs = cut(calling_places(facts).where(F.col("places") > bounds.shared).select(F.col("key").alias("hub"), "places"))
    frontier = members.select("task", "key", "name", F.lit(False).alias("rendered"))
    full = members.select("task").limit(0).distinct()
    for level in range(1, bounds.depth + 1):
        at = frontier.select("task", F.col("key").alias("from"), F.col("name").alias("from_name"), "rendered")
        out = at.join(edges, F.col("from") == F.col("src"))
        inside = out.where("contains").select("task", F.col("dst").alias("key"), F.lit(level - 1).alias("distance"), F.lit(0).alias("way"), "from", "from_name", F.concat(F.lit("declared inside "), "from_name").alias("reason"), F.lit(False).alias("render"))
        called = out.where("not contains")
        if not bounds.render_chains:
            called = called.where("not (rendered and render)")
        called = called.select("task", F.col("dst").alias("key"), F.lit(level).alias("distance"), F.lit(1).alias("way"), "from", "from_name", F.concat(F.lit("called by "), "from_name").alias("reason"), "render")
        step = called
        if level <= bounds.inbound:
            back = at.join(edges, F.col("from") == F.col("dst"))
            step = step.union(back.select("task", F.col("src").alias("key"), F.lit(level).alias("distance"), F.lit(2).alias("way"), "from", "from_name", F.concat(F.lit("calls "), "from_name").alias("reason"), F.lit(False).alias("render")))
        if hubs is not None:
            seeded = members.where("distance = 0").select("task", "key", F.lit(True).alias("seeded"))
            columns = step.columns
            step = cut(step.join(hubs.withColumnRenamed("hub", "key"), "key", "left").join(seeded, ["task", "key"], "left").select(*columns, "places", "seeded"))
            off = step.where("places is not null and seeded is null").select("task", "key", "places").distinct()
            skipped = off if skipped is None else skipped.union(off)
            step = step.where("places is null or seeded is not null").drop("places", "seeded")
        order = F.struct("distance", "way", "from_name", "from", "reason")
        reached = inside.union(step).groupBy("task", "key").agg(F.min(order).alias("f"), F.bool_and(F.when(F.col("way") > 0, F.col("render"))).alias("rendered"), F.max("way").alias("last"))
        reached = reached.join(members.select("task", "key", F.lit(True).alias("known")), ["task", "key"], "left").where("known is null")
        fresh = cut(reached.join(who, "key").select("task", "key", "name", "file", F.col("f.distance").alias("distance"), F.col("f.reason").alias("reason"), F.lit(False).alias("core"), F.coalesce("rendered", F.lit(False)).alias("rendered"), "last"))
        members = members.union(fresh.select("task", "key", "name", "file", "distance", "reason", "core"))
        full = cut(members.groupBy("task").count().where(F.col("count") >= bounds.members).select("task"))
        # what is only declared inside another is a member, but leads no further
        frontier = fresh.where("distance = %d" % level).join(full, "task", "left_anti").select("task", "key", "name", "rendered")
        if level < bounds.depth and frontier.isEmpty():
            break
    names = facts.models.select(F.col("key").alias("dst"), F.col("name").alias("model"))
    touched = members.join(touch_edges(facts), F.col("key") == F.col("src")).join(names, "dst")
    via = F.min(F.struct("distance", "name", "key")).alias("via")
    models = touched.groupBy("task", F.col("dst").alias("key"), F.col("model").alias("name")).agg(via, F.bool_or("core").alias("core")).select("task", "key", "name", F.col("via.name").alias("via"), "core")
    stats = members.groupBy("task").agg(F.count(F.lit(1)).alias("members"), F.max("distance").alias("max_distance"))
    stats = stats.join(full.withColumn("truncated", F.lit(True)), "task", "left").withColumn("truncated", F.coalesce("truncated", F.lit(False)))
    off = skipped.groupBy("task").agg(F.count_distinct("key").alias("hubs_skipped")) if skipped is not None else members.select("task", F.lit(0).cast("long").alias("hubs_skipped")).limit(0)
    return Neighbourhood(members, models, stats.join(off, "task", "left").withColumn("hubs_skipped", F.coalesce("hubs_skipped", F.lit(0).cast("long"))))


def listing(members: DataFrame, most: int = 12) -> DataFrame:
    """(task, nth, key, name, file, distance): members from the nearest on, by name."""
    nth = F.row_number().over(Window.partitionBy("task").orderBy("distance", "name", "key"))
    return members.withColumn("nth", nth).where(F.col("nth") <= most).select("task", "nth", "key", "name", "file", "distance")


def model_overlap(facts: Facts, keys: DataFrame, models: DataFrame) -> DataFrame:
    """(task, file, shared, foreign): names of models that functions (task, file, key) touch, split by the task's core models."""
    names = facts.models.select(F.col("key").alias("dst"), F.col("name").alias("model"))
    touched = keys.join(touch_edges(facts), F.col("key") == F.col("src")).join(names, "dst").select("task", "file", "model").distinct()
    core = models.where("core").select("task", F.col("name").alias("model"), F.lit(True).alias("core")).distinct()
    split = touched.join(core, ["task", "model"], "left")
    pick = lambda mine: F.sort_array(F.collect_set(F.when(F.col("core").isNotNull() == F.lit(mine), F.col("model"))))
    return split.groupBy("task", "file").agg(pick(True).alias("shared"), pick(False).alias("foreign"))
