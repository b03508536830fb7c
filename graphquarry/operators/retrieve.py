"""Questions about the graph, each for a whole table of keys or names at once.

Every answer that is limited says so: it is cut after `limit` rows in order of key, and `truncated` tells whether
there were more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..facts import Facts
from .edges import merge_sites
from .traverse import cut, ends_of_paths, reach

DEPTH, LIMIT = 4, 40


def call_edges(facts: Facts) -> DataFrame:
    """(src, dst, render, contains), each edge once."""
    sites = facts.calls.select(F.col("from_key").alias("src"), F.col("to_key").alias("dst"), F.col("via_render").alias("render"), F.col("via_contains").alias("contains"))
    return merge_sites(sites, every=("render", "contains")).drop("n_sites")


def touch_edges(facts: Facts) -> DataFrame:
    """(src, dst, write), each edge once."""
    return merge_sites(facts.touches.select(F.col("from_key").alias("src"), F.col("model_key").alias("dst"), F.col("is_write").alias("write")), some=("write",)).drop("n_sites")


def limited(rows: DataFrame, by: list[str], order: list[str], limit: int | None) -> DataFrame:
    """At most `limit` rows of each group, with `truncated`."""
    if limit is None:
        return rows.withColumn("truncated", F.lit(False))
    group = Window.partitionBy(*by)
    numbered = rows.withColumn("_nth", F.row_number().over(group.orderBy(*order))).where(F.col("_nth") <= limit + 1)
    return numbered.withColumn("truncated", F.max("_nth").over(group) > limit).where(F.col("_nth") <= limit).drop("_nth")


def named(nodes: DataFrame, names: DataFrame, limit: int | None = 10) -> DataFrame:
    """(name, key, file, truncated): nodes by name."""
    return limited(nodes.select("name", "key", "file").join(names.select("name"), "name", "left_semi"), ["name"], ["key"], limit)


def callers(facts: Facts, keys: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """(key, caller, name, file, render, truncated): who calls each of `keys` directly."""
    edges = call_edges(facts).join(keys.select(F.col("key").alias("dst")).distinct(), "dst")
    who = facts.functions.select(F.col("key").alias("src"), "name", "file")
    return limited(edges.join(who, "src").select(F.col("dst").alias("key"), F.col("src").alias("caller"), "name", "file", "render"), ["key"], ["caller"], limit)


def callees(facts: Facts, keys: DataFrame) -> DataFrame:
    """(key, callee, name, file, render, contains)."""
    edges = call_edges(facts).join(keys.select(F.col("key").alias("src")).distinct(), "src")
    who = facts.functions.select(F.col("key").alias("dst"), "name", "file")
    return edges.join(who, "dst").select(F.col("src").alias("key"), F.col("dst").alias("callee"), "name", "file", "render", "contains")


def routes_of_handlers(facts: Facts, names: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """(name, route, method, path, truncated): routes whose handler has one of the names; not those of its callers."""
    handlers = facts.functions.join(names.select("name").distinct(), "name").select("name", F.col("key").alias("handler_key"))
    return limited(facts.routes.join(handlers, "handler_key").select("name", F.col("key").alias("route"), "method", "path"), ["name"], ["route"], limit)


def route_handlers(facts: Facts) -> DataFrame:
    """(route, key, name, file) of the functions that handle routes."""
    return facts.routes.select(F.col("key").alias("route"), F.col("handler_key").alias("key")).join(facts.functions.select("key", "name", "file"), "key")


def touchers(facts: Facts, names: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """(model, key, name, file, root, write, truncated): functions that touch models of these names themselves."""
    models = facts.models.join(names.select("name").distinct(), "name").select(F.col("name").alias("model"), F.col("key").alias("dst"))
    found = touch_edges(facts).join(models, "dst").select("model", F.col("src").alias("key"), "write").join(facts.functions.select("key", "name", "file", "root"), "key")
    return limited(found, ["model"], ["key"], limit)


def type_users(facts: Facts, names: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """(type, key, name, file, root, truncated): functions that refer to types of these names."""
    types = facts.types.join(names.select("name").distinct(), "name").select(F.col("name").alias("type"), F.col("key").alias("to_key"))
    found = facts.references.select(F.col("from_key").alias("key"), "to_key").distinct().join(types, "to_key").join(facts.functions.select("key", "name", "file", "root"), "key")
    return limited(found.select("type", "key", "name", "file", "root"), ["type"], ["key"], limit)


def models_of(facts: Facts, names: DataFrame, limit: int | None = 20) -> DataFrame:
    """(name, model, truncated): names of the models that functions of these names touch."""
    who = facts.functions.join(names.select("name").distinct(), "name").select("name", F.col("key").alias("src"))
    found = touch_edges(facts).join(who, "src").join(facts.models.select(F.col("key").alias("dst"), F.col("name").alias("model")), "dst").select("name", "model").distinct()
    return limited(found, ["name"], ["model"], limit)


def declared(facts: Facts, label: str = "functions", exported: bool = False) -> DataFrame:
    """(path, key, name): what files declare; of functions only the exported ones, if asked."""
    table = getattr(facts, label)
    if exported:
        table = table.where("exported")
    return table.join(facts.files.select("path"), F.col("file") == F.col("path")).select("path", "key", "name")


def unique_fields(facts: Facts, limit: int | None = 3) -> DataFrame:
    """(model, name, truncated): unique fields of models."""
    return limited(facts.fields.where("is_unique").join(facts.models.select(F.col("name").alias("model")), "model").select("model", "name"), ["model"], ["name"], limit)


def data_of_files(facts: Facts, limit: int | None = 50) -> DataFrame:
    """(path, model, truncated): names of the models that functions of a file touch."""
    found = declared(facts).select("path", F.col("key").alias("src")).join(touch_edges(facts), "src").join(facts.models.select(F.col("key").alias("dst"), F.col("name").alias("model")), "dst")
    return limited(found.select("path", "model").distinct(), ["path"], ["model"], limit)


def calling_places(facts: Facts, contained: bool = False) -> DataFrame:
    """(key, places): how many places (`root`) call a function; edges to nested functions do not count, unless asked."""
    edges = call_edges(facts) if contained else call_edges(facts).where("not contains")
    roots = facts.functions.select(F.col("key").alias("src"), F.coalesce("root", F.col("key").cast("string")).alias("root"))
    return edges.join(roots, "src").groupBy(F.col("dst").alias("key")).agg(F.count_distinct("root").alias("places"))


def dependants(facts: Facts, names: DataFrame, most: int = 40, examples: int = 3) -> DataFrame:
    """(name, total, files): how many call edges end at functions of these names, and the first files they come from."""
    targets = facts.functions.join(names.select("name").distinct(), "name").select("name", F.col("key").alias("dst"))
    edges = call_edges(facts).select("src", "dst").join(targets, "dst").join(facts.functions.select(F.col("key").alias("src"), "file"), "src")
    files = edges.groupBy("name", "file").agg(F.count(F.lit(1)).alias("n"))
    ranked = files.withColumn("_nth", F.row_number().over(Window.partitionBy("name").orderBy("file")))
    return ranked.groupBy("name").agg(F.sum("n").alias("total"), F.slice(F.sort_array(F.collect_list(F.when(F.col("_nth") <= min(most, examples), F.col("file")))), 1, examples).alias("files"))


def callers_of(facts: Facts, seeds: DataFrame, depth: int = DEPTH, limit: int | None = LIMIT, by: tuple[str, ...] = ("name", "file")) -> DataFrame:
    """(key, name, file, level, relation, truncated): who calls the `seeds` (key), directly or through others.

    Level by level: of each function at most `limit` callers are followed; a caller whose `by` was seen is not listed
    again; when `limit` are found, the level is the last. Seeds are not seen before, so a function may be its own caller.
    """
    edges = cut(call_edges(facts).select("src", "dst"))
    who = facts.functions.select(F.col("key").alias("src"), "name", "file")
    frontier = seeds.select("key").where("key is not null").distinct()
    seen, more, count = None, F.lit(False), 0
    for level in range(1, depth + 1):
        met = limited(edges.join(frontier.withColumnRenamed("key", "dst"), "dst"), ["dst"], ["src"], limit)
        met = cut(met.join(who, "src"))
        if limit is not None:
            cut_off = not met.where("truncated").isEmpty()
            more = more | F.lit(cut_off)
        fresh = met.select(F.col("src").alias("key"), "name", "file")
        if seen is not None:
            fresh = fresh.join(seen.select(*by), [*by], "left_anti")
        one = F.min(F.struct("key", "name", "file")).alias("s")
        fresh = cut(fresh.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(one).select("s.*").withColumn("level", F.lit(level)))
        n = fresh.count()
        seen, count, frontier = fresh if seen is None else seen.union(fresh), count + n, fresh.select("key")
        if n == 0:
            break
        if limit is not None and count >= limit:
            more = more | F.lit(n > 0)
            break
    return seen.withColumn("relation", F.when(F.col("level") == 1, F.lit("direct")).otherwise(F.lit("indirect"))).withColumn("truncated", more)


def model_paths(facts: Facts, names: DataFrame, least: int = 1, most: int = DEPTH, limit: int | None = None, route: str | None = None) -> DataFrame:
    """Distinct (model, route, method, path, handler, reacher, write, truncated): routes that reach models of these names.

    The walk goes back from the few functions that touch the models to handlers, `least` to `most` calls away. A part of
    the path may be asked for; like the limit it counts first.
    """
    models = facts.models.join(names.select("name").distinct(), "name").select(F.col("name").alias("model"), F.col("key").alias("dst"))
    reachers = cut(touch_edges(facts).join(models, "dst").select("model", F.col("src").alias("reacher"), "write"))
    back = call_edges(facts).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ends = ends_of_paths(reachers.select(F.col("reacher").alias("origin"), F.col("reacher").alias("key")).distinct(), cut(back), least, most)
    found = facts.routes.select(F.col("key").alias("route"), "method", "path", F.col("handler_key").alias("handler"))
    found = found.join(ends.select(F.col("key").alias("handler"), F.col("origin").alias("reacher")), "handler").join(reachers, "reacher").distinct()
    found = limited(found, ["model"], ["route", "handler", "reacher"], limit)
    if route is not None:
        found = found.where(F.contains(F.lower("path"), F.lit(route.lower())))
    return found.select("model", "route", "method", "path", "handler", "reacher", "write", "truncated")


def impact(facts: Facts, name: str, limit: int | None = LIMIT, by: tuple[str, ...] = ("name", "file")) -> DataFrame:
    """(part, name, file, relation, truncated): all that a change of a symbol may reach.

    Parts: `kind` (function, type, both or unknown), `declared`, `caller`, `route` (method as name, path as file),
    `dependant` of a type, `model` that its functions touch.
    """
    spark = facts.files.sparkSession
    names = spark.createDataFrame([(name,)], "name string")
    functions, types = named(facts.functions, names), named(facts.types, names)
    seeds = facts.functions.where(F.col("name") == name).select("key")
    reached = callers_of(facts, seeds, limit=limit, by=by)
    routes = routes_of_handlers(facts, names, limit)
    users = type_users(facts, names, limit)
    kind = functions.agg(F.count(F.lit(1)).alias("f")).join(types.agg(F.count(F.lit(1)).alias("t")))
    kind = kind.select(F.when((F.col("f") > 0) & (F.col("t") > 0), "both").when(F.col("f") > 0, "function").when(F.col("t") > 0, "type").otherwise("unknown").alias("name"))
    row = lambda df, part, n, f, r, t="truncated": df.select(F.lit(part).alias("part"), n.alias("name"), f.alias("file"), r.alias("relation"), F.col(t).alias("truncated") if t else F.lit(False).alias("truncated"))
    none = F.lit(None).cast("string")
    parts = [
        row(kind, "kind", F.col("name"), none, none, None),
        row(functions.union(types).select("file").distinct(), "declared", none, F.col("file"), none, None),
        row(reached, "caller", F.col("name"), F.col("file"), F.col("relation")),
        row(routes, "route", F.col("method"), F.col("path"), none),
        row(users, "dependant", F.col("name"), F.col("file"), none),
        row(models_of(facts, names), "model", F.col("model"), none, none, None),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def one_hop(facts: Facts, keys: DataFrame, members: DataFrame) -> DataFrame:
    """(key, member, direction) for calls between `keys` (key) and `members` (key): `calls` or `is called by`."""
    edges = call_edges(facts).select("src", "dst")
    inside = members.select(F.col("key").alias("member")).distinct()
    out = edges.join(keys.select(F.col("key").alias("src")).distinct(), "src").join(inside, F.col("dst") == F.col("member")).select(F.col("src").alias("key"), "member", F.lit("calls").alias("direction"))
    back = edges.join(keys.select(F.col("key").alias("dst")).distinct(), "dst").join(inside, F.col("src") == F.col("member")).select(F.col("dst").alias("key"), "member", F.lit("is called by").alias("direction"))
    return out.union(back)


def importers(imports: DataFrame, changed: DataFrame) -> DataFrame:
    """(key, distance): files that import the `changed` (key), directly or through others, to the end; the changed at 0."""
    edges = imports.select(F.col("from_file_key").alias("src"), F.col("to_file_key").alias("dst"))
    return reach(changed, edges, 1 << 30, inward=True)


def whole_paths(edges: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(path): all ways of 1 to `most` steps from `starts` (key) that visit no node twice, as arrays of keys."""
    steps = cut(edges.select("src", "dst").distinct())
    at, found = starts.select(F.array("key").alias("path")), None
    for _ in range(most):
        met = at.join(steps, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        at = cut(met.select(F.concat("path", F.array("dst")).alias("path")))
        if at.isEmpty():
            break
        found = at if found is None else found.union(at)
    return found if found is not None else at

