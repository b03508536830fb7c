"""What names mean across files: modules, re-exports, members and call targets, as joins.

Symbol tables are long tables: `local_names` (file, name, key), `imports` (file, name, module, imported; `*` for a
whole module), `exports` (file, name, local, from_module, imported), `stars` (file, nth, module) and `files` (path).
Every answer is (…, outcome, key): `repo` with a key, `external`, or `unresolved`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import joined_path
from .traverse import cut

#: Re-exports are followed so many times; what is open then is unresolved.
ROUNDS = 32


@dataclass(frozen=True)
class Symbols:
    files: DataFrame
    local_names: DataFrame
    imports: DataFrame
    exports: DataFrame
    stars: DataFrame
    #: nth, prefix, suffix, to_nth, to_prefix, to_suffix: path aliases in order, each with its targets in order
    aliases: DataFrame | None = None


def _candidates(base: Column) -> Column:
    bare = F.regexp_replace(base, r"\.(js|jsx|mjs|cjs)$", "")
    ends = [base, *[F.concat(b, F.lit(e)) for b, e in ((base, ".ts"), (base, ".tsx"), (bare, ".ts"), (bare, ".tsx"), (base, "/index.ts"), (base, "/index.tsx"))]]
    return F.array(*ends)


def modules(symbols: Symbols, requests: DataFrame) -> DataFrame:
    """(file, module, outcome, target) of requests (file, module): relative ones are looked up beside the file, others by alias."""
    asked = requests.select("file", "module").distinct()
    folder = F.when(F.contains("file", F.lit("/")), F.regexp_replace("file", "/[^/]*$", "")).otherwise(F.lit(""))
    tries = asked.where("module like '.%'").select("file", "module", F.lit(0).alias("a"), F.lit(0).alias("b"), joined_path(folder, F.col("module")).alias("base"))
    if symbols.aliases is not None:
        fits = F.startswith("module", F.col("prefix")) & F.endswith("module", F.col("suffix")) & (F.length("module") >= F.length("prefix") + F.length("suffix"))
        middle = F.substring(F.col("module"), F.length("prefix") + 1, F.length("module") - F.length("prefix") - F.length("suffix"))
        met = asked.where("module not like '.%'").join(F.broadcast(symbols.aliases), fits)
        tries = tries.union(met.select("file", "module", F.col("nth"), F.col("to_nth"), joined_path(F.lit(""), F.concat("to_prefix", middle, "to_suffix"))))
    spread = tries.select("file", "module", "a", "b", F.posexplode(_candidates(F.col("base"))).alias("c", "path"))
    found = spread.join(symbols.files.select("path"), "path").groupBy("file", "module").agg(F.min(F.struct("a", "b", "c", "path")).alias("f"))
    return asked.join(found, ["file", "module"], "left").select("file", "module", F.when(F.col("f").isNull(), "external").otherwise("repo").alias("outcome"), F.col("f.path").alias("target"))


def exported(symbols: Symbols, requests: DataFrame) -> DataFrame:
    """(file, name, outcome, key) of requests (file, name) for what files export.

    A name is followed through re-exports, then through `export *` in order; of those the first that leads to a key
    counts, and none that leads outside alone. Requests that were made before on the way are not made again.
    """
    # `order` is the path of star places that led here: the least that ends at a key wins
    open_ = cut(requests.select(F.col("file").alias("ask_file"), F.col("name").alias("ask_name"), "file", "name", F.array().cast("array<int>").alias("order")).distinct())
    seen, done = open_.select("ask_file", "ask_name", "file", "name"), None
    of_module = cut(modules(symbols, symbols.exports.where("from_module is not null").select("file", F.col("from_module").alias("module")).union(symbols.stars.select("file", "module"))))
    exports = symbols.exports.select("file", "name", "local", F.col("from_module").alias("module"), F.coalesce("imported", "name").alias("next"))
    for _ in range(ROUNDS):
        bound = open_.join(exports, ["file", "name"], "left")
        direct = bound.where("local is not null").join(symbols.local_names.select("file", F.col("name").alias("local"), "key"), ["file", "local"], "left")
        ends = direct.select("ask_file", "ask_name", "order", F.when(F.col("key").isNull(), "unresolved").otherwise("repo").alias("outcome"), "key")
        through = bound.where("local is null and module is not null").join(of_module, ["file", "module"])
        stars = bound.where("local is null and module is null").select("ask_file", "ask_name", "file", "name", "order").join(symbols.stars, "file").join(of_module, ["file", "module"])
        out = through.where("outcome = 'external'").select("ask_file", "ask_name", "order").union(stars.where("outcome = 'external'").select("ask_file", "ask_name", "order"))
        ends = ends.union(out.select("ask_file", "ask_name", "order", F.lit("external"), F.lit(None).cast("string")))
        done = cut(ends if done is None else done.union(ends))
        steps = through.where("outcome = 'repo'").select("ask_file", "ask_name", F.col("target").alias("file"), F.col("next").alias("name"), "order")
        steps = steps.union(stars.where("outcome = 'repo'").select("ask_file", "ask_name", F.col("target").alias("file"), "name", F.concat("order", F.array(F.col("nth").cast("int")))))
        steps = steps.groupBy("ask_file", "ask_name", "file", "name").agg(F.min("order").alias("order"))
        open_ = cut(steps.join(seen, ["ask_file", "ask_name", "file", "name"], "left_anti"))
        if open_.isEmpty():
            break
        seen = cut(seen.union(open_.select("ask_file", "ask_name", "file", "name")))
    rank = F.when(F.col("outcome") == "repo", 0).when(F.col("outcome") == "external", 1).otherwise(2)
    best = done.groupBy("ask_file", "ask_name").agg(F.min(F.struct(rank.alias("r"), "order", "outcome", "key")).alias("b"))
    asked = requests.select(F.col("file").alias("ask_file"), F.col("name").alias("ask_name")).distinct()
    return asked.join(best, ["ask_file", "ask_name"], "left").select(F.col("ask_file").alias("file"), F.col("ask_name").alias("name"), F.coalesce("b.outcome", F.lit("unresolved")).alias("outcome"), F.col("b.key").alias("key"))


def _bound(symbols: Symbols, asked: DataFrame, imported: str | None = None) -> DataFrame:
    """(file, name, outcome, key) of names (file, name, module, imported, …) that are bound to modules."""
    targets = asked.join(modules(symbols, asked.select("file", "module")), ["file", "module"])
    wanted = targets.where("outcome = 'repo'").select(F.col("target").alias("file"), F.col("imported").alias("name")).distinct()
    found = exported(symbols, wanted).select(F.col("file").alias("target"), F.col("name").alias("imported"), F.col("outcome").alias("got"), "key")
    return targets.join(found, ["target", "imported"], "left").withColumn("outcome", F.when(F.col("outcome") == "external", "external").otherwise(F.coalesce("got", F.lit("unresolved")))).drop("got", "target")


def names(symbols: Symbols, requests: DataFrame) -> DataFrame:
    """(file, name, outcome, key) of names (file, name) as files use them: their own first, then what they import."""
    asked = requests.select("file", "name").distinct()
    own = asked.join(symbols.local_names.withColumnRenamed("key", "own"), ["file", "name"], "left")
    bound = _bound(symbols, cut(own.where("own is null").select("file", "name").join(symbols.imports, ["file", "name"]))).select("file", "name", F.col("outcome").alias("got"), "key")
    joined = own.join(bound, ["file", "name"], "left")
    return joined.select("file", "name", F.when(F.col("own").isNotNull(), "repo").otherwise(F.coalesce("got", F.lit("unresolved"))).alias("outcome"), F.coalesce("own", "key").alias("key"))


def members(symbols: Symbols, requests: DataFrame) -> DataFrame:
    """(file, owner, member, outcome, key) of members (file, owner, member) of classes, by the caller's name for the class."""
    owners = names(symbols, requests.select("file", F.col("owner").alias("name"))).select("file", F.col("name").alias("owner"), F.col("outcome").alias("got"), F.col("key").alias("owner_key"))
    asked = requests.select("file", "owner", "member").distinct().join(owners, ["file", "owner"])
    home = F.regexp_extract("owner_key", r"^[^:]*:(.*)#[^#]*$", 1)
    asked = asked.withColumn("home", home).withColumn("full", F.concat_ws(".", "owner", "member"))
    found = asked.join(symbols.local_names.select(F.col("file").alias("home"), F.col("name").alias("full"), "key"), ["home", "full"], "left")
    return found.select("file", "owner", "member", F.when(F.col("got") != "repo", F.col("got")).when(F.col("key").isNull(), "unresolved").otherwise("repo").alias("outcome"), "key")


def namespace_members(symbols: Symbols, requests: DataFrame) -> DataFrame:
    """(file, owner, member, outcome, key) of members of modules that are imported whole."""
    spaces = symbols.imports.where("imported = '*'").select("file", F.col("name").alias("owner"), "module")
    asked = requests.select("file", "owner", "member").distinct().join(spaces, ["file", "owner"], "left")
    bound = _bound(symbols, asked.where("module is not null").withColumn("imported", F.col("member"))).select("file", "owner", "member", "outcome", "key")
    lost = asked.where("module is null").select("file", "owner", "member", F.lit("unresolved").alias("outcome"), F.lit(None).cast("string").alias("key"))
    return bound.union(lost)


def call_targets(symbols: Symbols, sites: DataFrame, instances: DataFrame) -> DataFrame:
    """(site, outcome, key) of call sites (site, file, owner, member, inside); owner is null for plain calls, `this` inside a class.

    instances: (file, name, cls), the class of variables; names with two classes have none. Other receivers need types.
    """
    known = instances.groupBy("file", "name").agg(F.when(F.count_distinct("cls") == 1, F.min("cls")).alias("cls")).where("cls is not null").select("file", F.col("name").alias("owner"), "cls")
    spaces = symbols.imports.where("imported = '*'").select("file", F.col("name").alias("owner"), F.lit(True).alias("space"))
    c = sites.join(known, ["file", "owner"], "left").join(spaces, ["file", "owner"], "left")
    cls = F.when(F.col("owner") == "this", F.col("inside")).otherwise(F.col("cls"))
    c = cut(c.withColumn("of", cls).withColumn("shape", F.when(F.col("owner").isNull(), "name").when(F.col("space"), "space").when(cls.isNotNull(), "member").otherwise("types")))
    plain = c.where("shape = 'name'").select("site", "file", F.col("member").alias("name"))
    plain = plain.join(names(symbols, plain), ["file", "name"]).select("site", "outcome", "key")
    of_class = c.where("shape = 'member'").select("site", "file", F.col("of").alias("owner"), "member")
    of_class = of_class.join(members(symbols, of_class), ["file", "owner", "member"]).select("site", "outcome", "key")
    of_space = c.where("shape = 'space'").select("site", "file", "owner", "member")
    of_space = of_space.join(namespace_members(symbols, of_space), ["file", "owner", "member"]).select("site", "outcome", "key")
    rest = c.where("shape = 'types'").select("site", F.lit("needs-types").alias("outcome"), F.lit(None).cast("string").alias("key"))
    return plain.union(of_class).union(of_space).union(rest)


def counters(found: DataFrame) -> DataFrame:
    """(total, in_repo, external, unresolved, needs_types) of answers."""
    n = lambda o, name: F.count(F.when(F.col("outcome") == o, 1)).alias(name)
    return found.agg(F.count(F.lit(1)).alias("total"), n("repo", "in_repo"), n("external", "external"), n("unresolved", "unresolved"), n("needs-types", "needs_types"))
