"""Verdicts on proposed changes of files, against the boundary of the task that they are made for.

Many changes of many tasks are judged at once: what the graph, the boundary and the proposed content say about each
is joined to it as features, and one ordered CASE decides. A change is (intent, task, operation, file, whole, pending,
forced): operation is edit, create or delete; whole tells that the proposed content is the entire file; pending holds
what was read from it, null where there is no content; forced are files of routes that are settled already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions.paths import is_analysed, names_file, path_terms
from ..functions.text import named_paths
from . import retrieve
from .neighbourhood import Neighbourhood, model_overlap
from .traverse import cut

PENDING = (
    "struct<calls:array<string>, imports:array<string>, touches:array<string>, route_methods:array<string>, route_path:string, exported:array<string>, "
    "is_test:boolean, parse_error:string, syntax_errors:int>"
)
INTENT = f"intent long, task string, operation string, file string, whole boolean, pending {PENDING}, forced array<string>"
MUTATING = ("POST", "PUT", "PATCH", "DELETE")
EXPECTED, CONNECTED, NOT_JUDGED, SUSPICIOUS, REVIEW = "EXPECTED", "CONNECTED", "NOT_JUDGED", "SUSPICIOUS", "HUMAN_REVIEW"


def is_challenge(decision: Column) -> Column:
    return decision.isin(SUSPICIOUS, REVIEW)


def _schemas(facts: Facts, changes: DataFrame, hood: Neighbourhood) -> DataFrame:
    """(intent, declared, declared_core): models that a file declares, and those the task is about."""
    declared = retrieve.declared(facts, "models").select(F.col("path").alias("file"), F.col("name").alias("model"))
    core = hood.models.where("core").select("task", F.col("name").alias("model"), F.lit(True).alias("core"))
    found = changes.select("intent", "task", "file").join(declared, "file").join(core, ["task", "model"], "left")
    return found.groupBy("intent").agg(F.sort_array(F.collect_set("model")).alias("declared"), F.sort_array(F.collect_set(F.when(F.col("core"), F.col("model")))).alias("declared_core"))


def _near(changes: DataFrame, members: DataFrame) -> DataFrame:
    """(intent, near, near_names): the nearest member in the file, and what four members say."""
    found = changes.select("intent", "task", "file").join(members.select("task", "file", "distance", "name", "key", "reason"), ["task", "file"])
    said = F.concat("name", F.lit(" (distance "), "distance", F.lit(") — "), "reason")
    listed = F.slice(F.sort_array(F.collect_list(F.struct("distance", "name", said.alias("said")))), 1, 4)
    return found.groupBy("intent").agg(F.min(F.struct("distance", "name", "key")).alias("near"), F.transform(listed, lambda x: x["said"]).alias("near_said"))


def _outside(facts: Facts, changes: DataFrame, hood: Neighbourhood) -> DataFrame:
    """(intent, functions, link): names that the file declares, and one call between them and the task."""
    declared = cut(changes.select("intent", "task", "file").join(retrieve.declared(facts).withColumnRenamed("path", "file"), "file"))
    names = declared.groupBy("intent").agg(F.sort_array(F.collect_list("name")).alias("functions"))
    edges = retrieve.call_edges(facts).select("src", "dst")
    inside = hood.members.select("task", F.col("key").alias("member"), F.col("name").alias("member_name"))
    own = declared.select("intent", "task", "key", "name")
    out = own.join(edges, F.col("key") == F.col("src")).join(inside.withColumnRenamed("task", "_t"), (F.col("dst") == F.col("member")) & (F.col("task") == F.col("_t"))).withColumn("way", F.lit("calls"))
    back = own.join(edges, F.col("key") == F.col("dst")).join(inside.withColumnRenamed("task", "_t"), (F.col("src") == F.col("member")) & (F.col("task") == F.col("_t"))).withColumn("way", F.lit("is called by"))
    met = out.select("intent", "name", "way", "member_name").union(back.select("intent", "name", "way", "member_name"))
    link = met.groupBy("intent").agg(F.min(F.struct("name", "way", "member_name")).alias("l")).select("intent", F.concat_ws(" ", "l.name", "l.way", "l.member_name").alias("link"))
    return names.join(link, "intent", "left")


def _shrinking(facts: Facts, changes: DataFrame) -> DataFrame:
    """(intent, removed, dependants, callers): exported names that whole, clean edits drop, and who calls them."""
    edits = changes.where("operation = 'edit' and whole and pending is not null and pending.parse_error is null and pending.syntax_errors = 0 and not pending.is_test").where(is_analysed(F.col("file")))
    before = retrieve.declared(facts, exported=True).where(~F.contains("name", F.lit("."))).select(F.col("path").alias("file"), "name")
    gone = cut(edits.select("intent", "file", F.coalesce("pending.exported", F.array().cast("array<string>")).alias("now")).join(before, "file").where(~F.array_contains("now", F.col("name"))).select("intent", "name").distinct())
    ranked = gone.withColumn("nth", F.row_number().over(Window.partitionBy("intent").orderBy("name")))
    using = retrieve.dependants(facts, gone.select("name"))
    used = ranked.where("nth <= 4").join(using, "name").groupBy("intent").agg(F.sum("total").alias("dependants"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))), 1, 3).alias("callers"))
    return gone.groupBy("intent").agg(F.sort_array(F.collect_list("name")).alias("removed")).join(used, "intent")


def _reach(changes: DataFrame, hood: Neighbourhood) -> DataFrame:
    """(intent, calls, imports, touched): what new content takes from the task's members and models."""
    sides = hood.members.groupBy("task").agg(F.collect_set("name").alias("names"), F.collect_set(F.regexp_replace("file", r"\.(ts|tsx)$", "")).alias("bases"))
    models = hood.models.groupBy("task").agg(F.collect_set(F.lower("name")).alias("models"))
    all_ = changes.where("pending is not null").join(sides, "task", "left").join(models, "task", "left")
    none = F.array().cast("array<string>")
    of = lambda c, within: F.coalesce(F.filter(F.coalesce(F.col(f"pending.{c}"), none), lambda x: F.array_contains(F.coalesce(F.col(within), none), F.lower(x) if within == "models" else x)), none)
    return all_.select("intent", of("calls", "names").alias("calls"), of("imports", "bases").alias("imports"), F.array_distinct(of("touches", "models")).alias("touched"))


def pending_reaches(facts: Facts, changes: DataFrame) -> DataFrame:
    """(intent, nth, model, via): models that new content touches; if none, those that functions of imported files touch."""
    own = changes.where("pending is not null").select("intent", F.posexplode("pending.touches").alias("nth", "model")).withColumn("via", F.lit(None).cast("string"))
    imported = changes.where("pending is not null and size(coalesce(pending.touches, array())) = 0").select("intent", F.posexplode("pending.imports").alias("nth", "base"))
    paths = imported.select("intent", "nth", F.posexplode(F.array(F.concat("base", F.lit(".ts")), F.concat("base", F.lit(".tsx")), F.concat("base", F.lit("/index.ts")))).alias("try", "path"))
    reached = paths.join(retrieve.data_of_files(facts).drop("truncated"), "path")
    first = reached.groupBy("intent", "model").agg(F.min(F.struct("nth", "try", "path")).alias("f"))
    order = F.row_number().over(Window.partitionBy("intent").orderBy("f.nth", "f.try", "model")) - 1
    return own.select("intent", "nth", "model", "via").union(first.select("intent", order.alias("nth"), "model", F.col("f.path").alias("via")))


def duplicate_flows(facts: Facts, changes: DataFrame, hood: Neighbourhood, tasks: DataFrame) -> DataFrame:
    """(intent, flow_kind, flow_model, flow_entry, flow_path, flow_note, flow_via): for new routes that reach one of the task's
    models, the path by which a route in scope reaches it already.

    Where a unique field of the model is a word of the task, paths that write come first, else those of the same method.
    """
    new = changes.where("size(coalesce(pending.route_methods, array())) > 0")
    known = hood.models.select("task", F.col("name").alias("known"))
    reached = pending_reaches(facts, new).join(new.select("intent", "task", "pending.route_methods", "pending.route_path", "forced"), "intent")
    reached = cut(reached.join(known.withColumnRenamed("task", "_t"), (F.col("task") == F.col("_t")) & (F.lower("known") == F.lower("model"))).drop("_t"))
    flows = retrieve.model_paths(facts, reached.select(F.col("known").alias("name")).distinct(), limit=50).select(F.col("model").alias("known"), "route", "method", "path", F.col("handler").alias("h"), F.col("reacher").alias("r"), "write")
    who = facts.functions.select("key", "name")
    flows = flows.join(who.select(F.col("key").alias("h"), F.col("name").alias("handler")), "h").join(who.select(F.col("key").alias("r"), F.col("name").alias("reacher")), "r")
    flows = flows.join(facts.routes.select(F.col("key").alias("route"), F.col("file").alias("route_file")), "route")
    members = hood.members.select(F.col("task").alias("_t"), F.col("name").alias("_n")).distinct()
    met = reached.join(flows, "known").where(~F.coalesce(F.array_contains("forced", F.col("route_file")), F.lit(False)))
    met = met.join(members, (F.col("task") == F.col("_t")) & (F.col("handler") == F.col("_n"))).drop("_t", "_n")
    unique = retrieve.unique_fields(facts).groupBy(F.col("model").alias("known")).agg(F.sort_array(F.collect_list("name")).alias("fields"))
    met = met.join(unique, "known", "left").join(tasks.select("task", "terms"), "task", "left")
    none = F.array().cast("array<string>")
    terms = F.coalesce("terms", none)
    fields = F.filter(F.coalesce("fields", none), lambda f: F.exists(terms, lambda t: F.contains(F.lower(f), t)))
    met = met.withColumn("wanted", fields)
    enforced = F.size("wanted") > 0
    said = F.lower(F.concat_ws(" ", "path", "handler", "reacher"))
    method = F.upper("method")
    first = F.when(enforced, F.when(F.col("write"), 0).when(F.col("write").isNull(), 1).otherwise(2)).otherwise(F.when(F.array_contains(F.transform("route_methods", F.upper), method), 0).otherwise(1))
    second = F.when(enforced & ~method.isin(*MUTATING), 1).otherwise(0)
    relevance = F.when(F.contains(said, F.lower("known")), 3).otherwise(0) + F.size(F.filter(terms, lambda t: (F.length(t) >= 3) & F.contains(said, t)))
    order = F.struct(F.col("nth"), first.alias("a"), second.alias("b"), (-relevance).alias("c"), F.col("path"), F.col("handler"), F.col("reacher"), F.col("method"), F.col("write"))
    picked = met.groupBy("intent").agg(F.min_by(F.struct("known", "method", "path", "handler", "reacher", "write", "wanted", "route_methods", "route_path", "via"), order).alias("p")).select("intent", "p.*")
    entry = F.concat_ws(" ", "method", "path")
    how = F.when(F.col("write"), F.lit(" and a duplicate is rejected when that path writes it")).when(~F.col("write"), F.lit(" — that path reads it rather than writing it, and the constraint is enforced wherever the write happens")).otherwise(F.lit(""))
    note = F.when(F.size("wanted") > 0, F.concat(F.lit(", where "), "known", F.lit("."), F.col("wanted")[0], F.lit(" is unique"), how)).otherwise(F.lit(""))
    return picked.select(
        "intent", F.concat(F.array_join("route_methods", "/"), F.lit(" endpoint at "), F.coalesce("route_path", F.lit(""))).alias("flow_kind"), F.col("known").alias("flow_model"), entry.alias("flow_entry"),
        F.concat_ws(" → ", entry, "handler", "reacher", "known").alias("flow_path"), note.alias("flow_note"), F.col("via").alias("flow_via"),
    )


def verdicts(facts: Facts, hood: Neighbourhood, tasks: DataFrame, changes: DataFrame) -> DataFrame:
    """(intent, task, file, decision, rule, reason, question, needs_judge, evidence); tasks are (task, text, terms).

    `rule` names the branch that decided.
    """
    c = cut(changes)
    known = c.select("file").distinct().join(facts.files.select(F.col("path").alias("file"), F.lit(True).alias("in_graph")), "file")
    own = retrieve.declared(facts).select(F.col("path").alias("file"), "key")
    overlap = model_overlap(facts, c.select("task", "file").distinct().join(own, "file"), hood.models)
    core = hood.models.where("core").groupBy("task").agg(F.sort_array(F.collect_set("name")).alias("core_models"))
    d = c.join(tasks.select("task", F.col("text").alias("said"), "terms"), "task", "left").join(known, "file", "left").join(core, "task", "left").join(overlap, ["task", "file"], "left")
    for features in (_schemas(facts, c, hood), _near(c, hood.members), _outside(facts, c, hood), _shrinking(facts, c), _reach(c, hood), duplicate_flows(facts, c, hood, tasks)):
        d = d.join(features, "intent", "left")
    none = F.array().cast("array<string>")
    for column in ("declared", "declared_core", "functions", "removed", "calls", "imports", "touched", "shared", "foreign", "core_models", "near_said", "callers", "terms"):
        d = d.withColumn(column, F.coalesce(F.col(column), none))
    n = lambda column: F.size(F.col(column))
    few = lambda column, most: F.array_join(F.slice(column, 1, most), ", ")
    file, pending = F.col("file"), F.col("pending")
    d = d.withColumn("matched", path_terms(file, F.col("terms")))
    base = F.substring_index(F.lower("file"), "/", -1)
    named = F.exists(named_paths(F.coalesce("said", F.lit(""))), lambda p: F.endswith(F.lower("file"), p) | (p == base))
    schema = F.endswith("file", F.lit(".prisma")) & (n("declared") > 0)
    unread = ~is_analysed(file) & F.col("in_graph").isNull()
    member, missing = F.col("near").isNotNull(), pending.isNull()
    known_code = F.col("in_graph").isNotNull() & (n("functions") > 0) & ~member
    places = F.when(F.col("dependants") == 1, " place").otherwise(" places")
    connected = (n("calls") > 0) | (n("imports") > 0) | (n("touched") > 0)
    took = F.concat_ws(
        "; ", F.when(n("calls") > 0, F.concat(F.lit("calls "), n("calls"), F.lit(" function(s) in scope"))), F.when(n("imports") > 0, F.concat(F.lit("imports "), n("imports"), F.lit(" file(s) in scope"))),
        F.when(n("touched") > 0, F.concat(F.lit("touches "), few("touched", 99))),
    )
    foreign = F.when(n("foreign") > 0, F.concat(F.lit(", and it works on "), few("foreign", 99))).otherwise(F.lit(""))
    said = F.coalesce("said", F.lit(""))
    T = F.lit
    why = F.concat(T('Why does "'), said, T('" require a change in '), file, T("?"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else T(p) for p in parts])
    distance, nearest = F.col("near.distance"), F.col("near.name")
    note = lambda kind, when, said_: F.when(when, F.struct(T(kind).alias("kind"), said_.alias("text")))
    reach_notes = [
        note("path", n("calls") > 0, text("calls ", few("calls", 99))), note("path", n("imports") > 0, text("imports ", few("imports", 99))), note("model", n("touched") > 0, text("touches ", few("touched", 99))),
    ]
    members_said = F.transform("near_said", lambda x: F.struct(T("member").alias("kind"), x.alias("text")))
    declares = text("declares ", few("functions", 4))
    rules = [
        ("schema of the task", schema & (n("declared_core") > 0), EXPECTED, text(file, " declares ", few("declared_core", 99), ", which is the data this task is about."), None, [note("model", T(True), text("declares ", few("declared_core", 99)))]),
        ("schema", schema, NOT_JUDGED, text(file, " declares ", few("declared", 4), ", and this task is about ", F.coalesce(F.nullif(few("core_models", 3), T("")), T("no particular model")), "."), None, [note("model", T(True), text("declares ", few("declared", 6)))]),
        ("path of the task", unread & (n("matched") > 0), CONNECTED, text(file, " is not code that is read, but its path matches the task (", few("matched", 4), ")."), None, [note("note", T(True), text("path matches: ", few("matched", 4)))]),
        ("unread", unread, NOT_JUDGED, text(file, " is not a file that is read, so there is no view on this change."), None, [note("note", T(True), T("nothing in the graph describes it"))]),
        (
            "shrinking surface", (F.col("dependants") > 0) & ~named, SUSPICIOUS, text(file, " stops exporting ", few("removed", 3), ", and ", F.col("dependants"), places, " in the codebase call it. The task never named this file."),
            text('"', said, '" does not mention ', file, ". Removing ", few("removed", 3), " changes what ", F.col("dependants"), " other", places, " depend on — is that part of this task?"),
            [note("note", T(True), text("no longer exported: ", few("removed", 99))), note("path", T(True), text("called from ", few("callers", 3)))],
        ),
        ("one hop", known_code & F.col("link").isNotNull(), CONNECTED, text(file, " is not part of the task, but ", F.col("link"), ", which is."), None, [note("note", T(True), declares), note("member", T(True), F.col("link"))]),
        ("outside", known_code, SUSPICIOUS, text(file, " exists in the codebase but nothing in it is reachable from the task", foreign, "."), why, [note("note", T(True), declares), note("note", T(True), T("no function in this file is reachable from the task")), note("model", n("foreign") > 0, text("works on ", few("foreign", 99)))]),
        ("core", member & (distance <= 0), EXPECTED, text(file, " is part of the task neighbourhood (", nearest, ", distance ", distance, ")."), None, "members"),
        ("same data", member & (n("shared") > 0), CONNECTED, text(file, " is ", distance, " hops from the task but works on the same data (", few("shared", 99), ")."), None, "members"),
        ("other data", member & (n("foreign") > 0), SUSPICIOUS, text(file, " is reachable from the task only through ", nearest, " (distance ", distance, "), and it operates on ", few("foreign", 99), " rather than the data this task is about."), why, "members"),
        ("near", member, CONNECTED, text(file, " is ", distance, " hops from the task via ", nearest, "."), None, "members"),
        ("no content of an unread kind", missing & ~is_analysed(file), NOT_JUDGED, text(file, " is not a file type that is analysed, so there is no basis to judge it."), None, [note("note", T(True), T("outside the analysed file types"))]),
        ("no content", missing, REVIEW, text(file, " is not in the graph and no content was provided, so it cannot be assessed."), text("What is ", file, ' for, and how does it serve "', said, '"?'), [note("note", T(True), T("no content available for a file outside the graph"))]),
        ("parse error", F.col("pending.parse_error").isNotNull(), CONNECTED, text(file, " could not be parsed, so it is let through."), None, [note("note", T(True), text("could not parse: ", F.col("pending.parse_error")))]),
        ("test", F.col("pending.is_test"), EXPECTED, text(file, " is a test. Adding tests for a fix is expected."), None, [note("note", T(True), T("test files are always in scope"))]),
        (
            "duplicate flow", F.col("flow_path").isNotNull(), SUSPICIOUS,
            text(file, " introduces a new ", F.col("flow_kind"), " that reaches ", F.col("flow_model"), F.coalesce(F.concat(T(" through "), F.col("flow_via")), T("")), ", but the task's existing path already reaches it: ", F.col("flow_path"), "."),
            text("The existing ", F.col("flow_entry"), " already reaches ", F.col("flow_model"), F.col("flow_note"), ". Why is a separate ", F.col("flow_kind"), " required?"), [*reach_notes, note("existing-flow", T(True), F.col("flow_path"))],
        ),
        ("reaches the task", connected, CONNECTED, text(file, " is new but connects to the task (", took, ")."), None, reach_notes),
        ("named", names_file(said, file), EXPECTED, text(file, " is named in the task itself."), None, [note("note", T(True), T("the task names this file directly"))]),
        ("unconnected", T(True), SUSPICIOUS, text(file, " is new and no connection to the task was found."), text("How does ", file, ' serve "', said, '"?'), [note("note", T(True), T("no imports or calls reach the task neighbourhood"))]),
    ]
    struct = "array<struct<kind:string,text:string>>"
    decided = None
    for rule, when, decision, reason, question, evidence in rules:
        said_ = members_said.cast(struct) if evidence == "members" else F.filter(F.array(*evidence), lambda x: x.isNotNull()).cast(struct)
        row = F.struct(T(rule).alias("rule"), T(decision).alias("decision"), reason.alias("reason"), (question if question is not None else T(None)).cast("string").alias("question"), said_.alias("evidence"))
        decided = F.when(when, row) if decided is None else decided.when(when, row)
    judged = SUSPICIOUS
    return d.withColumn("v", decided).select("intent", "task", "file", "v.decision", "v.rule", "v.reason", "v.question", (F.col("v.decision") == judged).alias("needs_judge"), "v.evidence")


def expansion(requests: DataFrame, per_task: int = 25, per_file: int = 2) -> DataFrame:
    """(…, granted, why): requests (task, file, at, decision, opinion) to widen a task, in order of `at`.

    What the graph finds EXPECTED or CONNECTED is granted; else an opinion counts, as long as the task and the file have
    calls left; no opinion and a decision for people never grant.
    """
    asks = ~F.col("decision").isin(EXPECTED, CONNECTED)
    before = lambda *by: F.coalesce(F.sum(F.when(asks, 1).otherwise(0)).over(Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = requests.withColumn("_task", before("task")).withColumn("_file", before("task", "file"))
    spent = (F.col("_task") >= per_task) | (F.col("_file") >= per_file)
    why = F.when(~asks, "graph").when(spent, "budget").when(F.col("opinion").isNull(), "no opinion").otherwise("opinion")
    granted = ~asks | (~spent & F.coalesce(F.col("opinion").isin("SUPPORTED_EXPANSION", EXPECTED), F.lit(False)))
    return r.withColumn("granted", granted).withColumn("why", why).drop("_task", "_file")
