"""A property graph bound to the relational test tables, and the engine's questions about it.

Functions are parts, calls are consecutive lines of large quantity in an order, models are suppliers and fields their
nations, routes are orders handled by the part of their first line, files are brands, types are part types. The SQL
twins of the queries are in `twins`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions import ids, paths, text
from ..operators import anchors as anchor_ops
from ..operators import edges as edge_ops
from ..operators import evaluate, incremental, retrieve
from ..operators import prompts as prompt_ops
from ..operators import sessions as session_ops
from ..operators.neighbourhood import neighbourhood as build_neighbourhood
from ..operators.traverse import reach_each

#: The least quantity of a line that is a call site; the name of the symbol, model and file that single questions are about.
QUANTITY, SYMBOL, MODEL, FILE = 48, "small ring", "Supplier#000000007", "Brand#1"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def call_sites(spark: SparkSession, sf_dir: str, quantity: int | None = QUANTITY) -> DataFrame:
    """Sites of calls; `quantity` is the least of a line that is one, None takes every line."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    lines = table(spark, sf_dir, "lineitem")
    if quantity is not None:
        lines = lines.where(F.col("l_quantity") >= quantity)
    sites = lines.select(
        F.col("l_partkey").alias("from_key"), F.lead("l_partkey").over(order).alias("to_key"), F.lit(None).cast("string").alias("file"), F.col("l_linenumber").alias("line"),
        (F.col("l_returnflag") == "R").alias("via_render"), (F.col("l_linestatus") == "O").alias("via_contains"),
    )
    return sites.where("to_key is not null and from_key <> to_key")


def facts(spark: SparkSession, sf_dir: str, quantity: int | None = QUANTITY) -> Facts:
    part, lines, supplier = (table(spark, sf_dir, n) for n in ("part", "lineitem", "supplier"))
    size = F.col("p_size")
    functions = part.select(
        F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_brand").alias("file"), size.alias("line"), (size + 9).alias("end_line"), (size % 2 == 0).alias("exported"),
        F.lit(False).alias("is_component"), (size % 10 == 0).alias("is_test"), F.array("p_type").alias("text"), F.concat_ws("#", "p_brand", "p_type").alias("root"),
    )
    types = part.groupBy("p_type").agg(F.min("p_brand").alias("file")).select(F.col("p_type").alias("key"), F.col("p_type").alias("name"), F.lit("interface").alias("kind"), "file", F.lit(1).alias("line"), (F.length("p_type") % 2 == 0).alias("exported"))
    first = lines.groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("f")).select(F.col("l_orderkey").alias("o_orderkey"), F.col("f.l_partkey").alias("handler_key"))
    routes = table(spark, sf_dir, "orders").join(first, "o_orderkey").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("method"), F.concat(F.lit("/orders/"), F.col("o_custkey")).alias("path"), "handler_key", F.col("o_orderstatus").alias("file"), F.lit(1).alias("line"))
    models = supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("schema").alias("file"))
    fields = supplier.join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat_ws(".", "s_name", "n_name").alias("key"), F.col("s_name").alias("model"), F.col("n_name").alias("name"), F.lit("String").alias("type"), (F.col("n_nationkey") % 5 == 0).alias("is_unique"), F.lit(False).alias("is_id")
    )
    files = part.select(F.col("p_brand").alias("key")).distinct().union(spark.createDataFrame([("schema",)], "key string")).select("key", F.col("key").alias("path"))
    calls = call_sites(spark, sf_dir, quantity)
    ends = part.select(F.col("p_partkey").alias("to_key"), F.col("p_brand").alias("to_file_key"))
    imports = calls.select("from_key", "to_key").join(part.select(F.col("p_partkey").alias("from_key"), F.col("p_brand").alias("from_file_key")), "from_key").join(ends, "to_key")
    return Facts(
        files=files, functions=functions, types=types, routes=routes, models=models, fields=fields, calls=calls,
        references=part.select(F.col("p_partkey").alias("from_key"), F.col("p_type").alias("to_key"), F.col("p_brand").alias("file"), size.alias("line")),
        touches=lines.select(F.col("l_partkey").alias("from_key"), F.col("l_suppkey").alias("model_key"), F.lit("op").alias("operation"), (F.col("l_returnflag") == "A").alias("is_write"), F.lit(None).cast("string").alias("file"), F.col("l_linenumber").alias("line")),
        imports=imports.where("from_file_key <> to_file_key").select("from_file_key", "to_file_key").distinct(),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task for each part name: the name, a type and a word of all fields."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("task")).agg(F.concat(F.col("p_name"), F.lit(" "), F.min("p_type"), F.lit(" nation")).alias("text"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, id, turn, text): items of the benchmark and user turns of conversations."""
    items = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("source"), F.col("item_id").cast("long").alias("id"), F.lit(None).cast("long").alias("turn"), "text")
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.lit("conversations"), F.col("conv_id").cast("long"), F.col("turn").cast("long"), "text")
    return items.union(turns)


def _names(df: DataFrame) -> DataFrame:
    return df.select("name").distinct()


def call_edges(spark, d):
    return retrieve.call_edges(facts(spark, d))


def touch_edges(spark, d):
    return retrieve.touch_edges(facts(spark, d))


def all_edges(spark, d):
    return edge_ops.edge_groups(facts(spark, d))


def label_counts(spark, d):
    f = facts(spark, d)
    nodes = edge_ops.node_list(f).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return nodes.union(edge_ops.edge_groups(f).groupBy("label").agg(F.count(F.lit(1)).alias("n")))


def intact_calls(spark, d):
    """Calls between exported functions: what is left when the others are no nodes."""
    f = facts(spark, d)
    kept, _ = edge_ops.intact_facts(f.replaced(functions=f.functions.where("exported")))
    return retrieve.call_edges(kept).select("src", "dst")


def dropped_edges(spark, d):
    """How many edges of each relation lack an end when only exported functions and types are nodes."""
    f = facts(spark, d)
    return edge_ops.intact_facts(f.replaced(functions=f.functions.where("exported"), types=f.types.where("exported")))[1]


def functions_named(spark, d):
    f = facts(spark, d)
    return retrieve.named(f.functions, _names(f.functions))


def direct_callers(spark, d):
    f = facts(spark, d)
    return retrieve.callers(f, f.functions.select("key"), limit=2)


def call_flags(spark, d):
    f = facts(spark, d)
    return retrieve.callees(f, f.functions.select("key"))


def routes_of_names(spark, d):
    f = facts(spark, d)
    return retrieve.routes_of_handlers(f, _names(f.functions))


def route_handlers(spark, d):
    return retrieve.route_handlers(facts(spark, d))


def touchers(spark, d):
    f = facts(spark, d)
    return retrieve.touchers(f, _names(f.models))


def type_users(spark, d):
    f = facts(spark, d)
    return retrieve.type_users(f, _names(f.types), limit=None)


def models_of_names(spark, d):
    f = facts(spark, d)
    return retrieve.models_of(f, _names(f.functions))


def exported_surface(spark, d):
    return retrieve.declared(facts(spark, d), exported=True)


def models_declared(spark, d):
    return retrieve.declared(facts(spark, d), "models")


def unique_fields(spark, d):
    return retrieve.unique_fields(facts(spark, d))


def data_of_files(spark, d):
    return retrieve.data_of_files(facts(spark, d))


def name_dependants(spark, d):
    f = facts(spark, d)
    return retrieve.dependants(f, _names(f.functions)).select("name", "total", F.array_join("files", ",").alias("files"))


def hubs(spark, d):
    """Functions that more places than one call, nesting not counted."""
    return retrieve.calling_places(facts(spark, d)).where("places > 1")


def callers(spark, d):
    """Who calls the functions of one name, by 1 to 4 calls."""
    f = facts(spark, d)
    return retrieve.callers_of(f, f.functions.where(F.col("name") == SYMBOL).select("key"), limit=None, by=("key",)).drop("truncated")


def impact(spark, d):
    return retrieve.impact(facts(spark, d), SYMBOL, limit=None, by=("key",)).drop("truncated")


def callers_of_all(spark, d):
    """Who calls each function, by 1 to 4 calls; the function itself at 0."""
    f = facts(spark, d)
    return reach_each(f.functions.select(F.col("key").alias("origin"), "key"), retrieve.call_edges(f), 4, inward=True)


def neighbourhood_of_all(spark, d):
    f = facts(spark, d)
    return reach_each(f.functions.select(F.col("key").alias("origin"), "key"), retrieve.call_edges(f), 2, both=True)


def direct_touchers(spark, d):
    f = facts(spark, d)
    return retrieve.touchers(f, f.models.where(F.col("name") == MODEL), limit=None).select("key", "name", "file", "write")


def route_to_model(spark, d):
    """Routes that reach a model by 1 to 4 calls, with handler and the function that touches it."""
    f = facts(spark, d)
    return retrieve.model_paths(f, f.models.where(F.col("name") == MODEL)).drop("truncated")


def importers(spark, d):
    f = facts(spark, d)
    return retrieve.importers(f.imports, f.files.where(F.col("key") == FILE).select("key"))


def whole_paths(spark, d):
    """All ways of 1 to 8 calls from the functions of one name."""
    f = facts(spark, d)
    found = retrieve.whole_paths(retrieve.call_edges(f), f.functions.where(F.col("name") == SYMBOL).select("key"), 8)
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def _snapshots(spark, d):
    lines = table(spark, d, "lineitem").select(F.lit("TOUCHES").alias("label"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_shipdate")
    return lines.where("l_shipdate < timestamp'1996-01-01'"), lines.where("l_shipdate >= timestamp'1995-01-01'")


def touch_delta(spark, d):
    """How the touch edges change between lines up to a date and up to a later one, when older lines go."""
    old, new = _snapshots(spark, d)
    return edge_ops.delta(old, new, ("src", "dst"))


def write_plan(spark, d):
    return edge_ops.write_plan(*_snapshots(spark, d), most=1 << 30)


def write_plan_capped(spark, d):
    return edge_ops.write_plan(*_snapshots(spark, d))


def pruned_nodes(spark, d):
    """What becomes of suppliers that are only in the older lines, and of parts that are not small any more."""
    part = table(spark, d, "part")
    node = lambda df: df.select(F.lit("Function").alias("label"), F.col("p_partkey").cast("string").alias("key"))
    return edge_ops.pruned(node(part), node(part.where("p_size > 1")))


def changed_functions(spark, d):
    """Functions that differ from a snapshot in which two files were unlike today's."""
    f = facts(spark, d).functions.select("key", "name", "file", "exported", "text")
    before = f.where(F.col("file") != "Brand#3").withColumn("exported", F.when(F.col("file") == "Brand#5", ~F.col("exported")).otherwise(F.col("exported")))
    return edge_ops.changed_rows(f, before).select("key", "name")


def first_of_each_name(spark, d):
    return edge_ops.first_of_each(facts(spark, d).functions.select("name", "key", "file"), "name", "key")[0]


def merged_types(spark, d):
    """Types declared more than once in a file are one: exported if any is, at the first place."""
    part = table(spark, d, "part")
    return part.groupBy(F.col("p_brand").alias("file"), F.col("p_type").alias("name")).agg(F.bool_or(F.col("p_size") % 2 == 0).alias("exported"), F.min("p_size").alias("line"), F.count(F.lit(1)).alias("declarations"))


def rarity_weights(spark, d):
    found = anchor_ops.rarity_weights(facts(spark, d), anchor_ops.terms_of(tasks(spark, d)))
    return found.withColumn("weight", F.round("weight", 6))


def anchor_scores(spark, d):
    return anchor_ops.scores(facts(spark, d), tasks(spark, d)).withColumn("score", F.round("score", 6))


def anchors(spark, d):
    return anchor_ops.anchors(facts(spark, d), tasks(spark, d)).select("task", "rank", "key", "kind", F.round("score", 6).alias("score"))


def search_view(spark, d):
    return anchor_ops.search_view(facts(spark, d), tasks(spark, d)).select("task", "nth", "key", "kind")


def neighbourhood(spark, d):
    """Members of the boundary of each task."""
    f = facts(spark, d)
    return build_neighbourhood(f, anchor_ops.anchors(f, tasks(spark, d))).members.select("task", "key", "distance", "reason", "core")


def boundary_models(spark, d):
    f = facts(spark, d)
    return build_neighbourhood(f, anchor_ops.anchors(f, tasks(spark, d))).models.select("task", "name", "via", "core")


def prompt_terms(spark, d):
    """Terms without stop words of items of the benchmark."""
    return table(spark, d, "benchmark").select("item_id", F.explode(text.task_terms(F.col("text"), text.STOP_WORDS)).alias("term"))


def all_prompt_terms(spark, d):
    """Terms without stop words of all prompts."""
    return prompts(spark, d).select("source", "id", "turn", F.explode(text.task_terms(F.col("text"), text.STOP_WORDS)).alias("term")).distinct()


def prompt_features(spark, d):
    t = F.col("text")
    return prompts(spark, d).select("source", "id", "turn", text.is_question(t).alias("question"), F.array_join(text.quoted_phrases(t), "|").alias("quoted"), F.array_join(text.named_paths(t), "|").alias("paths"))


def name_index(spark, d):
    return prompt_ops.name_index(facts(spark, d)).groupBy("name", "kind", "file").agg(F.count(F.lit(1)).alias("n"))


def prompt_verdicts(spark, d):
    """What the task of each part name is to the boundary of the task of the next one, in order of names."""
    f, t = facts(spark, d), tasks(spark, d)
    found = anchor_ops.anchors(f, t)
    around = prompt_ops.boundary(build_neighbourhood(f, found).members, found)
    following = t.withColumn("next", F.lead("task").over(Window.partitionBy(F.substring("task", 1, 1)).orderBy("task"))).where("next is not null")
    asked = following.select(F.col("task").alias("prompt"), F.col("next").alias("task"), "text")
    found = prompt_ops.verdicts(asked, prompt_ops.name_index(f), around)
    return found.select("prompt", "task", "verdict", F.array_join("inside", ",").alias("inside"), F.array_join("outside", ",").alias("outside"), F.array_join("focused", ",").alias("focused"))


def hash_ids(spark, d):
    part = table(spark, d, "part")
    key = ids.node_key("sf", "function", F.col("p_brand"), F.concat_ws(".", "p_name", "p_partkey"))
    return part.select("p_partkey", key.alias("key")).select("p_partkey", "key", ids.hash_id(F.col("key")).alias("id"), ids.repo_of(F.col("key")).alias("repo"), ids.repo_id(F.col("key")).alias("short"))


def id_collisions(spark, d):
    """Ids that two keys share; there are none."""
    return ids.collisions(hash_ids(spark, d)).select("id", F.array_join("keys", ",").alias("keys"))


def url_paths(spark, d):
    """Urls read as files of routes: their path, and what kind of file they look like."""
    inner = F.regexp_extract("url", "^[a-z]+://[^/]*/([^?#]*)", 1)
    file = F.concat(F.lit("src/app/("), F.regexp_extract("url", "^([a-z]+)", 1), F.lit(")/"), inner, F.lit("/route.ts"))
    shown = table(spark, d, "pages").select("page_id", "url", file.alias("file"))
    return shown.select("page_id", paths.route_path(F.col("file")).alias("path"), paths.is_route_file(F.col("file")).alias("route"), paths.normalise_path(F.col("url"), F.lit("http://")).alias("relative"), paths.import_target(F.col("file"), F.lit("../x.ts")).alias("target"))


def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", paths.content_hash(F.col("text")).alias("hash"))


def user_texts(spark, d):
    """Lines of documents that read like messages to people."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    return lines.where(paths.is_user_text(F.col("value"))).select("doc_id", "line")


def nearest_member(spark, d):
    """The nearest member of a boundary in each file, and how far the boundary goes."""
    f = facts(spark, d)
    members = build_neighbourhood(f, anchor_ops.anchors(f, tasks(spark, d))).members
    near = members.groupBy("task", "file").agg(F.min(F.struct("distance", "name", "key")).alias("n"), F.max("distance").alias("farthest"))
    return near.select("task", "file", F.col("n.key").alias("key"), F.col("n.distance").alias("distance"), "farthest")


QUERIES = {
    f.__name__: f
    for f in (
        call_edges, touch_edges, all_edges, label_counts, intact_calls, dropped_edges, functions_named, direct_callers, call_flags, routes_of_names, route_handlers, touchers, type_users,
        models_of_names, exported_surface, models_declared, unique_fields, data_of_files, name_dependants, hubs, callers, impact, callers_of_all, neighbourhood_of_all, direct_touchers,
        route_to_model, importers, whole_paths, touch_delta, write_plan, write_plan_capped, pruned_nodes, changed_functions, first_of_each_name, merged_types, rarity_weights, anchor_scores,
        anchors, search_view, neighbourhood, boundary_models, prompt_terms, all_prompt_terms, prompt_features, name_index, prompt_verdicts, hash_ids, id_collisions, url_paths,
        content_hashes, user_texts, nearest_member,
    )
}


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of sessions: sign-ups open tasks, clicks change files, errors challenge and purchases justify them."""
    kinds = F.create_map(*[F.lit(x) for x in ("signup", "open", "click", "change", "error", "challenge", "purchase", "justify", "view", "turn")])
    k = F.get_json_object("props", "$.k").cast("int")
    e = table(spark, sf_dir, "events").withColumn("ts", F.concat(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit("Z")).cast("timestamp"))
    return e.select(
        F.col("user_id").alias("session"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), kinds[F.col("event_type")].alias("kind"),
        F.concat(F.lit("f"), k % 7, F.when(k % 5 == 0, ".md").otherwise(".ts")).alias("file"), (F.unix_millis("ts") - F.floor(F.col("value") * 100000)).cast("long").alias("mtime_ms"), (k % 3).cast("long").alias("size"), (k % 11 != 0).alias("exists"),
    )


def session_changes(spark, d):
    return session_ops.detected(session_events(spark, d))


def session_marks(spark, d):
    return session_ops.marks(session_events(spark, d))


def unseen_changes(spark, d):
    return session_ops.unseen(session_events(spark, d))


def prompt_actions(spark, d):
    """User turns as prompts of sessions: equal first words are one prompt id."""
    turns = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session"), F.col("turn").alias("at"), F.substring("text", 1, 2).alias("prompt_id"), "text", F.when(F.length("text") % 2 == 0, "SAME").otherwise("WIDENED").alias("verdict"))
    return session_ops.prompt_actions(turns).select("session", F.col("at").alias("turn"), "action")


def changed_line_owners(spark, d):
    """Line numbers of orders as changed lines of files: the innermost function around each."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") + 1).cast("int").alias("line"), F.concat(F.lit("Brand#"), (F.col("l_suppkey") % 25 + 1).cast("string")).alias("file"))
    found = evaluate.owners(lines.select("file", "line").distinct(), facts(spark, d).functions)
    return found.select("file", "line", "key")


def boundary_recall(spark, d):
    """How much of each task's own functions that are exported its boundary holds."""
    f, t = facts(spark, d), tasks(spark, d)
    members = build_neighbourhood(f, anchor_ops.anchors(f, t)).members
    cases = f.functions.where("exported").select(F.col("name").alias("task"), "key")
    found = evaluate.summary(evaluate.case_recalls(f, cases, members))
    return found.select("cases", F.round("recall", 6).alias("recall"), F.round("median_area", 6).alias("median_area"), F.round("worst_area", 6).alias("worst_area"), "perfect", "passes")


def changed_files(spark, d):
    """Files whose functions are others than in a snapshot without large parts."""
    part = table(spark, d, "part")
    hashed = lambda df: df.groupBy(F.col("p_brand").alias("path")).agg(F.md5(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", F.lpad(F.col("p_partkey").cast("string"), 12, "0"), "p_name"))), ",")).alias("hash"))
    return incremental.changes(hashed(part.where("p_brand <> 'Brand#7' and p_size < 50")), hashed(part.where("p_brand <> 'Brand#9'")))


QUERIES |= {f.__name__: f for f in (session_changes, session_marks, unseen_changes, prompt_actions, changed_line_owners, boundary_recall, changed_files)}
