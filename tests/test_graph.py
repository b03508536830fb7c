import golden
import pytest
from pyspark.sql import functions as F

from graphquarry import facts as fact_tables
from graphquarry.functions.text import matches, own_name, task_terms
from graphquarry.operators import anchors as anchor_ops
from graphquarry.operators import edges as edge_ops
from graphquarry.operators import prompts as prompt_ops
from graphquarry.operators import retrieve
from graphquarry.operators.neighbourhood import Bounds, listing, model_overlap, neighbourhood
from graphquarry.operators.traverse import reach, reach_each
from graphquarry.plans import testgraph, twins


@pytest.fixture(scope="module")
def demo(spark):
    return golden.facts(spark)


def names(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "name string")


@pytest.mark.parametrize("name", sorted(twins.SQL))
def test_query_equals_sql(same_as_sql, name):
    same_as_sql(name)


def test_every_query_has_a_twin_or_a_test():
    assert set(testgraph.QUERIES) - set(twins.SQL) == {"search_view", "prompt_verdicts"}


def test_golden_edges(spark, demo):
    edges = edge_ops.edge_groups(demo)
    assert {r.label: r["count"] for r in edges.groupBy("label").count().collect()} == {"CALLS": 12, "TOUCHES": 8, "HANDLED_BY": 2, "HAS_FIELD": 23, "DECLARES": 33, "IMPORTS": 11, "REFERENCES": 13}
    flags = {(r.render, r.contains): r["count"] for r in edges.where("label = 'CALLS'").groupBy("render", "contains").count().collect()}
    assert flags == {(False, False): 9, (False, True): 2, (True, False): 1}
    assert edges.where("write").count() == 3
    kept, dropped = edge_ops.intact_facts(demo)
    assert {r.dropped for r in dropped.collect()} == {0}
    assert edge_ops.difference(edge_ops.edge_groups(kept), edges).isEmpty()
    less, dropped = edge_ops.intact_facts(demo.replaced(functions=demo.functions.where("name <> 'showToast'")))
    assert {r.relation: r.dropped for r in dropped.collect()} == {"calls": 2, "references": 2, "touches": 0, "imports": 0, "routes": 0}
    assert not edge_ops.difference(edge_ops.edge_groups(less), edges).isEmpty()


def test_golden_answers(spark, demo):
    paths = retrieve.model_paths(demo, names(spark, "Vendor", "Invoice")).collect()
    own = lambda key: key.split("#")[1]
    assert {(r.method, r.path, own(r.handler), own(r.reacher)) for r in paths} == {("POST", "/api/vendors", "POST", "createVendor"), ("GET", "/api/vendors", "GET", "listVendors")}
    assert retrieve.model_paths(demo, names(spark, "Vendor"), route="/orders").isEmpty()
    seeds = lambda name: demo.functions.where(F.col("name") == name).select("key")
    found = lambda name, **k: {(r.name, r.relation) for r in retrieve.callers_of(demo, seeds(name), **k).collect()}
    assert found("createVendor") == {("POST", "direct")}
    assert found("showToast") == {("submitVendor", "direct"), ("VendorForm.handleSubmit", "indirect"), ("VendorForm", "indirect"), ("NewVendorPage", "indirect")}
    assert found("showToast", limit=1) == {("submitVendor", "direct")}
    assert {r.truncated for r in retrieve.callers_of(demo, seeds("requireSession"), limit=1).collect()} == {True}
    whole = retrieve.impact(demo, "createVendor").collect()
    assert {(r.part, r.name or r.file) for r in whole} == {("kind", "function"), ("declared", "src/lib/vendors/create.ts"), ("caller", "POST"), ("model", "Vendor")}
    assert {r.name for r in retrieve.impact(demo, "NewVendor").collect() if r.part == "dependant"} == {"createVendor", "submitVendor", "POST", "VendorForm", "VendorForm.set"}
    assert [r.name for r in retrieve.impact(demo, "nothing").collect()] == ["unknown"]
    assert {(r.name, r.total, tuple(r.files)) for r in retrieve.dependants(demo, names(spark, "requireSession")).collect()} == {("requireSession", 2, ("src/app/api/vendors/route.ts",))}
    changed = spark.createDataFrame([("r|file:src/lib/vendors/create.ts",)], "key string")
    assert {(r.key.split(":")[1], r.distance) for r in retrieve.importers(demo.imports, changed).collect()} == {
        ("src/lib/vendors/create.ts", 0), ("src/lib/vendors/submit.ts", 1), ("src/app/api/vendors/route.ts", 1), ("src/components/VendorForm.tsx", 1), ("src/app/vendors/new/page.tsx", 2),
    }
    hop = retrieve.one_hop(demo, seeds("getSession"), seeds("requireSession")).collect()
    assert [(own(r.key), own(r.member), r.direction) for r in hop] == [("getSession", "requireSession", "is called by")]


def test_golden_boundary(spark, demo):
    task = spark.createDataFrame([("t", "duplicate email when creating a vendor")], "task string, text string")
    found = anchor_ops.anchors(demo, task)
    scored = {r.name: r.score for r in anchor_ops.scores(demo, task).collect()}
    assert scored["POST /api/vendors"] == 4.0 and scored["Vendor"] == 3.0 and scored["User.email"] == 1.0
    best = {r.name: r.score for r in found.collect()}  # those below 0.15 of 29.952 are out
    assert abs(best["submitVendor"] - 29.952) < 1e-9 and best["Vendor.email"] == 7.0 and not {"POST /api/vendors", "Vendor", "User.email"} & set(best)
    around = neighbourhood(demo, found)
    members = {r.name: r for r in around.members.collect()}
    assert members["createVendor"].distance == 0 and members["requireSession"].distance == 1 and "markInvoicePaid" not in members
    assert {r.name: r.core for r in around.models.collect()}["Vendor"] is True
    assert [r.members for r in around.stats.collect()] == [len(members)]
    assert listing(around.members, 2).count() == 2
    session = demo.functions.where("name = 'getSession'").select(F.lit("t").alias("task"), "file", "key")
    assert [(r.shared, r.foreign) for r in model_overlap(demo, session, around.models).collect()] == [([], ["Session", "User"])]


def test_walk_rules(spark, demo):
    seed = lambda name, kind="function": spark.createDataFrame([("t", f"r|function:{p}#{name}", kind, name, 0, "why") for p in golden.FILES], "task string, key string, kind string, name string, rank int, why string")
    at = lambda name, **b: {r.name: (r.distance, r.reason) for r in neighbourhood(demo, seed(name), Bounds(**b)).members.collect()}
    got = at("VendorForm")
    assert got == {"VendorForm": (0, "anchor — why"), "VendorForm.handleSubmit": (0, "declared inside VendorForm"), "VendorForm.set": (0, "declared inside VendorForm"), "NewVendorPage": (1, "calls VendorForm")}
    # what is declared inside is not expanded; what was rendered leads on by calls only
    assert set(at("VendorForm", depth=3)) == set(got)
    assert at("NewVendorPage", depth=2, inbound=0) == {"NewVendorPage": (0, "anchor — why"), "VendorForm": (1, "called by NewVendorPage"), "VendorForm.handleSubmit": (1, "declared inside VendorForm"), "VendorForm.set": (1, "declared inside VendorForm")}
    assert set(at("getSession", depth=2, inbound=2)) == {"getSession", "readSessionCookie", "requireSession", "UnauthorizedError.constructor", "POST", "GET"}
    capped = neighbourhood(demo, seed("getSession"), Bounds(depth=4, inbound=4, members=3))
    assert [(r.members, r.truncated) for r in capped.stats.collect()] == [(3, True)]
    hubs = neighbourhood(demo, seed("getSession"), Bounds(depth=2, inbound=2, hubs=True, shared=1))
    assert {r.name for r in hubs.members.collect()} == {"getSession", "readSessionCookie"}  # two places call requireSession
    assert [r.hubs_skipped for r in hubs.stats.collect()] == [1]
    shape = spark.createDataFrame([("t", "r|type:src/lib/vendors/create.ts#NewVendor", "type", "NewVendor", 0, "why")], "task string, key string, kind string, name string, rank int, why string")
    held = neighbourhood(demo, shape, Bounds(shared=2, depth=0)).members.collect()
    assert len(held) == 5 and not any(r.core for r in held)
    assert all(r.core for r in neighbourhood(demo, shape, Bounds(depth=0)).members.collect())


def test_walk_equals_plain_search(spark):
    import random

    rng = random.Random(4)
    keys = [f"k{i}" for i in range(40)]
    pairs = sorted({(a, b) for a, b in ((rng.choice(keys), rng.choice(keys)) for _ in range(70)) if a != b})
    f = fact_tables.of_rows(spark, functions=[(k, k, "f", 1, 2, True, False, False, None, None) for k in keys], calls=[(a, b, "f", 1, False, False) for a, b in pairs])
    anchors = spark.createDataFrame([(t, k, "function", k, 0, "w") for t, k in (("x", "k1"), ("y", "k2"), ("y", "k3"))], "task string, key string, kind string, name string, rank int, why string")
    got = {(r.task, r.key): r.distance for r in neighbourhood(f, anchors, Bounds(depth=3, inbound=2)).members.collect()}
    want = {}
    for task, start in (("x", ["k1"]), ("y", ["k2", "k3"])):
        seen, frontier = {k: 0 for k in start}, list(start)
        for d in (1, 2, 3):
            step = {b for a, b in pairs if a in frontier} | ({a for a, b in pairs if b in frontier} if d <= 2 else set())
            frontier = [k for k in step if k not in seen]
            seen |= {k: d for k in frontier}
        want |= {(task, k): d for k, d in seen.items()}
    assert got == want


def test_named_files_are_the_anchors(spark, demo):
    tasks = spark.createDataFrame([("a", "explain the retry in toast.ts"), ("b", "update src/lib/db.ts"), ("c", "fix nothing.ts toast"), ("d", "vendors/create.ts and billing/invoice.ts")], "task string, text string")
    got = {}
    for r in anchor_ops.anchors(demo, tasks).collect():
        got.setdefault(r.task, set()).add(r.name)
    assert got["a"] == {"showToast", "onToast"} and got["d"] == {n for i in (0, 4) for n, _, _ in golden.FUNCTIONS[i]}
    assert "Toast" in got["c"]  # a name that fits no file is no name
    quoted = spark.createDataFrame([("q", "make 'vendor create failed' friendlier")], "task string, text string")
    assert anchor_ops.anchors(demo, quoted).where("rank = 0").first().name == "POST"
    view = anchor_ops.search_view(demo, spark.createDataFrame([("s", "vendor email")], "task string, text string"), limit=6).collect()
    kinds = [r.kind for r in sorted(view, key=lambda r: r.nth)]
    assert len(kinds) == 6 and kinds.count("function") < 6 and all(kinds.count(k) <= 4 for k in set(kinds) - {"function"})


def test_prompt_verdicts(spark, demo):
    task = spark.createDataFrame([("t", "duplicate email when creating a vendor")], "task string, text string")
    found = anchor_ops.anchors(demo, task)
    around = prompt_ops.boundary(neighbourhood(demo, found).members, found)
    asked = {
        "fix the billing invoice rounding": "NEW", "thanks, that is great": "NO_SIGNAL", "also the vendor email again": "SAME", "now look at src/lib/billing/invoice.ts": "NEW",
        "change vendor form and `showToast`": "WIDENED", "": "NO_SIGNAL", "zebra quagga": "NO_SIGNAL",
    }
    prompts = spark.createDataFrame([(p, "t", p) for p in asked], "prompt string, task string, text string")
    got = {r.prompt: r for r in prompt_ops.verdicts(prompts, prompt_ops.name_index(demo), around).collect()}
    assert {p: got[p].verdict for p in asked} == asked
    assert got["now look at src/lib/billing/invoice.ts"].named_outside == ["src/lib/billing/invoice.ts"]
    free = prompt_ops.verdicts(spark.createDataFrame([("p", "none", "see `showToast`")], "prompt string, task string, text string"), prompt_ops.name_index(demo), around)
    assert free.first().verdict == "WIDENED"  # an empty boundary is widened, not replaced


def test_snapshots_are_written_and_read(spark, demo, tmp_path):
    assert fact_tables.read(spark, f"{tmp_path}/none") is None
    fact_tables.write(demo, f"{tmp_path}/a")
    back = fact_tables.read(spark, f"{tmp_path}/a")
    for name, df in demo.relations().items():
        assert edge_ops.difference(df, getattr(back, name)).isEmpty(), name


def test_write_plans(spark):
    e = lambda *pairs: spark.createDataFrame([("L", *p) for p in pairs], "label string, src string, dst string")
    old, new = e("ab", "ac", "bc", "cd", "da"), e("ab", "bc", "cd", "ca", "da")
    plan = lambda **k: {(r.src + r.dst, r.action) for r in edge_ops.write_plan(old, new, **k).collect()}
    assert plan() == {("ac", "delete"), ("ca", "write"), ("ab", "write"), ("da", "write")}
    assert plan(most=0) == {("ac", "stale"), ("ca", "write")}
    nodes = lambda keys: spark.createDataFrame([("N", k) for k in keys], "label string, key string")
    assert {(r.key, r.action) for r in edge_ops.pruned(nodes("abc"), nodes("b")).collect()} == {("a", "delete"), ("c", "delete")}
    assert {r.action for r in edge_ops.pruned(nodes("abc"), nodes("b"), most=1).collect()} == {"skip"}
    assert {r.src + r.dst for r in edge_ops.without_nodes(old, nodes("c")).collect()} == {"ab", "da"}
    rows = lambda *r: spark.createDataFrame(r, "key string, v int, w array<int>")
    now, before = rows(("a", 1, [1]), ("b", None, []), ("c", 3, None), ("d", 4, None)), rows(("a", 1, [1]), ("b", None, []), ("c", 4, None))
    assert {r.key for r in edge_ops.changed_rows(now, before).collect()} == {"c", "d"}
    assert {r.key for r in edge_ops.changed_rows(now, before, forced=nodes("a")).collect()} == {"a", "c", "d"}
    kept, dropped = edge_ops.first_of_each(rows(("a", 2, None), ("a", 1, None), ("b", 1, None)), "key", "v")
    assert {(r.key, r.v) for r in kept.collect()} == {("a", 1), ("b", 1)} and dropped.first().dropped == 1


def test_sites_merge_and_reach(spark):
    sites = spark.createDataFrame([("a", "b", True), ("a", "b", None), ("b", "c", True), ("c", "a", False)], "src string, dst string, render boolean")
    edges = edge_ops.merge_sites(sites, every=("render",))
    assert {(r.src, r.dst, r.n_sites, r.render) for r in edges.collect()} == {("a", "b", 2, False), ("b", "c", 1, True), ("c", "a", 1, False)}
    seeds = spark.createDataFrame([("a",), (None,)], "key string")
    assert {tuple(r) for r in reach(seeds, edges, 5).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {tuple(r) for r in reach(seeds, edges, 1, both=True).collect()} == {("a", 0), ("b", 1), ("c", 1)}
    assert {tuple(r) for r in edge_ops.delta(edges.where("src <> 'a'"), edges.where("src <> 'b'"), ("src", "dst")).collect()} == {("a", "b", "add"), ("b", "c", "remove")}
    assert {tuple(r.path) for r in retrieve.whole_paths(edges, seeds.where("key is not null"), 5).collect()} == {("a", "b"), ("a", "b", "c")}


def test_terms(spark):
    df = spark.createDataFrame([("fix createVendor in src/lib, billing", "Vendors.create")], "t string, n string")
    row = df.select(task_terms(df.t).alias("terms"), own_name(df.n).alias("own"), *[matches(F.lit(t), df.n).alias(t) for t in ("vendor", "creating", "vended")]).first()
    assert row.terms == ["fix", "create", "vendor", "createvendor", "src", "lib", "billing"]
    assert (row.own, row.vendor, row.creating, row.vended) == ("create", True, True, True)


def test_every_function_has_its_own_walk(spark, sf_dir):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "c")], "src string, dst string")
    starts = spark.createDataFrame([(k, k) for k in "abcd"], "origin string, key string")
    callers = {tuple(r) for r in reach_each(starts, edges, 2, inward=True).collect()}
    assert callers == {(k, k, 0) for k in "abcd"} | {("b", "a", 1), ("b", "c", 2), ("c", "b", 1), ("c", "d", 1), ("c", "a", 2), ("a", "c", 1), ("a", "b", 2), ("a", "d", 2)}
    keys = {r.key for r in testgraph.facts(spark, sf_dir).functions.collect()}
    for query in (testgraph.QUERIES["callers_of_all"], testgraph.QUERIES["neighbourhood_of_all"]):
        assert {r.origin for r in query(spark, sf_dir).collect()} == keys


def test_all_prompts_without_stop_words(spark, tmp_path):
    spark.createDataFrame([(1, "please fix the createVendor route")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    turns = [(7, 0, "user", "hey, the retry logic"), (7, 1, "assistant", "done"), (7, 2, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {tuple(r) for r in testgraph.QUERIES["all_prompt_terms"](spark, str(tmp_path)).collect()}
    assert got == {("benchmark", 1, None, t) for t in ("fix", "create", "vendor", "createvendor", "route")} | {("conversations", 7, 0, t) for t in ("retry", "logic")}


def test_call_sites_of_every_line(spark, sf_dir):
    lines = sorted((tuple(r) for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").collect()))
    want = sum(a[0] == b[0] and a[2] != b[2] for a, b in zip(lines, lines[1:]))
    assert testgraph.call_sites(spark, sf_dir, quantity=None).count() == want > testgraph.call_sites(spark, sf_dir).count()
