import golden
import pytest
from pyspark.sql import functions as F

from graphquarry.functions.text import STOP_WORDS, task_terms
from graphquarry.operators import anchors as anchor_ops
from graphquarry.operators.classify import INTENT, duplicate_flows, expansion, is_challenge, pending_reaches, verdicts
from graphquarry.operators.neighbourhood import neighbourhood

TASKS = [("a", "stop duplicate vendor email on create"), ("b", "fix the billing invoice rounding")]


def pending(calls=(), imports=(), touches=(), methods=(), path=None, exported=(), test=False, error=None, syntax=0):
    return (list(calls), list(imports), list(touches), list(methods), path, list(exported), test, error, syntax)


@pytest.fixture(scope="module")
def world(spark):
    facts = golden.facts(spark)
    tasks = spark.createDataFrame(TASKS, "task string, text string").withColumn("terms", task_terms(F.col("text"), STOP_WORDS))
    return facts, neighbourhood(facts, anchor_ops.anchors(facts, tasks)), tasks


CASES = [
    ("a", "edit", "src/lib/vendors/create.ts", None, "core", "EXPECTED"),
    ("a", "edit", "src/lib/auth/session.ts", None, "other data", "SUSPICIOUS"),
    ("a", "edit", "src/lib/billing/invoice.ts", None, "outside", "SUSPICIOUS"),
    ("b", "edit", "src/lib/billing/invoice.ts", None, "core", "EXPECTED"),
    ("b", "edit", "src/lib/vendors/create.ts", None, "outside", "SUSPICIOUS"),
    ("a", "edit", "prisma/schema.prisma", None, "schema of the task", "EXPECTED"),
    ("a", "edit", "locales/en/vendors.json", None, "path of the task", "CONNECTED"),
    ("a", "edit", "README.md", None, "unread", "NOT_JUDGED"),
    ("a", "create", "src/lib/vendors/dedupe.ts", None, "no content", "HUMAN_REVIEW"),
    ("a", "create", "src/x.ts", pending(error="unexpected }"), "parse error", "CONNECTED"),
    ("a", "create", "test/x.test.ts", pending(test=True), "test", "EXPECTED"),
    ("a", "create", "src/app/api/dup/route.ts", pending(touches=["vendor"], methods=["POST"], path="/api/dup"), "duplicate flow", "SUSPICIOUS"),
    ("a", "create", "src/app/api/via/route.ts", pending(imports=["src/lib/vendors/create"], methods=["POST"], path="/api/via"), "duplicate flow", "SUSPICIOUS"),
    ("a", "create", "src/lib/vendors/dedupe.ts", pending(calls=["createVendor"]), "reaches the task", "CONNECTED"),
    ("a", "create", "src/lib/other.ts", pending(imports=["src/lib/db"]), "unconnected", "SUSPICIOUS"),
    ("a", "edit", "src/lib/vendors/create.ts", pending(exported=["getVendor", "listVendors"]), "shrinking surface", "SUSPICIOUS"),
    ("a", "edit", "src/lib/vendors/create.ts", pending(exported=["createVendor", "listVendors"]), "core", "EXPECTED"),
    ("a", "edit", "src/lib/vendors/create.ts", pending(exported=[], syntax=2), "core", "EXPECTED"),
]


def test_verdicts(spark, world):
    changes = spark.createDataFrame([(i, t, op, f, True, p, []) for i, (t, op, f, p, _, _) in enumerate(CASES)], INTENT)
    got = {r.intent: r for r in verdicts(*world, changes).collect()}
    assert [(got[i].rule, got[i].decision) for i in range(len(CASES))] == [c[4:] for c in CASES]
    for r in got.values():
        assert r.reason and r.evidence and (r.question is not None) == (r.decision in ("SUSPICIOUS", "HUMAN_REVIEW")) and r.needs_judge == (r.decision == "SUSPICIOUS")
    flow = got[11]
    assert "POST /api/vendors → POST → createVendor → Vendor" in flow.reason and "Vendor.email is unique and a duplicate is rejected" in flow.question
    assert "through src/lib/vendors/create.ts" in got[12].reason
    assert "stops exporting createVendor, and 1 place " in got[15].reason
    assert world[0].files.select(is_challenge(F.lit("HUMAN_REVIEW"))).first()[0]


def test_settled_routes_are_not_cited(spark, world):
    facts, hood, tasks = world
    new = pending(touches=["Vendor"], methods=["POST"], path="/x")
    changes = spark.createDataFrame([(0, "a", "create", "x/route.ts", True, new, ["src/app/api/vendors/route.ts"]), (1, "a", "create", "x/route.ts", True, new, []), (2, "b", "create", "y", True, new, [])], INTENT)
    assert [r.intent for r in duplicate_flows(facts, changes, hood, tasks).collect()] == [1]
    own = {(r.intent, r.model, r.via) for r in pending_reaches(facts, spark.createDataFrame([(0, "a", "create", "z", True, pending(imports=["src/lib/auth/session", "src/none"]), [])], INTENT)).collect()}
    assert own == {(0, "Session", "src/lib/auth/session.ts"), (0, "User", "src/lib/auth/session.ts")}


def test_named_files_may_shrink(spark, world):
    facts, hood, _ = world
    tasks = spark.createDataFrame([("a", "refactor vendors/create.ts", ["refactor"])], "task string, text string, terms array<string>")
    changes = spark.createDataFrame([(0, "a", "edit", "src/lib/vendors/create.ts", True, pending(), []), (1, "a", "create", "lib/widget.ts", True, pending(), [])], INTENT)
    assert {r.intent: r.rule for r in verdicts(facts, hood, tasks, changes).collect()} == {0: "core", 1: "unconnected"}
    named = tasks.withColumn("text", F.lit("create lib/widget.ts with a helper"))
    assert {r.intent: r.rule for r in verdicts(facts, hood, named, changes.where("intent = 1")).collect()} == {1: "named"}


def test_expansion_policy(spark):
    rows = [("t", "a", 1, "CONNECTED", None), ("t", "b", 2, "SUSPICIOUS", "SUPPORTED_EXPANSION"), ("t", "b", 3, "SUSPICIOUS", "HUMAN_DECISION"), ("t", "b", 4, "SUSPICIOUS", "EXPECTED"), ("t", "c", 5, "SUSPICIOUS", None)]
    got = [(r.granted, r.why) for r in expansion(spark.createDataFrame(rows, "task string, file string, at int, decision string, opinion string")).orderBy("at").collect()]
    assert got == [(True, "graph"), (True, "opinion"), (False, "opinion"), (False, "budget"), (False, "no opinion")]
