import json
import time

import golden
import pytest
from pyspark.sql import functions as F

from graphquarry import api
from graphquarry.functions import render
from graphquarry.operators.classify import INTENT


@pytest.fixture(scope="module")
def engine(spark):
    e = api.Engine(golden.facts(spark))
    said = e.set_task("stop duplicate vendor email on create").first().briefing
    assert said.startswith("Task: stop duplicate") and "src/lib/vendors/create.ts" in said and "Data: " in said and "Vendor" in said
    return e


def test_tools(spark, engine):
    assert {r.name for r in engine.run("callers", "createVendor").collect()} == {"POST"}
    assert {r.reacher.split("#")[1] for r in engine.run("paths", "Vendor").collect()} == {"createVendor", "listVendors"}
    assert {r.name for r in engine.paths("Invoice").collect()} == {"createInvoice", "listUnpaidInvoices", "markInvoicePaid"}
    assert engine.run("find", "invoice").count() > 0 and engine.run("impact", "createVendor").count() > 3
    assert engine.run("status").first().members == engine.hood.members.count()
    assert engine.run("scope").first().distance == 0 and engine.run("explain", "createVendor").first().distance == 0
    changes = spark.createDataFrame([(0, "x", "edit", "src/lib/billing/invoice.ts", False, None, [])], INTENT)
    verdict = engine.run("check", changes)
    row = verdict.select("decision", render.challenge(F.col("reason"), F.col("question"), F.col("evidence")).alias("text")).first()
    assert row.decision == "SUSPICIOUS" and row.text.count("\n") >= 3 and row.text.endswith('require a change in src/lib/billing/invoice.ts?')
    out = verdict.select(render.decision_json(F.col("decision") == "SUSPICIOUS", F.col("reason")).alias("j"), render.decision_json(F.lit(False), F.col("reason")).alias("none"), render.context_json(F.col("file")).alias("c")).first()
    assert json.loads(out.j)["hookSpecificOutput"]["permissionDecision"] == "deny" and out.none is None and json.loads(out.c)["hookSpecificOutput"]["additionalContext"]
    asked = render.opinion_prompt(verdict, engine.hood.members, engine.tasks).first().prompt
    assert "Change: src/lib/billing/invoice.ts" in asked and "createVendor" in asked


def test_prompts_move_the_task(spark):
    e = api.Engine(golden.facts(spark))
    assert e.take_prompt("stop duplicate vendor email on create") == "OPENED"
    assert e.take_prompt("also the vendor email again") == "SAME"
    assert e.take_prompt("fix the billing invoice rounding") == "NEW" and e.text == "fix the billing invoice rounding"
    assert e.take_prompt("billing and `showToast` too") == "WIDENED" and e.text.startswith("fix the billing") and e.text.endswith("`showToast` too")


def test_opinions(spark):
    good = '{"decision": "supported_expansion", "reason": "needed", "evidence": ["a", "", "b"]}'
    answers = [good, f"Sure:\n```json\n{good}\n```\nbye", '{"decision": "MAYBE", "reason": "x"}', "no", '{"decision": "EXPECTED", "reason": " "}', None]
    df = spark.createDataFrame(list(enumerate(answers)), "i int, a string")
    got = [r.o and (r.o.decision, r.o.evidence) for r in df.select("i", render.opinion(F.col("a")).alias("o")).orderBy("i").collect()]
    assert got == [("SUPPORTED_EXPANSION", ["a", "b"])] * 2 + [None] * 4


def test_budget(spark):
    assert api.within_budget(lambda: spark.range(3), 60) is not None
    slow = lambda: time.sleep(3) or spark.range(3)
    assert api.within_budget(slow, 0.2) is None
    with pytest.raises(ZeroDivisionError):
        api.within_budget(lambda: 1 / 0, 5)
