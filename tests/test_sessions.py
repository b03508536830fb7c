import random

import golden
import pytest
from pyspark.sql import functions as F

from graphquarry import facts as fact_tables
from graphquarry.operators import edges as edge_ops
from graphquarry.operators import evaluate, incremental, sessions
from graphquarry.operators.neighbourhood import Bounds
from graphquarry.streaming import sessions as streaming


def log(spark, rows):
    """Events from (session, seconds, kind, file, mtime seconds, size, exists)."""
    df = spark.createDataFrame([(s, at, i, kind, file, mtime, size, exists) for i, (s, at, kind, file, mtime, size, exists) in enumerate(rows)], "session long, t int, seq long, kind string, file string, m int, size long, exists boolean")
    return df.select("session", F.timestamp_seconds("t").alias("at"), "seq", "kind", "file", (F.col("m") * 1000).cast("long").alias("mtime_ms"), "size", "exists")


def test_changes_by_their_order(spark):
    rows = [
        (1, 100, "open", None, None, None, None), (1, 101, "change", "a.ts", 101, 1, True), (1, 102, "change", "a.ts", 102, 1, True), (1, 103, "change", "old.ts", 90, 1, True), (1, 104, "change", "old.ts", 90, 1, True),
        (1, 105, "change", "r.md", 105, 1, True), (1, 106, "change", "r.md", 105, 1, True), (1, 107, "change", "gone.ts", 0, 0, False), (1, 108, "challenge", "a.ts", None, None, None), (1, 109, "change", "a.ts", 109, 2, True),
        (1, 110, "open", None, None, None, None), (1, 111, "change", "a.ts", 111, 3, True), (1, 112, "judge", "b.ts", None, None, None), (1, 113, "change", "b.ts", 113, 1, True),
    ]
    events = log(spark, rows)
    got = {(r.task, r.seq): r.found for r in sessions.detected(events).collect()}
    assert got == {(1, 1): "candidate", (1, 2): "accounted", (1, 3): "pre-task", (1, 4): "pre-task", (1, 5): "unreadable", (1, 6): "seen", (1, 7): "delete", (1, 9): "forced", (2, 11): "candidate", (2, 13): "accounted"}
    missed = {(r.task, r.file, r.mtime_ms) for r in sessions.unseen(events).collect()}
    assert missed == {(1, "r.md", 105000), (1, "gone.ts", 0), (2, "a.ts", 111000)}
    said = {r.task: r.said for r in sessions.unseen_summary(sessions.unseen(events)).collect()}
    assert said[1] == "2 changed without being seen: gone.ts, r.md"
    marks = {(r.task, r.file): (r.challenged, r.forced, r.overlay_ms) for r in sessions.marks(events).collect()}
    assert marks[1, "a.ts"] == (True, True, 109000) and marks[2, "a.ts"] == (False, False, 111000)


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(2)
    rows, now = [], 1000
    for _ in range(600):
        now += rng.randrange(3)
        kind = rng.choices(["change", "open", "challenge", "justify", "judge"], [12, 1, 1, 1, 1])[0]
        rows.append((rng.randrange(5), now, kind, None if kind == "open" else f"f{rng.randrange(12)}{rng.choice(['.ts', '.md'])}", now - rng.randrange(40), rng.randrange(2), rng.random() > 0.1))
    events = log(spark, rows)
    want = sorted(map(tuple, sessions.detected(events).collect()))
    for i in range(3):  # three batches, in order of time
        events.where(f"seq div 200 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = streaming.detected(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    got = spark.read.parquet(f"{tmp_path}/out").select("session", "task", "seq", "file", "found")
    assert sorted(map(tuple, got.collect())) == want


def test_prompts_of_a_session(spark):
    rows = [(1, 1, "p", "fix it", "NEW"), (1, 2, "p", "fix it", "NEW"), (1, 3, "q", "where is it?", "NEW"), (1, 4, "r", "and this", "SAME"), (1, 5, None, "other job", "NEW"), (1, 6, None, "hm", "NO_SIGNAL")]
    df = spark.createDataFrame(rows, "session long, at long, prompt_id string, text string, verdict string")
    want = ["opened", "duplicate", "question", "kept", "redrawn", "kept"]
    assert [r.action for r in sessions.prompt_actions(df).orderBy("at").collect()] == want
    assert [r.action for r in sessions.prompt_actions(df, explicit=True).orderBy("at").collect()][4] == "reported"
    stale = [(None, 0, 0, 0, False, True), (100, 20_000, 500, 0, True, False), (100, 90_000, 50, 50, False, False), (100, 90_000, 200, 0, False, True), (100, 90_000, None, 101, False, True), (100, 90_000, None, None, True, True)]
    df = spark.createDataFrame(stale, "b long, n long, o long, c long, m boolean, want boolean")
    assert df.where(sessions.is_stale(F.col("b"), F.col("n"), F.col("o"), F.col("c"), F.col("m")) != F.col("want")).isEmpty()


@pytest.fixture(scope="module")
def demo(spark):
    return golden.facts(spark)


def test_incremental_equals_full(spark, demo, tmp_path):
    hashes = demo.files.select("path", F.lit("x").alias("hash"))
    now = hashes.withColumn("hash", F.when(F.col("path") == "src/lib/ui/toast.ts", "y").otherwise(F.col("hash")))
    p = incremental.plan(hashes, now, demo.files, demo.imports)
    assert (p.mode, {r.path for r in p.affected.collect()}) == ("incremental", {"src/lib/ui/toast.ts", "src/lib/vendors/submit.ts", "src/components/VendorForm.tsx", "src/app/vendors/new/page.tsx"})
    assert incremental.plan(None, now).mode == "full"
    assert incremental.plan(hashes, now.where("path <> 'src/lib/db.ts'"), demo.files, demo.imports).mode == "full"
    assert incremental.plan(hashes, now, demo.files, demo.imports, full=0.2).mode == "full"
    same = incremental.plan(hashes, hashes, demo.files, demo.imports)
    assert (same.mode, same.read) == ("incremental", 0)
    new = now.union(spark.createDataFrame([("src/new.ts", "z")], now.schema))
    assert "src/new.ts" in {r.path for r in incremental.plan(hashes, new, demo.files, demo.imports).affected.collect()}
    # a new version without one function, of which only the affected files are read again
    full, _ = edge_ops.intact_facts(demo.replaced(functions=demo.functions.where("name <> 'onToast'")))
    reread = p.affected
    own = lambda df, c: df.join(reread.withColumnRenamed("path", "_p"), F.col(c) == F.col("_p"), "left_semi")
    part = {n: own(getattr(full, n), "file") for n in ("functions", "types", "routes", "calls", "references", "touches")}
    owners = full.files.select(F.col("key").alias("from_file_key"), "path").join(reread, "path")
    fresh = full.replaced(**part, files=full.files.join(reread, "path", "left_semi").select("key", "path"), imports=full.imports.join(owners.select("from_file_key"), "from_file_key", "left_semi").select("from_file_key", "to_file_key"))
    merged = incremental.merged(demo.replaced(references=demo.references.withColumn("file", F.regexp_extract("from_key", ":(.*)#", 1))), fresh.replaced(references=own(full.references.withColumn("file", F.regexp_extract("from_key", ":(.*)#", 1)), "file")), reread)
    assert edge_ops.difference(edge_ops.edge_groups(merged), edge_ops.edge_groups(full)).isEmpty()
    assert {(r.missing, r.extra) for r in evaluate.same_facts(full, full).collect()} == {(0, 0)}
    assert {r.relation for r in evaluate.same_facts(demo, full).where("missing + extra > 0").collect()} == {"functions", "references"}


def test_evaluation(spark, demo):
    tasks = spark.createDataFrame([("v", "duplicate vendor email on create"), ("i", "billing invoice rounding")], "task string, text string")
    keys = {r.name: r.key for r in demo.functions.collect()}
    cases = spark.createDataFrame([("v", keys["createVendor"]), ("v", keys["POST"]), ("i", keys["createInvoice"]), ("i", keys["showToast"]), ("i", "gone")], "task string, key string")
    got = {r.candidate: r for r in evaluate.sweep(demo, tasks, cases, {"usual": {}, "one": {"limit": 1, "bounds": Bounds(depth=0)}}).collect()}
    assert got["usual"].cases == 2 and got["usual"].recall == 0.75 and got["usual"].perfect == 1 and not got["usual"].passes
    assert got["one"].worst_area <= 2 / 21 < got["usual"].worst_area
    lines = spark.createDataFrame([("src/components/VendorForm.tsx", n) for n in (14, 16, 20, 31)], "file string, line int")
    wide = demo.functions.withColumn("end_line", F.when(F.col("name") == "VendorForm", 60).otherwise(F.col("end_line")))
    assert [r.name for r in evaluate.owners(lines, wide).orderBy("line").collect()] == [None, "VendorForm", "VendorForm.handleSubmit", "VendorForm.set"]
    spans = spark.createDataFrame([("f", 0, 100, "a"), ("f", 10, 50, "b"), ("f", 20, 30, "c"), ("f", 60, 70, "d")], "file string, start int, end int, key string")
    at = spark.createDataFrame([("f", p) for p in (5, 10, 25, 31, 55, 65, 101)] + [("g", 5)], "file string, pos int")
    assert [r.key for r in evaluate.enclosing(at, spans).orderBy("file", "pos").collect()] == ["a", "b", "c", "b", "a", "d", None, None]
    commits = [(0, "a", "fix: the vendor form loses its input", ["a.ts", "b.d.ts"]), (1, "b", "chore: update dependencies of all", ["a.ts"]), (2, "c", "fix: too short", ["a"]), (3, "d", "feat: make the session cookie strict", [f"f{i}" for i in range(9)]), (4, "e", "bump the version of everything here", ["a"]), (5, "f", "Show invoices that are overdue", ["c.ts", ""])]
    chosen = evaluate.chosen_commits(spark.createDataFrame(commits, "nth int, sha string, subject string, files array<string>")).collect()
    assert [(r.sha, r.files) for r in chosen] == [("a", ["a.ts"]), ("f", ["c.ts"])]
    ledger = edge_ops.edge_groups(demo).select("label", "src", "dst")
    check = evaluate.edge_check(demo, ledger.where("label <> 'IMPORTS'")).collect()
    assert {r.label: (r.missing, r.extra) for r in check if r.missing or r.extra} == {"IMPORTS": (11, 0)}
    alarms = spark.createDataFrame([("SUSPICIOUS", "outside", "a/b.ts"), ("SUSPICIOUS", "outside", "c.ts"), ("EXPECTED", "core", "x")], "decision string, rule string, file string")
    assert {(r.decision, r.extension, r.n, r.challenged) for r in evaluate.false_alarms(alarms).collect()} == {("SUSPICIOUS", ".ts", 2, True), ("EXPECTED", "", 1, False)}
    assert fact_tables.empty(spark).files.isEmpty()
