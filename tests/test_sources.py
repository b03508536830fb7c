import json

import pytest

from graphquarry.operators import resolve
from graphquarry.sources import events, trees

SCHEMA = """
// models of the shop
model Vendor {
  id    Int     @id   // key
  email String  @unique
  notes String? @default("a // b")
  items Invoice[]
  @@index([email])
}
enum Kind { A B }
model Invoice {
  id     Int @id
  vendor Vendor
  id     Int
}
model Vendor {
  other Int
}
"""


def test_trees_and_schemas(spark, tmp_path):
    for path, text in {"src/a.ts": "x", "src/b.d.ts": "x", "src/c.tsx": "y", "node_modules/d.ts": "x", ".h/e.ts": "x", "prisma/s.prisma": SCHEMA, "migrations/t.prisma": SCHEMA, "a/b/c/d/e/u.prisma": SCHEMA, "z.md": "x"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    files = trees.tree(spark, str(tmp_path))
    sources = trees.source_files(files)
    assert {r.path for r in sources.collect()} == {"src/a.ts", "src/c.tsx"}
    assert trees.schema_files(files).collect()[0].path == "prisma/s.prisma" and trees.schema_files(files).count() == 1
    few = spark.createDataFrame([("src/a.ts",)], "path string")
    paths = lambda **k: {r.path for r in trees.chosen_files(sources, **k).collect()}
    assert paths() == paths(configured=few) == {"src/a.ts", "src/c.tsx"} and paths(only=few) == {"src/a.ts"}
    assert paths(configured=sources.select("path")) == {"src/a.ts", "src/c.tsx"}
    hashed = {r.path: r.hash for r in trees.hashes(sources, spark.createDataFrame([("gone.ts",)], "path string")).collect()}
    assert hashed["gone.ts"] is None and len(hashed["src/a.ts"]) == 16 and hashed["src/a.ts"] != hashed["src/c.tsx"]
    models, fields = trees.schemas(trees.schema_files(files), "r")
    assert {(r.key, r.name, r.file) for r in models.collect()} == {("r|model:Vendor", "Vendor", "prisma/s.prisma"), ("r|model:Invoice", "Invoice", "prisma/s.prisma")}
    got = {(r.key, r.type, r.is_unique, r.is_id) for r in fields.collect()}
    assert got == {
        ("r|field:Vendor.id", "Int", False, True), ("r|field:Vendor.email", "String", True, False), ("r|field:Vendor.notes", "String?", False, False), ("r|field:Vendor.items", "Invoice[]", False, False),
        ("r|field:Invoice.id", "Int", False, True), ("r|field:Invoice.vendor", "Vendor", False, False),
    }


def test_events(spark):
    patch = "*** Begin Patch\n*** Add File: src/new.ts\n+one\n+two\n*** Update File: src/a.ts\n@@\n-x\n+y\n*** Delete File: /else/b.ts\n*** End Patch\n+late"
    rows = [
        {"tool_name": "Write", "tool_input": {"file_path": "/r/src/w.ts", "content": ""}}, {"tool_name": "Edit", "tool_input": {"file_path": "src/e.ts", "old_string": "a", "new_string": "b"}},
        {"tool_name": "Edit", "tool_input": {"path": "/other/x.ts"}}, {"tool_name": "shell", "tool_input": {"command": patch}}, {"prompt": "hi", "user_prompt": " ", "turn_id": "t"},
    ]
    df = events.payloads(spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)] + [(9, "no json")], "event long, value string"))
    got = {(r.event, r.nth): (r.operation, r.file, r.content, r.old, r.new, r.outside) for r in events.intents(df, "/r").collect()}
    assert got == {
        (0, 0): ("create", "src/w.ts", None, None, None, None), (1, 0): ("edit", "src/e.ts", "b", "a", "b", None), (2, 0): ("edit", None, None, None, None, "/other/x.ts"),
        (3, 0): ("create", "src/new.ts", "one\ntwo", None, None, None), (3, 1): ("edit", "src/a.ts", None, None, None, None), (3, 2): ("delete", None, None, None, None, "/else/b.ts"),
    }
    assert tuple(df.where("event = 4").select(events.prompt_text(), events.prompt_id()).first()) == ("hi", "t")
    status = [" M src/a.ts", "R  old.ts -> src/new.ts", '?? "src/sp ace.ts"', " D .state/x", ""]
    lines = spark.createDataFrame([(s,) for s in status], "value string")
    assert {tuple(r) for r in events.changed_paths(lines, state_folder=".state").collect()} == {(" M", "src/a.ts"), ("R ", "src/new.ts"), ("??", "src/sp ace.ts")}
    assert {r.path for r in events.changed_paths(lines, prefix="src/").collect()} == {"a.ts", "new.ts", "sp ace.ts"}
    diff = ["+++ b/x.ts", "@@ -1 +3,2 @@", "@@ -9,4 +12,0 @@", "+++ b/y.ts", "@@ -0,0 +1 @@"]
    found = events.changed_lines(spark.createDataFrame(list(enumerate(diff)), "nth int, value string"))
    assert {tuple(r) for r in found.collect()} == {("x.ts", 3), ("x.ts", 4), ("x.ts", 12), ("y.ts", 1)}


@pytest.fixture(scope="module")
def symbols(spark):
    key = lambda f, n: f"r|function:{f}#{n}"
    local = [(f, n, key(f, n)) for f, n in (("lib/a.ts", "one"), ("lib/a.ts", "C"), ("lib/a.ts", "C.run"), ("lib/b.tsx", "two"), ("app.ts", "main"), ("lib/index.ts", "zero"), ("lib/dup.ts", "two"))]
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    return resolve.Symbols(
        files=df([(p,) for p in ("app.ts", "lib/a.ts", "lib/b.tsx", "lib/index.ts", "lib/loop.ts", "lib/dup.ts")], "path string"),
        local_names=df(local, "file string, name string, key string"),
        imports=df([("app.ts", "one", "./lib", "one"), ("app.ts", "uno", "./lib/index.js", "renamed"), ("app.ts", "two", "@/b", "two"), ("app.ts", "lib", "./lib", "*"), ("app.ts", "react", "react", "default"), ("app.ts", "lost", "./lib", "nothing"), ("app.ts", "gone", "./none", "x"), ("app.ts", "C", "./lib/a", "C"), ("app.ts", "D", "./lib/a", "C"), ("app.ts", "around", "./lib/loop", "around")], "file string, name string, module string, imported string"),
        exports=df([("lib/a.ts", "one", "one", None, None), ("lib/a.ts", "C", "C", None, None), ("lib/b.tsx", "two", "two", None, None), ("lib/dup.ts", "two", "two", None, None), ("lib/index.ts", "renamed", None, "./a", "one"), ("lib/index.ts", "zero", "zero", None, None), ("lib/index.ts", "out", None, "pkg", None)], "file string, name string, local string, from_module string, imported string"),
        stars=df([("lib/index.ts", 0, "pkg"), ("lib/index.ts", 1, "./a"), ("lib/index.ts", 2, "./b"), ("lib/index.ts", 3, "./dup"), ("lib/loop.ts", 0, "./loop"), ("lib/loop.ts", 1, "./index")], "file string, nth int, module string"),
        aliases=df([(0, "@/", "", 0, "nowhere/", ""), (0, "@/", "", 1, "lib/", "")], "nth int, prefix string, suffix string, to_nth int, to_prefix string, to_suffix string"),
    )


def test_names_across_files(spark, symbols):
    asked = ["main", "one", "uno", "two", "react", "lost", "gone", "unknown", "around"]
    got = {r.name: (r.outcome, r.key and r.key.split(":")[1]) for r in resolve.names(symbols, spark.createDataFrame([("app.ts", n) for n in asked], "file string, name string")).collect()}
    assert got == {
        "main": ("repo", "app.ts#main"), "one": ("repo", "lib/a.ts#one"), "uno": ("repo", "lib/a.ts#one"), "two": ("repo", "lib/b.tsx#two"), "react": ("external", None), "lost": ("external", None),
        "gone": ("external", None), "unknown": ("unresolved", None), "around": ("external", None),
    }
    direct = {r.name: (r.outcome, r.key and r.key.split(":")[1]) for r in resolve.exported(symbols, spark.createDataFrame([("lib/index.ts", n) for n in ("two", "zero", "out", "no")] + [("lib/a.ts", "no")], "file string, name string").where("file = 'lib/index.ts'")).collect()}
    assert direct == {"two": ("repo", "lib/b.tsx#two"), "zero": ("repo", "lib/index.ts#zero"), "out": ("external", None), "no": ("external", None)}


def test_call_targets(spark, symbols):
    sites = [(0, "app.ts", None, "one", None), (1, "lib/a.ts", "this", "run", "C"), (2, "app.ts", "lib", "two", None), (3, "app.ts", "c", "run", None), (4, "app.ts", "d", "run", None), (5, "app.ts", "x", "y", None), (6, "app.ts", "both", "run", None), (7, "app.ts", "e", "run", None), (8, "app.ts", "lib", "no", None)]
    instances = spark.createDataFrame([("app.ts", "c", "C"), ("app.ts", "d", "D"), ("app.ts", "both", "C"), ("app.ts", "both", "D"), ("app.ts", "e", "Nobody")], "file string, name string, cls string")
    found = resolve.call_targets(symbols, spark.createDataFrame(sites, "site int, file string, owner string, member string, inside string"), instances)
    got = {r.site: (r.outcome, r.key and r.key.split(":")[1]) for r in found.collect()}
    assert got == {
        0: ("repo", "lib/a.ts#one"), 1: ("repo", "lib/a.ts#C.run"), 2: ("repo", "lib/b.tsx#two"), 3: ("repo", "lib/a.ts#C.run"), 4: ("unresolved", None), 5: ("needs-types", None), 6: ("needs-types", None),
        7: ("unresolved", None), 8: ("external", None),
    }
    assert tuple(resolve.counters(found).first()) == (9, 4, 1, 2, 2)
