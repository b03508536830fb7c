import hashlib
import base64

from pyspark.sql import functions as F

from graphquarry.functions import ids, paths, text


def values(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.v for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def fnv(key):
    h = 0xCBF29CE484222325
    for b in key.encode():
        h = ((h ^ b) * 0x100000001B3) & (1 << 64) - 1
    return (h ^ h >> 52) & (1 << 52) - 1


def test_ids(spark):
    keys = ["", "a", "repo|function:src/lib/db.ts#find", "\u00e9\u4e2d\U0001f600", "x" * 3000]
    assert values(spark, [(k,) for k in keys] + [(None,)], "k string", ids.hash_id(F.col("k"))) == [fnv(k) for k in keys] + [None]
    assert fnv("") == 735455236730778
    many = spark.range(100_000).select(F.concat(F.lit("r|function:f"), F.col("id")).alias("key"))
    assert ids.collisions(many).isEmpty()
    sample = many.limit(50).union(many.limit(50))
    assert {(r.key, r.id) for r in ids.checked_ids(sample).collect()} == {(r.key, fnv(r.key)) for r in sample.collect()}
    row = spark.createDataFrame([("C:\\Work\\App/",)], "p string").select(ids.repo_id(F.col("p")).alias("id"), ids.node_key("r", "field", F.lit("a.b")).alias("k"), ids.repo_of(F.lit("r|x")).alias("r"), ids.repo_of(F.lit("x")).alias("n")).first()
    digits, n = "", fnv("c:/work/app")
    while n:
        n, d = divmod(n, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    assert tuple(row) == (digits, "r|field:a.b", "r", "")


def test_paths(spark):
    f = F.col("a")
    assert values(spark, [("src/app/api/vendors/route.ts",), ("app/(ee)/api/x/(g)/route.tsx",), ("x/app/route.ts",)], "a string", paths.route_path(f)) == ["/api/vendors", "/(ee)/api/x", "/route.ts"]
    assert values(spark, [("C:\\r\\src\\a.ts", "C:\\r"), ("/r/a.ts", "/r/"), ("b/a.ts", "/r")], "a string, b string", paths.normalise_path(f, F.col("b"))) == ["src/a.ts", "a.ts", "b/a.ts"]
    assert values(spark, [("src/a/b.ts", "../c/./d.js"), ("b.ts", "./x"), ("b.ts", "react"), ("b.ts", "../../y")], "a string, b string", paths.import_target(f, F.col("b"))) == ["src/c/d", "x", None, "../../y"]
    assert values(spark, [("a.test.ts",), ("a.spec.tsx",), ("test.ts",)], "a string", paths.is_test_file(f)) == [True, True, False]
    assert values(spark, [("a.tsx", "f.Form"), ("a.ts", "Form"), ("a.tsx", "form")], "a string, b string", paths.is_component(f, F.col("b"))) == [True, False, False]
    assert values(spark, [('id Int // key',), ('url "http://x" // y',), ("no",), ("a / b",)], "a string", paths.without_comment(f)) == ["id Int ", 'url "http://x" ', "no", "a / b"]
    assert values(spark, [("Vendor created.",), ("Something went wrong",), ("flex mt-2 px-4",), ("key",), ("a {x} name here",), ("see https://x",), ("1234 5678 90",)], "a string", paths.is_user_text(f)) == [True, True, False, False, False, False, False]
    assert values(spark, [("change src/lib/cn.ts",), ("the submit.ts file",), ("update route.ts",)], "a string", paths.names_file(f, F.lit("src/lib/submit.ts"))) == [False, True, False]
    assert values(spark, [("locales/en/viewer.json",), ("src/x.ts",)], "a string", paths.path_terms(f, F.array(F.lit("viewers"), F.lit("expire"), F.lit("local")))) == [["viewers", "local"], []]
    assert values(spark, [("abcabd", "abd", "x"), ("abab", "ab", "x"), ("abc", "z", "x"), ("abc", "c", "")], "a string, b string, c string", paths.replaced_once(f, F.col("b"), F.col("c"))) == ["abcx", None, None, "ab"]
    text_ = "x = 1\n"
    assert values(spark, [(text_,)], "a string", paths.content_hash(f)) == [base64.b64encode(hashlib.sha1(text_.encode()).digest()).decode()[:16]]


def test_prompts(spark):
    p = F.col("p")
    assert values(spark, [("it says 'Link has expired.' and \u201cone\u201d",)], "p string", text.quoted_phrases(p)) == [["link has expired."]]
    assert values(spark, [("see `lib/utils.ts`, ./x/Y.tsx and @/z.css or word.md",)], "p string", text.named_paths(p)) == [["lib/utils.ts", "x/y.tsx", "z.css"]]
    assert values(spark, [("use `cn` in handleSubmit and VendorForm, call go()",)], "p string", text.named_identifiers(p)) == [["cn", "go", "handleSubmit", "VendorForm"]]
    asked = ["Where is it?", "could you fix the crash?", "is there a way", "is the check broken?", "is it time to add one?", "fix it", "", None]
    assert values(spark, [(a,) for a in asked], "p string", text.is_question(p)) == [True, False, True, True, False, False, False, False]
    tasks = [("a | b", "c"), ("a | b | c", "d"), ("a", "a"), ("a | " + "m" * 300, "n" * 200), ("o" * 300, "n" * 200), ("a", "z" * 500), ("", " ")]
    assert values(spark, tasks, "t string, p string", text.widened_task(F.col("t"), p)) == ["a | b | c", "a | c | d", "a", "a | " + "n" * 200, "o" * 197 + " | " + "n" * 200, "z" * 400, ""]
    assert values(spark, [(" ", "x"), (None, "y"), ("a", "b")], "p string, q string", text.first_said(p, F.col("q"))) == ["x", "y", "a"]
