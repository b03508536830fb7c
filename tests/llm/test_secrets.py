import math
import random
import re
from collections import Counter

from graphquarry.llm import secrets
from graphquarry.llm.secrets import joined, redact, scan

BASE = [(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6), ("AKIA[A-Z0-9]+", 20), ("[0-9a-f]{24,}", 24)]


def plain_spans(text):
    text = text or ""
    base = sorted((m.start(), kind, m.end()) for kind, (p, least) in enumerate(BASE) for m in re.finditer(p, text) if len(m[m.re.groups]) >= least)
    added = []
    for run in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        if not (re.search("[0-9]", run[0]) and re.search("[A-Za-z]", run[0])):
            continue
        free = [all(not s <= i < e for s, _, e in base) for i in range(run.start(), run.end())]
        for part in re.finditer("1+", "".join("01"[f] for f in free)):
            start, whole = run.start() + part.start(), run[0][part.start() : part.end()]
            if not (re.search("[0-9]", whole) and re.search("[A-Za-z]", whole)):
                continue
            listed = {i + k for a in secrets.ALLOW for i in range(len(whole)) if whole.startswith(a, i) for k in range(len(a))}
            for piece in re.finditer("1+", "".join("01"[i not in listed] for i in range(len(whole)))):
                m = whole[piece.start() : piece.end()]
                least = 2.9 if re.fullmatch("[0-9a-fA-F]+", m) else 3.6
                high = [i for i in range(len(m) - 19) if -sum(c / 20 * math.log2(c / 20) for c in Counter(m[i : i + 20]).values()) >= least]
                if high:
                    added.append((start + piece.start() + high[0], 3, start + piece.start() + high[-1] + 20))
    return sorted(base + added)


def plain_redacted(text):
    out, at = "", 0
    for start, _, end in plain_spans(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return text if text is None or not at else out + text[at:]


def test_runs_are_scanned_outside_base_spans_and_allow_list(spark):
    rng = random.Random(5)
    word = lambda n, chars="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rng.choice(chars) for _ in range(n))
    key = word(40)
    texts = [
        f"see AKIA{word(16, 'ABCDEFGHIJKLMNOP')}/{key} here",
        f"{key}/{word(24, '0123456789abcdef')}/{word(40)}",
        f"EXAMPLE_KEY={key}",
        f"{word(40)}0123456789{word(40)}",
        f"EXAMPLEXAMPLE{word(25)}changemexample{word(19)}example{word(20)}",
        "0123456789" + word(40, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        f"{word(30)}_token={word(30)}",
        f"é {key} EXAMPLE {word(19)} placeholder",
        "", None,
    ]
    texts += ["".join(rng.choice([word(rng.randrange(1, 40)), "EXAMPLE", "0123456789", " ", "AKIA" + word(16, "ABC123"), word(26, "0123456789abcdef"), "token="]) for _ in range(6)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(t)) for t in texts]
    assert [r.s for r in scan(df).select("doc_id", joined("spans").alias("s")).orderBy("doc_id").collect()] == want
    clean = [r.text for r in redact(df).orderBy("doc_id").collect()]
    assert clean == [plain_redacted(t) for t in texts]
    assert all(key not in t for t in clean if t)


def test_odd_rows(spark):
    texts = [None, "", "no secrets", "token = abcdef", "TOKEN=abcde password:'hunter2hunter'", "AKIA" + "A" * 16 + " " + "0f" * 12, "x " * 40000 + "api_key: zyxwvu9876 " + "é" * 9 + "deadbeef" * 5]
    rows = [(i, t, 1, "b", 2) for i, t in enumerate(texts)] * 2 + [(None, texts[4], 1, "b", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base int, added string, c0 int")
    got = scan(df).select("doc_id", joined("spans").alias("s")).collect()
    want = {t: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in plain_spans(t)) for t in texts}
    assert sorted((repr(r.doc_id), r.s) for r in got) == sorted((repr(r[0]), want[r[1]]) for r in rows)
    clean = redact(df)
    assert clean.columns == df.columns
    assert sorted(map(repr, map(tuple, clean.collect()))) == sorted(repr((i, plain_redacted(t), *rest)) for i, t, *rest in rows)
    assert scan(df.limit(0)).count() == redact(df.limit(0)).count() == 0
