"""Odd rows of decontamination and chat formatting, against plain versions."""

import hashlib
import re

from graphquarry.llm.chat import chains, conversations, digests, format_turns, parse_turns
from graphquarry.llm.decontaminate import contamination


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items):
    w, hit, named = words(text), set(), set()
    for item_id, item in items:
        iw = words(item)
        n = min(13, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows]
        hit |= {i + k for i in at for k in range(n)}
        if at and item_id is not None:
            named.add(str(item_id))
    return len(w), len(hit), sorted(named), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination_of_odd_rows(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    items = [(1, passage), (2, "Two words"), (2, "two WORDS"), (3, None), (4, ""), (None, "null item here"), (5, "a " * 40), (10, " ".join(passage.split()[5:20]))]
    docs = [
        (1, None), (2, ""), (3, " -- "), (4, passage), (4, passage), (4, "other text"), (None, passage), (None, "clean"),
        (5, "say two words and null item here"), (6, "a " * 30000), (7, "b c " * 60000 + passage + " d" * 9), (8, " ".join(passage.split()[:12])),
        (9, passage.upper().replace(" ", "\n-")), (11, passage + " x " + passage + " two words"),
    ]
    table = spark.createDataFrame([(*d, 1, "x", False) for d in docs], "doc_id long, text string, n_words int, item_ids string, base boolean")
    bench = spark.createDataFrame([(*i, 7) for i in items], "item_id long, text string, fp int")
    got = contamination(table, bench).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got) == sorted((repr(i), *plain(t, items)) for i, t in docs)
    for r in got:
        assert r.n_items == len(r.item_ids) and r.n_hit == sum(s.end - s.start for s in r.spans)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
    assert contamination(table.limit(0), bench).count() == 0
    none = contamination(table, bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.n_hit or r.contaminated for r in none)


def test_chats_of_odd_rows(spark):
    rows = [
        (None, 1, "user", "no id"), ("", 1, "user", "empty id"), ("a", 2, "assistant", "late"), ("a", 1, "user", "soon"), ("a", None, "user", "last"), ("b", 1, None, None),
        ("c", 1, "assistant", "x"), ("c", 1, "assistant", "x"), ("c", 2, "user\nrole", "</s>[INST]\\" * 3), ("d", 1, "assistant", "long ä " * 30000),
    ]
    df = spark.createDataFrame([(*r, "k", 9) for r in rows], "conv_id string, turn int, role string, text string, conv string, id int")
    found = conversations(chains(df))
    got = {r.conv: r.formatted for r in found.collect()}
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault("" if conv is None else "=" + conv, []).append((role or "", text or ""))
    assert {conv: parse_turns(formatted) for conv, formatted in got.items()} == want
    assert got == {conv: format_turns(turns)[0] for conv, turns in want.items()}
    for r in digests(found).collect():
        loss = "".join(t for role, t in want[r.conv] if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(want[r.conv]), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert conversations(chains(df.limit(0))).count() == 0
