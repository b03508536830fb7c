import re
import zlib

import pytest

from graphquarry.llm.near import near_duplicates
from graphquarry.llm.queries import op2_language_id, op7_near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 75 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def rows_of(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert rows_of(op7_near_dedup(spark, sf_dir)) == brute(docs)


def test_pairs_around_the_threshold(spark):
    """Chains whose neighbours lie near the threshold, so that buckets hold several components."""
    import random

    rng = random.Random(3)
    docs, i = [], 0
    for _ in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(6):
            docs.append((i, " ".join(words)))
            i += 1
            for _ in range(rng.randrange(1, 5)):
                words[rng.randrange(120)] = f"w{rng.randrange(10**6)}"
    assert rows_of(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))) == brute(docs)


def test_blocks_of_hot_buckets(spark, monkeypatch):
    """Tiny blocks, so that buckets need many pairs of them; one component fills blocks of its own."""
    import random

    from graphquarry.llm import near

    monkeypatch.setattr(near, "_BLOCK", 4)
    monkeypatch.setattr(near, "_BLOCK_BYTES", 3000)
    rng = random.Random(5)
    base, docs = [f"w{i}" for i in range(150)], []
    for i in range(90):
        words = list(base)
        for _ in range(rng.choice([1, 2, 4, 6])):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    assert rows_of(near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)
    rows = spark.createDataFrame([(1, 7, i) for i in range(40)] + [(1, 100 + i, 100 + i) for i in range(5)], "bucket long, label long, id long")
    dealt = near._blocks(rows)[0].collect()
    tasks = {}
    for r in dealt:
        tasks.setdefault((r.a, r.b), []).append(r)
    met = {frozenset((x.id, y.id)) for t in tasks.values() for x in t for y in t if x.label != y.label}
    assert met == {frozenset((x.id, y.id)) for x in dealt for y in dealt if x.label != y.label}
    assert max(map(len, tasks.values())) < 40


def test_texts_that_share_an_id_and_string_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    docs = [("k", a), ("k", b), ("m", a + " z"), ("n", b + " z"), ("c", a), (None, a)]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "", r.component_id or "", r.kept) for r in got) == [("", "", True), ("c", "c", True), ("k", "c", False), ("k", "k", True), ("m", "c", False), ("n", "k", False)]


def test_docstring_states_the_odds_of_a_miss():
    from math import comb

    from graphquarry.llm import near

    p, n = 0.75, near.REGISTERS
    bands = (1 - p**near.ROWS) ** (n // near.ROWS)
    estimate = sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(66))
    assert f"{bands:.0e}".replace("e-0", "e-") in near.__doc__ and f"{estimate:.0e}".replace("e-0", "e-") in near.__doc__


def test_odd_rows(spark):
    docs = [(5, None), (4, ""), (3, "One two"), (2, "one TWO"), (1, " \t"), (9, "x " * 30000), (8, "x " * 30001)]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n long, component long")
    assert rows_of(near_duplicates(df)) == brute(docs)
    assert near_duplicates(df.limit(0)).count() == 0


def test_language_accuracy_on_held_out(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op2_language_id(spark, sf_dir).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)


def test_language_odd_rows(spark):
    from graphquarry.llm.language import identify

    docs = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (5, "12 34", "de"), (6, "die katze", None), (None, "the dog", None)]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, lang string, score double")
    got = {r.doc_id: (r.lang_pred, r.score_) for r in identify(df).collect()}  # the column score of the input stays
    assert got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[6][0] == "de" and got[None][0] == "en"
    assert {r.lang_pred for r in identify(df, learn=df.limit(0)).collect()} == {"und"}
    assert identify(df.limit(0)).count() == 0


def cross_parse(sample, text):
    """Phrases of a text from left to right, by the definition."""
    at = phrases = 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in sample:
            n += 1
        at, phrases = at + max(n - 1, 1), phrases + 1
    return phrases


@pytest.mark.parametrize("chunk", [7, 16, 1024])
def test_cross_parsing_equals_the_definition(monkeypatch, chunk):
    import random

    import numpy as np

    from graphquarry.llm import language

    monkeypatch.setattr(language, "CHUNK", chunk)
    rng = random.Random(chunk)
    for alphabet in (b"ab ", b"abcdefgh ") * 10:
        samples = {x: bytes(rng.choices(alphabet, k=rng.randrange(1, 300))) for x in ("de", "en", "fr")}
        texts = [bytes(rng.choices(alphabet + b"z", k=rng.randrange(200))) for _ in range(6)] + [samples["en"] * 9, b"a" * 3000, b""]
        model = language.Model(samples)
        offsets = np.cumsum([0, *map(len, texts)])
        got = model.phrases(np.frombuffer(b"".join(texts), np.uint8), offsets)
        assert got.tolist() == [[cross_parse(samples[lang], t) for t in texts] for lang in model.langs]


def test_language_of_unequal_samples_long_texts_and_repeats(spark):
    from graphquarry.llm.language import identify

    docs = [(i, "the cat and the dog", "en", 0.5, "x") for i in range(50)] + [(60, "der hund und die katze", "de", 0.5, "x")]
    asked = [(70, "die katze und der hund", None, 0.5, "x"), (71, "a dog saw the cat", None, 0.5, "x"), (72, "die katze und der hund " * 5000, None, 0.5, "x")]
    df = spark.createDataFrame(docs + asked + asked[:1], "doc_id long, text string, lang string, score double, lang_pred string")
    got = identify(df)
    assert got.columns == [*df.columns, "lang_pred_", "score_"]
    rows = got.where("doc_id >= 70").collect()
    assert {(r.doc_id, r.lang_pred_) for r in rows} == {(70, "de"), (71, "en"), (72, "de")} and len(rows) == 4
    assert {(r.score, r.lang_pred) for r in rows} == {(0.5, "x")}


def test_language_sample_is_of_whole_texts(spark):
    from graphquarry.llm.language import train

    docs = [(i, f"w{chr(97 + i)} " * 100 + chr(97 + i) * 3, "en") for i in range(20)] + [(30, "z" * 5000, "de"), (31, "y" * 9000, "de")]
    df = spark.createDataFrame(docs + docs[:5], "doc_id long, text string, lang string")
    model = train(df, doc_id="doc_id", text="text", lang="lang", docs_per_lang=100, bytes_per_lang=1000)
    assert model.langs == ["de", "en"]
    sizes = [round(2**b - 256) for b in model.bits]
    assert sizes[0] == 5000  # none fits, so the shortest is taken whole
    assert sizes[1] == 3 * 303 + 2  # three whole texts of 303 bytes and the spaces between them


@pytest.mark.parametrize("name", ["op3_benchmark_decontamination", "op7_near_dedup", "op8_embedding_dedup", "op10_secret_scan"])
def test_sql(same_as_sql, name):
    same_as_sql(name)


def test_model_of_a_large_sample_takes_little_memory():
    import random
    import tracemalloc

    import numpy as np

    from graphquarry.llm.language import Model

    rng = random.Random(3)
    sample = " ".join(f"{rng.choice('abcdefgh') * 2}{rng.randrange(10**4):x}" for _ in range(6000)).encode()
    tracemalloc.start()
    model = Model({"x": sample})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 * len(sample)
    assert model.phrases(np.frombuffer(sample, np.uint8), np.array([0, len(sample)])).tolist() == [[1]]


def test_automaton_has_the_substrings_alone():
    import random

    from graphquarry.llm.language import automaton

    rng = random.Random(5)
    for n in (0, 1, 2, 30, 60):
        codes = [rng.randrange(1, 4) for _ in range(n)]
        edges = automaton(codes)
        found, todo = set(), [((), 0)]
        while todo:
            word, state = todo.pop()
            found.add(word)
            todo += [((*word, c), t) for c, t in edges[state].items()]
            assert all(edges.get(state, c) == edges[state].get(c, 0) for c in range(4))
        assert found == {tuple(codes[i:j]) for i in range(n + 1) for j in range(i, n + 1)}


def test_tidy_trims_the_driver(spark, monkeypatch):
    from graphquarry.llm import common

    version = spark._jvm.java.lang.Runtime.version()
    assert common.trim_driver(spark) or (version.feature(), version.update()) < (17, 9)
    done = []
    monkeypatch.setattr(common, "trim_driver", done.append)
    common.tidy(spark)
    assert done == [spark]
