"""Scores of a graph's nodes against the words of tasks: where a task starts.

Terms are matched against distinct names, not against nodes, so that a name that many nodes bear is matched once.
All functions take many tasks (task, text) at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions.text import STOP_WORDS, matches, named_paths, own_name, quoted_phrases, task_terms
from .traverse import cut

BROAD, RELATIVE, LEAST, LIMIT, NAMED = 25, 0.15, 2.0, 60, 3


def terms_of(tasks: DataFrame) -> DataFrame:
    """(task, nth, term): the terms of each task in order, without stop words."""
    return tasks.select("task", F.posexplode(task_terms(F.col("text"), STOP_WORDS)).alias("nth", "term"))


def term_hits(terms: DataFrame, names: DataFrame) -> DataFrame:
    """(term, name) for distinct terms and names that match; terms are few, so they are what is broadcast."""
    return names.select("name").where("name is not null").distinct().join(F.broadcast(terms.select("term").distinct()), matches(F.col("term"), F.col("name")))


def _searchable(facts: Facts) -> DataFrame:
    names = [
        facts.functions.select(own_name(F.col("name")).alias("name")), facts.types.select("name"), facts.models.select("name"),
        facts.fields.select(F.concat_ws(".", "model", "name").alias("name")), facts.routes.select(F.col("path").alias("name")), facts.files.select(F.col("path").alias("name")),
    ]
    out = names[0]
    for n in names[1:]:
        out = out.union(n)
    return out


def rarity_weights(facts: Facts, terms: DataFrame, broad: int = BROAD) -> DataFrame:
    """(task, term, hits, weight): a term that more than `broad` names match counts less; the strongest term of a task counts 1."""
    counts = _searchable(facts).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    hits = term_hits(terms, counts).join(counts, "name").groupBy("term").agg(F.sum("n").alias("hits"))
    weighted = terms.select("task", "term").distinct().join(hits, "term", "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    raw = F.when(F.col("hits") == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.lit(float(broad)) / F.col("hits")))
    best = F.max(raw).over(Window.partitionBy("task"))
    return weighted.select("task", "term", "hits", F.when(best == 0, F.lit(0.0)).otherwise(raw / best).alias("weight"))


def _signals(hits: DataFrame, terms: DataFrame, nodes: DataFrame, name: Column, kind: str) -> DataFrame:
    """(task, key, n, sum, terms) of one way of matching: the nodes' names against all terms."""
    of = nodes.select("key", name.alias("name"))
    met = of.join(hits, "name").join(terms, "term")
    return met.groupBy("task", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("sum"), F.transform(F.sort_array(F.collect_list(F.struct("nth", "term"))), lambda t: t["term"]).alias("terms")).select("task", "key", *[F.col(c).alias(f"{kind}_{c}") for c in ("n", "sum", "terms")])


def _zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0.0))


def scores(facts: Facts, tasks: DataFrame, weighting: bool = False) -> DataFrame:
    """(task, key, kind, name, file, score, why): every node that a term of the task matches; keys as text."""
    terms = terms_of(tasks)
    weight = rarity_weights(facts, terms).select("task", "term", "weight") if weighting else None
    terms = cut(terms.join(weight, ["task", "term"]) if weighting else terms.withColumn("weight", F.lit(1.0)))
    listed = lambda column, text: F.when(F.size(column) > 0, F.concat(F.lit(text), F.array_join(column, ", ")))
    out = []

    def add(df: DataFrame, kind: str, name: Column, file: Column, score: Column, why: Column) -> None:
        out.append(df.select("task", F.col("key").cast("string").alias("key"), F.lit(kind).alias("kind"), name.alias("name"), file.alias("file"), score.alias("score"), why.alias("why")))

    none = F.lit(None).cast("string")
    hits = lambda names: cut(term_hits(terms, names))
    r = facts.routes
    add(_signals(hits(r.select(F.col("path").alias("name"))), terms, r, F.col("path"), "m").join(r, "key"), "route", F.concat_ws(" ", "method", "path"), F.col("file"), F.col("m_sum") * 4, listed(F.col("m_terms"), "route path matches "))
    m = facts.models
    by_model = hits(m.select("name"))
    add(_signals(by_model, terms, m, F.col("name"), "m").join(m.drop("file"), "key"), "model", F.col("name"), none, F.col("m_sum") * 3, listed(F.col("m_terms"), "model name matches "))
    f = facts.fields
    own = _signals(hits(f.select("name")), terms, f, F.col("name"), "m")
    owner = _signals(hits(f.select(F.col("model").alias("name"))), terms, f, F.col("model"), "o")
    fields = own.join(owner, ["task", "key"], "left").join(f, "key")
    score = F.col("m_sum") * 2 + F.when(F.col("is_unique"), F.col("m_sum") * 2).otherwise(0.0) + F.when(F.col("o_n") > 0, F.col("o_sum") * 3).otherwise(-3.0)
    why = F.concat_ws("", listed(F.col("m_terms"), "field matches "), F.when(F.col("is_unique"), F.lit(" (unique constraint)")), listed(F.col("o_terms"), " on model matching "))
    add(fields, "field", F.concat_ws(".", "model", "name"), none, score, why)
    t = facts.types
    kind_why = F.concat(F.col("kind"), F.lit(" name matches "), F.array_join("m_terms", ", "))
    add(_signals(hits(t.select("name")), terms, t, F.col("name"), "m").join(t, "key"), "type", F.col("name"), F.col("file"), F.col("m_sum") * F.when(F.col("exported"), 4).otherwise(3), kind_why)

    fn = facts.functions
    named_ = own_name(F.col("name"))
    name_hits, path_hits = hits(fn.select(named_.alias("name"))), hits(fn.select(F.col("file").alias("name")))
    lines = fn.select("key", F.explode("text").alias("line"))
    text_hits = hits(lines.select(F.col("line").alias("name")))
    said = lines.join(text_hits, F.col("line") == F.col("name")).select("key", "term").distinct().join(terms, "term")
    said = said.groupBy("task", "key").agg(F.count(F.lit(1)).alias("t_n"), F.sum("weight").alias("t_sum"), F.transform(F.sort_array(F.collect_list(F.struct("nth", "term"))), lambda x: x["term"]).alias("t_terms"))
    phrases = tasks.select("task", F.explode(quoted_phrases(F.col("text"))).alias("phrase"))
    line = F.lower("line")
    exact = lines.join(F.broadcast(phrases), F.contains(line, F.col("phrase")) | F.contains(F.col("phrase"), line)).select("task", "key", F.lit(True).alias("verbatim")).distinct()
    s = _signals(name_hits, terms, fn, named_, "n").join(_signals(path_hits, terms, fn, F.col("file"), "p"), ["task", "key"], "full").join(said, ["task", "key"], "full")
    s = s.join(exact, ["task", "key"], "left").join(fn, "key")
    lowered = F.lower(named_)
    is_name = F.coalesce(F.exists("n_terms", lambda x: (lowered == x) | (lowered == F.concat(x, F.lit("s")))), F.lit(False))
    both = F.coalesce(F.arrays_overlap("n_terms", "p_terms"), F.lit(False))
    score = _zero("n_sum") * 3 + _zero("p_sum") + _zero("t_sum") * 2
    for holds, factor in ((is_name, 2.5), (both, 1.6), (F.col("exported"), 1.3), (F.col("is_test"), 0.5), (F.coalesce(F.col("t_n") >= 2, F.lit(False)), 1.8)):
        score = F.when(holds, score * factor).otherwise(score)
    score = F.when(F.col("verbatim"), F.greatest(score, F.lit(1.0)) * 6).otherwise(score)
    why = F.concat_ws("; ", listed(F.col("n_terms"), "name matches "), listed(F.col("p_terms"), "path matches "), F.when(F.col("verbatim"), F.lit("says the exact words the task quoted")), listed(F.col("t_terms"), "says "))
    add(s, "function", F.col("name"), F.col("file"), score, why)
    every = out[0]
    for o in out[1:]:
        every = every.union(o)
    return every


def named_files(facts: Facts, tasks: DataFrame, most: int = NAMED) -> DataFrame:
    """(task, path): files that a task names outright; none of a task if a name fits no file or too many, or if it names too many."""
    wanted = tasks.select("task", named_paths(F.col("text")).alias("all")).where(F.size("all").between(1, most)).select("task", F.explode("all").alias("wanted"))
    lower = F.lower("path")
    fits = (lower == F.col("wanted")) | F.endswith(lower, F.concat(F.lit("/"), F.col("wanted")))
    hits = cut(wanted.join(facts.files.select("path"), fits, "left"))
    n = hits.groupBy("task", "wanted").agg(F.count("path").alias("n"))
    allowed = F.when(F.contains("wanted", F.lit("/")), F.lit(most)).otherwise(F.lit(1))
    bad = n.where((F.col("n") == 0) | (F.col("n") > allowed)).select("task")
    found = hits.select("task", "path").distinct().join(bad, "task", "left_anti")
    few = found.groupBy("task").count().where(F.col("count") <= most).select("task")
    return found.join(few, "task", "left_semi")


def anchors(facts: Facts, tasks: DataFrame, *, limit: int = LIMIT, least: float = LEAST, weighting: bool = False, named_seeds: bool = True) -> DataFrame:
    """(task, key, kind, name, file, score, why, rank): the best nodes of each task, from rank 0.

    Where a task names files outright, all functions in them are its anchors; else nodes of at least `least` and a
    share of the best score. Equal scores rank by name and key.
    """
    scored = cut(scores(facts, tasks, weighting))
    best = F.max("score").over(Window.partitionBy("task"))
    usual = scored.withColumn("best", best).where(F.col("score") >= F.greatest(F.lit(least), F.col("best") * RELATIVE)).drop("best")
    if named_seeds:
        files = cut(named_files(facts, tasks))
        note = lambda text: F.concat(F.lit(text), F.col("file"), F.lit(", which the task named"))
        there = facts.functions.select(F.col("key").cast("string").alias("key"), "name", "file").join(files.withColumnRenamed("path", "file"), "file")
        known = scored.where("kind = 'function'").select("task", "key", "score", "why")
        there = there.join(known, ["task", "key"], "left")
        there = there.select("task", "key", F.lit("function").alias("kind"), "name", "file", F.coalesce("score", F.lit(0.5)).alias("score"), F.when(F.col("score").isNull(), note("declared in ")).otherwise(F.concat(F.col("why"), note("; in "))).alias("why"))
        usual = usual.join(there.select("task").distinct(), "task", "left_anti").select(*there.columns).union(there)
    rank = F.row_number().over(Window.partitionBy("task").orderBy(F.desc("score"), "name", "key")) - 1
    return usual.withColumn("rank", rank).where(F.col("rank") < limit)


def search_view(facts: Facts, tasks: DataFrame, limit: int = 15, of_each: int = 4) -> DataFrame:
    """(task, nth, key, kind, name, file, score): up to four of each kind but functions first, then the others in order of rank."""
    found = anchors(facts, tasks, weighting=True, named_seeds=False)
    of_kind = F.row_number().over(Window.partitionBy("task", "kind").orderBy("rank"))
    first = (F.col("kind") != "function") & (F.col("of_kind") <= of_each)
    nth = F.row_number().over(Window.partitionBy("task").orderBy(F.when(first, 0).otherwise(1), "rank"))
    return found.withColumn("of_kind", of_kind).withColumn("nth", nth).where(F.col("nth") <= limit).select("task", "nth", "key", "kind", "name", "file", "score")
