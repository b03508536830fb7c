"""What a prompt does to the boundary of a running task: the same job, a wider one, another, or no signal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..facts import Facts
from ..functions.text import STOP_WORDS, STRUCTURAL, matches, named_identifiers, named_paths, task_terms
from .traverse import cut

MOST_TERMS, SPREAD, PASTED = 40, 8, 3
SOURCE_FILE = r"\.(tsx?|jsx?|prisma|json|css)$"


def name_index(facts: Facts) -> DataFrame:
    """(name, kind, file): every name of the graph."""
    none = F.lit(None).cast("string")
    kinds = [
        ("function", facts.functions, F.col("name"), F.col("file")), ("route", facts.routes, F.concat_ws(" ", "method", "path"), F.col("file")), ("model", facts.models, F.col("name"), none),
        ("type", facts.types, F.col("name"), F.col("file")), ("field", facts.fields, F.concat_ws(".", "model", "name"), none), ("file", facts.files, F.col("path"), F.col("path")),
    ]
    out = None
    for kind, table, name, file in kinds:
        one = table.select(name.alias("name"), F.lit(kind).alias("kind"), file.alias("file"))
        out = one if out is None else out.union(one)
    return out


def location(name, kind, file):
    """Where an entry lives: its file, or its model; a field lives at its model."""
    return F.coalesce(file, F.concat(F.lit("model:"), F.when(kind == "field", F.substring_index(name, ".", 1)).otherwise(name)))


def _folder_words(file):
    parts = F.slice(F.split(F.lower(file), "/"), 1, F.greatest(F.size(F.split(file, "/")) - 1, F.lit(0)))
    return F.flatten(F.transform(parts, lambda p: F.split(p, "[-_.]")))


def area_words(index: DataFrame) -> DataFrame:
    """(term): words of three letters or more in the names of folders."""
    return index.where("file is not null").select(F.explode(_folder_words(F.col("file"))).alias("term")).where(F.length("term") >= 3).distinct()


def boundary(members: DataFrame, anchors: DataFrame) -> DataFrame:
    """(task, names, files, core_names, core_files): what the members cover, and what the task is about (anchors and distance 0)."""
    near = F.col("distance") == 0
    of = lambda c, when=None: F.sort_array(F.collect_set(F.when(when, F.col(c)) if when is not None else F.col(c)))
    covered = members.groupBy("task").agg(of("name").alias("names"), of("file").alias("files"), of("name", near).alias("core_names"), of("file", near).alias("core_files"))
    said = anchors.groupBy("task").agg(of("name").alias("a_names"), of("file").alias("a_files"))
    both = covered.join(said, "task", "full")
    none = F.array().cast("array<string>")
    join = lambda a, b: F.sort_array(F.array_union(F.coalesce(a, none), F.coalesce(b, none)))
    return both.select("task", join("names", "a_names").alias("names"), join("files", "a_files").alias("files"), join("core_names", "a_names").alias("core_names"), join("core_files", "a_files").alias("core_files"))


def verdicts(prompts: DataFrame, index: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Per prompt (prompt, task, text): verdict, terms, inside, outside, focused, areas, named_outside and places.

    A term is inside if the task's boundary holds at least as many of the entries that it matches as the rest does.
    Things named outright decide first, then folders, then how focused the terms are.
    """
    none = F.array().cast("array<string>")
    view = prompts.join(boundaries, "task", "left")
    for c in ("names", "files", "core_names", "core_files"):
        view = view.withColumn(c, F.coalesce(F.col(c), none))
    plain = F.filter(task_terms(F.col("text"), STOP_WORDS), lambda t: ~t.isin(*STRUCTURAL))
    view = cut(view.withColumn("terms", F.slice(plain, 1, MOST_TERMS)).withColumn("low_names", F.transform("names", F.lower)))
    terms = cut(view.select("prompt", "task", F.posexplode("terms").alias("nth", "term")))
    hits = index.join(F.broadcast(terms.select("term").distinct()), matches(F.col("term"), F.col("name")) | F.coalesce(matches(F.col("term"), F.col("file")), F.lit(False)))
    hits = cut(hits.groupBy("term", "name", "kind", "file").agg(F.count(F.lit(1)).alias("n")))
    of_task = view.select("prompt", "low_names", "files")
    met = terms.join(hits, "term").join(of_task, "prompt")
    inside = F.array_contains("low_names", F.lower("name")) | F.coalesce(F.array_contains("files", F.col("file")), F.lit(False))
    met = met.withColumn("inside", inside).withColumn("place", location(F.col("name"), F.col("kind"), F.col("file")))
    per_term = met.groupBy("prompt", "nth", "term").agg(
        F.coalesce(F.sum(F.when(F.col("inside"), F.col("n"))), F.lit(0)).alias("i"), F.coalesce(F.sum(F.when(~F.col("inside"), F.col("n"))), F.lit(0)).alias("o"), F.collect_set(F.when(~F.col("inside"), F.col("place"))).alias("places")
    )
    is_in = (F.col("i") > 0) & (F.col("i") >= F.col("o"))
    per_term = per_term.join(area_words(index).withColumn("is_area", F.lit(True)), "term", "left").join(view.select("prompt", "core_files"), "prompt")
    under = F.size(F.filter("core_files", lambda f: F.array_contains(_folder_words(f), F.col("term"))))
    about = (F.size("core_files") > 0) & (under * 2 >= F.size("core_files"))
    per_term = per_term.withColumn("side", F.when(is_in, "in").when(F.col("o") > 0, "out").when(F.col("i") > 0, "in"))
    per_term = per_term.withColumn("focus", (F.col("side") == "out") & (F.size("places") <= SPREAD))
    per_term = per_term.withColumn("area", (F.col("side") == "out") & ~F.col("focus") & F.coalesce("is_area", F.lit(False)) & ~about)
    pick = lambda when: F.transform(F.sort_array(F.collect_list(F.when(when, F.struct("nth", "term")))), lambda t: t["term"])
    flat = lambda when: F.array_distinct(F.flatten(F.collect_list(F.when(when, F.col("places")))))
    sharp = F.slice(F.transform(F.sort_array(F.collect_list(F.when(F.col("focus"), F.struct(F.size("places").alias("n"), "term")))), lambda t: t["term"]), 1, 4)
    summed = per_term.groupBy("prompt").agg(
        pick(F.col("side") == "in").alias("inside"), pick(F.col("side") == "out").alias("outside"), sharp.alias("focused"), F.count(F.when(F.col("focus"), 1)).alias("n_focused"), pick(F.col("area")).alias("areas"),
        flat(F.col("side") == "out").alias("places"), F.size(flat(F.col("focus"))).alias("focused_places"),
    )
    # what a prompt names outright, and the job is not about
    said = view.select("prompt", "core_files", "core_names", F.explode(F.array_union(F.transform(named_paths(F.col("text")), lambda p: F.struct(F.lit("path").alias("kind"), p.alias("what"))), F.transform(named_identifiers(F.col("text")), lambda p: F.struct(F.lit("name").alias("kind"), p.alias("what"))))).alias("s")).select("prompt", "core_files", "core_names", "s.kind", "s.what")
    files, names = index.where("file is not null").select(F.lower("file").alias("f")).distinct(), index.select(F.lower("name").alias("f")).distinct()
    paths = said.where("kind = 'path'").where(~F.exists("core_files", lambda f: F.endswith(F.lower(f), F.col("what"))))
    known = files.join(F.broadcast(paths.select("what").distinct()), F.endswith("f", F.col("what"))).select("what", F.lit(True).alias("known")).distinct()
    paths = paths.join(known, "what", "left").where(F.coalesce("known", F.lit(False)) | F.col("what").rlike(SOURCE_FILE)).select("prompt", "what", F.lit(0).alias("k"))
    idents = said.where("kind = 'name'").where(~F.exists("core_names", lambda n: F.lower(n) == F.lower("what"))).join(names, F.lower("what") == F.col("f"), "left_semi").select("prompt", "what", F.lit(1).alias("k"))
    outright = paths.union(idents).groupBy("prompt").agg(F.transform(F.sort_array(F.collect_set(F.struct("k", "what"))), lambda x: x["what"]).alias("named_outside"))
    all_ = view.join(summed, "prompt", "left").join(outright, "prompt", "left")
    for c in ("inside", "outside", "focused", "areas", "places", "named_outside"):
        all_ = all_.withColumn(c, F.coalesce(F.col(c), none))
    n = lambda c: F.size(c)
    pasted = n("named_outside") > PASTED
    spread = F.size(F.array_union("places", "named_outside"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    verdict = (
        F.when((n("named_outside") > 0) & ~pasted, F.when((n("inside") > 0) | (n("names") == 0), "WIDENED").otherwise("NEW"))
        .when((n("areas") > 0) & ~pasted, "WIDENED")
        .when(pasted & (spread > SPREAD), "NO_SIGNAL")
        .when(~pasted & (n("outside") > 0) & (zero("focused_places") > SPREAD), "NO_SIGNAL")
        .when(~pasted & (n("outside") > 0) & (zero("n_focused") == 0), "NO_SIGNAL")
        .when((n("terms") == 0) | ((n("inside") == 0) & (n("outside") == 0)), "NO_SIGNAL")
        .when(n("outside") == 0, "SAME")
        .when(n("inside") == 0, "NEW")
        .otherwise("WIDENED")
    )
    return all_.select("prompt", "task", verdict.alias("verdict"), "terms", "inside", "outside", "focused", "areas", "named_outside", "places")

