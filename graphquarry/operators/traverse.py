"""Traversal by levels. Each level joins the frontier with the edges on their common key; nothing is collected."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Compute `df` once, into the checkpoint folder that the session names (its own only where none is set, on one machine)."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="graphquarry-"))
    return df.checkpoint(eager=True)


def reach(seeds: DataFrame, edges: DataFrame, depth: int, *, inward: bool = False, both: bool = False) -> DataFrame:
    """(key, distance) of all that `seeds` (key) reach in at most `depth` steps along `edges` (src, dst), seeds at 0."""
    if both:
        steps = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        steps = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if inward else edges.select("src", "dst")
    steps = cut(steps.where("src is not null and dst is not null").distinct())
    seen = cut(seeds.select("key").where("key is not null").distinct().withColumn("distance", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        met = frontier.select(F.col("key").alias("src")).join(steps, "src").select(F.col("dst").alias("key")).distinct()
        frontier = cut(met.join(seen, "key", "left_anti").withColumn("distance", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def reach_each(starts: DataFrame, edges: DataFrame, depth: int, *, inward: bool = False, both: bool = False) -> DataFrame:
    """(origin, key, distance): what each of `starts` (origin, key) reaches, as `reach` does for all seeds together."""
    out, back = edges.select("src", "dst"), edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    steps = cut((out.union(back) if both else back if inward else out).where("src is not null and dst is not null").distinct())
    seen = cut(starts.select("origin", "key").where("key is not null").distinct().withColumn("distance", F.lit(0)))
    frontier = seen
    for level in range(1, depth + 1):
        met = frontier.select("origin", F.col("key").alias("src")).join(steps, "src").select("origin", F.col("dst").alias("key")).distinct()
        known = seen.select(F.col("origin").alias("_origin"), F.col("key").alias("_key"))
        frontier = cut(met.join(known, F.col("origin").eqNullSafe(F.col("_origin")) & (F.col("key") == F.col("_key")), "left_anti").withColumn("distance", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def ends_of_paths(starts: DataFrame, edges: DataFrame, least: int, most: int) -> DataFrame:
    """Distinct (origin, key): `key` lies at the end of a walk of `least` to `most` steps from `starts` (origin, key)."""
    steps = cut(edges.select("src", "dst").distinct())
    at, found = starts.select("origin", "key").distinct(), None
    for n in range(1, most + 1):
        at = cut(at.join(steps, at["key"] == steps["src"]).select("origin", F.col("dst").alias("key")).distinct())
        if n >= least:
            found = at if found is None else found.union(at)
    return found.distinct()
