"""Files of a source tree, their hashes, and schema files, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import node_key
from ..functions.paths import content_hash, normalise_path, without_comment

# Folders that hold no schemas of the project's own, and how deep schemas may lie.
SKIPPED = ("node_modules", "migrations", "dist", "build", "out", ".next", "coverage", "generated")
DEPTH = 4
#: A configured list of files counts only if it covers so much of what is on disk.
COVERAGE = 0.6


def tree(spark: SparkSession, root: str, pattern: str = "*.{ts,tsx,prisma}") -> DataFrame:
    """(path, mtime_ms, size, content) of files below `root`, read by Spark."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    path = normalise_path(F.regexp_replace("path", "^file:/+", "/"), F.lit(root))
    return files.select(path.alias("path"), F.unix_millis("modificationTime").alias("mtime_ms"), F.col("length").alias("size"), F.col("content").cast("string").alias("content"))


def source_files(files: DataFrame) -> DataFrame:
    """Sources: .ts and .tsx, no declarations, nothing in hidden folders or node_modules."""
    hidden = F.exists(F.split("path", "/"), lambda p: F.startswith(p, F.lit(".")) | (p == "node_modules"))
    return files.where(F.col("path").rlike(r"\.tsx?$") & ~F.col("path").rlike(r"\.d\.ts$") & ~hidden)


def chosen_files(on_disk: DataFrame, configured: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """(path) to read: those asked for; else a configured list, if it covers enough of what is on disk; else all."""
    paths = on_disk.select("path")
    if only is not None:
        return paths.join(only.select("path"), "path", "left_semi")
    if configured is None:
        return paths
    listed = configured.select("path").distinct()
    covered = paths.join(listed, "path", "left_semi").count()
    return listed if covered >= COVERAGE * max(paths.count(), 1) else paths


def hashes(files: DataFrame, also: DataFrame | None = None) -> DataFrame:
    """(path, hash) of files and, as null, of those known before (path) that are gone."""
    now = files.select("path", content_hash(F.col("content")).alias("hash"))
    return now if also is None else now.join(also.select("path").distinct(), "path", "full")


def schema_files(files: DataFrame) -> DataFrame:
    """Schema files that lie no deeper than `DEPTH` folders and in no skipped or hidden one, in order."""
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    skipped = F.exists(folders, lambda p: p.isin(*SKIPPED) | F.startswith(p, F.lit(".")))
    return files.where(F.endswith("path", F.lit(".prisma")) & (F.size(folders) <= DEPTH) & ~F.coalesce(skipped, F.lit(False)))


def schemas(files: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """(models, fields) of schema files (path, content): of models, and of a model's fields, that repeat a name the first counts."""
    block = r"(?ms)^model\s+\w+\s*\{.*?^\}"
    blocks = files.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(block), F.lit(0))).alias("nth", "block"))
    models = blocks.select("path", "nth", F.regexp_extract("block", r"^model\s+(\w+)", 1).alias("model"), F.regexp_extract("block", r"(?s)\{(.*)\}$", 1).alias("body"))
    models = models.withColumn("_n", F.row_number().over(Window.partitionBy("model").orderBy("path", "nth"))).where("_n = 1")
    lines = models.select("model", F.posexplode(F.split("body", r"\r?\n")).alias("line", "raw")).withColumn("text", F.trim(without_comment(F.col("raw"))))
    shape = r"^(\w+)\s+([\w\[\]?]+)(.*)$"
    fields = lines.where(F.col("text").rlike(shape) & ~F.startswith("text", F.lit("@@")))
    part = lambda i: F.regexp_extract("text", shape, i)
    fields = fields.select("model", "line", part(1).alias("name"), part(2).alias("type"), part(3).rlike(r"@unique\b").alias("is_unique"), part(3).rlike(r"@id\b").alias("is_id"))
    fields = fields.withColumn("_n", F.row_number().over(Window.partitionBy("model", "name").orderBy("line"))).where("_n = 1")
    return (
        models.select(node_key(repo, "model", F.col("model")).alias("key"), F.col("model").alias("name"), F.col("path").alias("file")),
        fields.select(node_key(repo, "field", F.concat_ws(".", "model", "name")).alias("key"), "model", "name", "type", "is_unique", "is_id"),
    )
