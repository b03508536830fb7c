"""A corpus pipeline: language, near copies, benchmark passages, secrets, mixture.

Every stage takes documents and returns documents with all their columns; the last adds the mixture's columns (size,
source_size, target, copies, taken). A row is judged by its own text, whatever its id: stages that drop rows number
them first. Of near copies, and of rows that repeat both id and text, that of the least id stays (one without id only
where none has an id). Columns that are named like a stage's own are kept; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphquarry.llm.common import cut, free_name, new_folder, small, tidy
from graphquarry.llm.decontaminate import contamination
from graphquarry.llm.language import UNDETERMINED, identify
from graphquarry.llm.mix import mixed
from graphquarry.llm.near import near_duplicates
from graphquarry.llm.secrets import redact

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _numbered(spark: SparkSession, docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`docs` with a number for each row that every reader sees alike, and that column's name.

    Rows of files are numbered by their file's number and their place in it. Other rows are written once, numbered.
    """
    row = free_name(docs, "_row")
    try:
        placed = docs.select("*", F.col("_metadata.file_path").alias(f"{row}file"), F.col("_metadata.row_index").alias(f"{row}nth"))
    except AnalysisException:  # rows that do not come from files have no place
        folder = new_folder(spark, name)
        docs.withColumn(row, F.monotonically_increasing_id()).write.parquet(folder)
        return spark.read.parquet(folder), row
    files = placed.select(f"{row}file").distinct().withColumn(f"{row}of", F.row_number().over(Window.orderBy(f"{row}file")).cast("long"))
    number = F.shiftleft(f"{row}of", 40).bitwiseOR(F.col(f"{row}nth")).alias(row)
    return placed.join(small(cut(files)), f"{row}file").select(*docs.columns, number), row


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told."""
    found = identify(docs)
    return found.where(F.col(found.columns[-2]) != UNDETERMINED).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the least id. Texts without words are copies only of equal rows."""
    rows, row = _numbered(spark, docs, "near-rows")
    found = near_duplicates(rows, doc_id=row).select(F.col(row), F.col("n_shingles") > 0, "component_id").toDF("row", "words", "component")
    wordless = F.when(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.col("text")).alias("text")
    groups = rows.select(F.col(row).alias("row"), "doc_id", wordless).join(found, "row").groupBy("words", F.when(F.col("words"), F.col("component")), F.when(~F.col("words"), F.col("doc_id")), "text")
    kept = groups.agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("least")).select(F.col("least.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more of the benchmark than the contract allows."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows, row = _numbered(spark, docs, "decontaminate-rows")
    bad = contamination(rows, items, doc_id=row).where("contaminated").select(row)
    return rows.join(bad, row, "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, whole, and how often: its columns stand beside the documents' own."""
    rows, row = _numbered(spark, docs, "mixing-rows")
    found = mixed(rows, row)
    return found.where(F.col(found.columns[-2]) > 0).drop(row)


def _tidied(stage: Stage) -> Stage:
    """`stage`, begun without what the stages before it left in the driver."""

    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        tidy(spark)
        return stage(spark, docs, sf_dir)

    return begin


STAGES: list[tuple[str, Stage]] = [
    ("language", _tidied(language)),
    ("near_dedup", _tidied(near_dedup)),
    ("decontaminate", _tidied(decontaminate)),
    ("secrets", _tidied(secrets)),
    ("mixing", _tidied(mixing)),
]

#: Language identification and near-duplicate search have no SQL twin; tests/llm/test_pipeline.py compares the rows with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
