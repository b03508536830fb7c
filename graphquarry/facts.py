"""The facts of one snapshot of a code base: six node and four edge relations.

Keys may be of any type. `calls`, `references` and `touches` hold sites: an edge may have several.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

NODES = {
    "files": "key string, path string",
    "functions": "key string, name string, file string, line int, end_line int, exported boolean, is_component boolean, is_test boolean, text array<string>, root string",
    "types": "key string, name string, kind string, file string, line int, exported boolean",
    "routes": "key string, method string, path string, handler_key string, file string, line int",
    "models": "key string, name string, file string",
    "fields": "key string, model string, name string, type string, is_unique boolean, is_id boolean",
}
EDGES = {
    "calls": "from_key string, to_key string, file string, line int, via_render boolean, via_contains boolean",
    "references": "from_key string, to_key string, file string, line int",
    "touches": "from_key string, model_key string, operation string, is_write boolean, file string, line int",
    "imports": "from_file_key string, to_file_key string",
}
RELATIONS = NODES | EDGES


@dataclass(frozen=True)
class Facts:
    files: DataFrame
    functions: DataFrame
    types: DataFrame
    routes: DataFrame
    models: DataFrame
    fields: DataFrame
    calls: DataFrame
    references: DataFrame
    touches: DataFrame
    imports: DataFrame

    def relations(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in RELATIONS}

    def replaced(self, **relations: DataFrame) -> Facts:
        return Facts(**(self.relations() | relations))


def empty(spark: SparkSession) -> Facts:
    return Facts(**{name: spark.createDataFrame([], schema) for name, schema in RELATIONS.items()})


def of_rows(spark: SparkSession, **rows: list[tuple]) -> Facts:
    """Facts from plain rows; relations that are left out are empty."""
    return Facts(**{name: spark.createDataFrame(rows.get(name, []), schema) for name, schema in RELATIONS.items()})


def write(facts: Facts, folder: str) -> None:
    """Write a snapshot: a Parquet table for each relation, and a mark at the end; readers take a folder with the mark only."""
    for name, df in facts.relations().items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = facts.files.sparkSession
    spark.createDataFrame([(1,)], "version int").write.mode("overwrite").json(f"{folder}/complete")


def read(spark: SparkSession, folder: str) -> Facts | None:
    """The snapshot in a folder, or None if there is no complete one of this version."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/complete/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    if spark.read.schema("version int").json(f"{folder}/complete").where("version = 1").isEmpty():
        return None
    return Facts(**{name: spark.read.parquet(f"{folder}/{name}") for name in RELATIONS})
