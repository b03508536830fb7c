import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture
def same_as_sql(spark, sf_dir):
    """Compare a registered query with its SQL twin, whole rows, in any order."""
    import duckdb

    import __spark_entry__ as entry

    def compare(name):
        con = duckdb.connect()
        for p in Path(sf_dir).glob("*.parquet"):
            con.sql(f"create view {p.stem} as select * from '{p}'")
        rel = con.sql(entry.oracle_sql()[name])
        columns = sorted(rel.columns)
        df = entry.queries()[name](spark, sf_dir)
        assert sorted(df.columns) == columns
        mine = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
        theirs = sorted(repr(r) for r in rel.project(", ".join(columns)).fetchall())
        assert mine == theirs

    return compare
