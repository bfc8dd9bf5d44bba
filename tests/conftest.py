import glob
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same():
    """Whether two frames hold the same rows, whatever their order."""

    def check(got, wanted):
        cols = sorted(wanted.columns)
        assert cols == sorted(got.columns)
        assert len(got) == len(wanted)
        a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, wanted))
        for c in cols:
            equal = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
            assert equal.all(), (c, a[~equal].head(), b[~equal].head())

    return check


@pytest.fixture(scope="session")
def sql():
    """DuckDB over the tables of a folder."""

    def run(folder, text):
        db = duckdb.connect()
        for f in glob.glob(f"{folder}/*.parquet"):
            db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f if os.path.isfile(f) else f + '/*.parquet'}')")
        return db.execute(text).df()

    return run
