import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("SILTSTONE_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from siltstone.session import ship

    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    """The smallest tables."""
    folder = f"{DATA}/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    return folder


@pytest.fixture(scope="session")
def sql(small):
    """The smallest tables in DuckDB."""
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(small):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{small}/{f}'")
    return con
