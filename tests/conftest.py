import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    home = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", home).config("spark.sql.warehouse.dir", f"{home}/warehouse")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        table = name.removesuffix(".parquet")
        con.execute(f"create view {table} as select * from '{SF}/{name}'")
    return con


@pytest.fixture(scope="session")
def same():
    """Compare two pandas frames by sorted columns and rows; floats to six digits."""

    def norm(df):
        df = df[sorted(df.columns)].copy()
        for c in df.columns:
            if df[c].dtype.kind in "fiu":
                df[c] = df[c].astype("float64").round(6)
            df[c] = df[c].astype(object).where(df[c].notna(), None).astype(str)
        return df.sort_values(list(df.columns)).reset_index(drop=True)

    def check(got, want):
        assert sorted(got.columns) == sorted(want.columns)
        a, b = norm(got), norm(want)
        assert len(a) == len(b)
        assert a.equals(b), a.compare(b).head()

    return check
