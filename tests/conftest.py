import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


def same(spark_df, sql, sf=SF):
    """Rows of a query and of its SQL, as sorted text."""
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"create view {t.split('.')[0]} as select * from '{sf}/{t}'")
    a, b = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    cols = sorted(a.columns)
    # a column of integers with nulls is one of floats on one side
    whole = lambda x: int(x) if isinstance(x, float) and x.is_integer() and abs(x) < 2**53 else x
    a, b = a.map(whole), b.map(whole)
    shape = lambda x: sorted(map(tuple, x[cols].astype(str).replace({"None": "nan", "<NA>": "nan"}).values))
    assert shape(a) == shape(b)
