import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def plain(v):
    if v is None:
        return "None"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 5) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def same(spark):
    """Compare a query with its SQL in DuckDB, as sorted rows."""

    def check(f, sql):
        con = duckdb.connect()
        con.execute("set TimeZone = 'UTC'; set temp_directory = ''; set memory_limit = '4GB'")
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        got, want = f(spark, SF), con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        names = sorted(got.columns)
        at = [want.columns.index(c) for c in names]
        a = sorted("|".join(plain(r[c]) for c in names) for r in got.collect())
        b = sorted("|".join(plain(r[i]) for i in at) for r in want.fetchall())
        assert a == b

    return check
