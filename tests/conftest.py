import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    base = tempfile.mkdtemp(prefix="spark-")
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"{base}/shared").config("spark.sql.warehouse.dir", f"{base}/warehouse").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


def plain(value):
    """Values as both engines may give them: numbers to 9 digits, missing ones as None."""
    import datetime
    import decimal
    import math

    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return None if isinstance(value, float) and math.isnan(value) else float(f"{float(value):.9g}")
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return str(value)


@pytest.fixture(scope="session")
def same():
    def check(df, duck, sql):
        got = df.collect()
        cur = duck.execute(sql)
        names = [x[0] for x in cur.description]
        assert sorted(names) == sorted(df.columns)
        want = cur.fetchall()
        key = lambda r: tuple((x is not None, str(x)) for x in r)
        a = sorted((tuple(plain(r[n]) for n in names) for r in got), key=key)
        b = sorted((tuple(plain(x) for x in r) for r in want), key=key)
        assert a == b

    return check
