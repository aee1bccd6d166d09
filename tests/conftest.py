import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    os.environ.setdefault("TZ", "UTC")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def normal(v):
    """Values in one spelling for both engines."""
    import datetime
    import decimal

    if v is None:
        return "~"
    if isinstance(v, (bool, str)):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}" if v else "0"
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    if hasattr(v, "asDict"):
        v = list(v.asDict().values())
    if isinstance(v, dict):
        v = list(v.values())
    if hasattr(v, "__iter__"):
        return "[" + ",".join(normal(x) for x in v) + "]"
    return str(v)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Runs a query and its SQL on the small tables and compares names and rows."""
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")

    def check(query, sql):
        df = query(spark, DATA)
        names = sorted(df.columns)
        got = sorted("|".join(normal(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
        rel = con.sql(sql)
        assert sorted(rel.columns) == names
        at = [rel.columns.index(n) for n in names]
        assert got == sorted("|".join(normal(r[i]) for i in at) for r in rel.fetchall())

    return check
