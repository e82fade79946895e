import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from lodestone.shipping import ship

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return ship(s)


@pytest.fixture(scope="session")
def same_rows():
    """Run a query and its SQL on the smallest tables and compare the rows."""
    import duckdb
    import pandas as pd

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{d}/{f}'")

    def plain(x):
        if isinstance(x, list | tuple):
            return tuple(map(plain, x))
        if isinstance(x, float):
            return None if x != x else round(x, 6)
        return str(pd.Timestamp(x)) if hasattr(x, "isoformat") else x

    def check(spark, query, sql):
        df = query(spark, d)
        r = con.execute(sql)
        cols = [c[0] for c in r.description]
        want = sorted((plain([row[cols.index(c)] for c in sorted(cols)]) for row in r.fetchall()), key=repr)
        got = sorted((plain(list(row)) for row in df.select(*(f"`{c}`" for c in sorted(df.columns))).collect()), key=repr)
        assert sorted(cols) == sorted(df.columns)
        assert got == want
        assert got

    return check
