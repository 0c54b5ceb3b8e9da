"""Every query of the library against its SQL, on the smallest tables."""
import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df):
    def one(v):
        if v is None or (not isinstance(v, (str, bytes, tuple, list, np.ndarray)) and pd.isna(v)):
            return None
        if isinstance(v, (bool, np.bool_)):
            return bool(v)
        if hasattr(v, "isoformat"):
            return str(pd.Timestamp(v))
        if isinstance(v, (str, bytes)):
            return v
        return float(f"{float(v):.9g}")

    return sorted(repr([one(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_division_by_zero_rounds_ties_as_sql(spark, tmp_path):
    """Quotients that lie beside a tie of the sixth digit, large and small ones, both signs, no value; infinities."""
    con = duckdb.connect()
    sides = "range(3000) t(i), range(3, 6) r(j), range(2) s(s)"
    rows = f"""SELECT (3 * i + j - 3) * 2 + s AS l_orderkey, 0 AS l_linenumber, (2 * i + 1) * (1 - 2 * s)::DOUBLE AS l_quantity, 20 * 10.0::DOUBLE ** j AS l_discount FROM {sides}
        UNION ALL SELECT * FROM (VALUES (90001, 0, 7.0, 0.0), (90002, 0, NULL, 3.0), (90003, 0, 1.0, NULL), (90004, 0, 1e12, 0.07), (90005, 0, -1e300, 1e-3), (90006, 0, 'nan'::DOUBLE, 2.0), (90007, 0, 0.0, 2.0))"""
    con.execute(f"COPY ({rows}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet')")
    got = {r.k: repr(r.q) for r in queries.QUERIES["division_by_zero"](spark, str(tmp_path)).withColumn("q", F.col("q") + F.lit(0.0)).collect()}
    want = {k: repr(q) for k, q in con.execute(f"SELECT k, q + 0.0::DOUBLE FROM ({queries.SQL['division_by_zero']})").fetchall()}
    assert len(got) == 18_007 and {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
