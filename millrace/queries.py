"""Queries over the driver's tables, one or more for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import millrace as m

from .operators.arrays import LongArray
from .plans.expr import Expr, binary_math, unary
from .server.client import Client
from .server.service import Server
from .sources import resources
from .streaming import windows

#: Columns that put the rows of a table in order.
ORDER = {
    "lineitem": ("l_orderkey", "l_linenumber"), "orders": ("o_orderkey",), "customer": ("c_custkey",), "nation": ("n_nationkey",), "region": ("r_regionkey",),
    "part": ("p_partkey",), "supplier": ("s_suppkey",), "events": ("event_id",), "documents": ("doc_id",),
}


class Tables:
    """The tables of a folder as bound leaves, each read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> Expr:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        leaf = m.data(df, name=name, order=ORDER.get(name, ()), spark=self.spark)
        setattr(self, name, leaf)
        return leaf


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Columns rounded to so many digits as SQL's ``round`` does it: a double is scaled, rounded half away from zero and scaled back.

    Spark's rounds the shortest decimal of a double instead, so the two differ where scaling a
    double that lies beside a tie gives the tie, or the other way round.
    """

    def one(name: str, n: int):
        c, by = F.col(f"`{name}`"), 10.0**n
        if df.schema[name].dataType != T.DoubleType():
            return F.round(c, n)
        scaled = F.abs(c) * by
        whole = F.floor(scaled)
        near = (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)) / by
        # from 2^52 on a double has no fraction; infinities and NaN stay what they are
        return F.when(scaled < float(1 << 52), F.when(c < 0, -near).otherwise(near)).when(scaled < float("inf"), c * by / by).otherwise(c)

    return df.withColumns({name: one(name, n) for name, n in digits.items()})


def query(sql: str | None = None, digits: int | None = None, of: tuple[str, ...] = ()):
    """Register a query by its function's name; the floating-point columns ``of`` are rounded to ``digits``."""

    def put(build):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            made = build(Tables(spark, folder))
            df = made if isinstance(made, DataFrame) else m.frame(made, spark=spark)
            return rounded(df, dict.fromkeys(of, digits)) if of else df

        QUERIES[build.__name__] = run
        if sql:
            SQL[build.__name__] = sql
        return build

    return put


# -- split, apply, combine -------------------------------------------------------------------
@query(
    """SELECT l_returnflag, l_linestatus, round(avg(l_discount), 6) AS avg_disc, CAST(count(l_orderkey) AS BIGINT) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue,
    round(sum(l_quantity), 2) AS sum_qty FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def pricing_summary(t):
    s = t.lineitem[t.lineitem.l_shipdate <= "1998-09-02"]
    out = m.by(s[["l_returnflag", "l_linestatus"]], sum_qty=s.l_quantity.sum(), avg_disc=s.l_discount.mean(), n=s.l_orderkey.count(), revenue=(s.l_extendedprice * (1 - s.l_discount)).sum())
    return rounded(m.frame(out.sort(["l_returnflag", "l_linestatus"]), spark=t.spark), {"avg_disc": 6, "revenue": 2, "sum_qty": 2})


@query("SELECT o_orderpriority, CAST(max(o_custkey) AS BIGINT) AS hi, CAST(min(o_custkey) AS BIGINT) AS lo, CAST(count(DISTINCT o_custkey) AS BIGINT) AS who FROM orders GROUP BY 1")
def by_min_max_nunique(t):
    o = t.orders
    return m.by(o.o_orderpriority, lo=o.o_custkey.min(), hi=o.o_custkey.max(), who=o.o_custkey.nunique())


@query("SELECT year(o_orderdate) AS o_orderdate_year, round(sum(o_totalprice) / count(o_orderkey), 2) AS mean_price FROM orders GROUP BY 1", 2, ("mean_price",))
def by_expression_and_arithmetic(t):
    o = t.orders
    return m.by(o.o_orderdate.year, mean_price=o.o_totalprice.sum() / o.o_orderkey.count())


@query("SELECT n, CAST(count(*) AS BIGINT) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def by_of_by(t):
    o = t.orders
    first = m.by(o.o_custkey, n=o.o_orderkey.count())
    return m.by(first.n, customers=first.o_custkey.count())


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING sum(o_totalprice) > 1000000", 2, ("total",))
def by_having(t):
    o = t.orders
    s = m.by(o.o_custkey, total=o.o_totalprice.sum())
    return s[s.total > 1000000]


@query("SELECT l_returnflag, CAST(count(l_returnflag) AS BIGINT) AS count FROM lineitem GROUP BY 1")
def count_values(t):
    return t.lineitem.l_returnflag.count_values()


@query("SELECT k, CAST(count(*) AS BIGINT) AS n FROM (SELECT nullif(o_orderpriority, '1-URGENT') AS k FROM orders) GROUP BY 1")
def by_null_keys(t):
    df = t.spark.read.parquet(f"{t.folder}/orders.parquet").select(F.nullif(F.col("o_orderpriority"), F.lit("1-URGENT")).alias("k"), "o_orderkey")
    o = m.data(df, spark=t.spark)
    return m.by(o.k, n=o.nelements())


# -- reductions ------------------------------------------------------------------------------
@query(
    """SELECT CAST(count(l_quantity) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS nelements, CAST(count(DISTINCT l_quantity) AS BIGINT) AS nunique, max(l_quantity) AS max, min(l_quantity) AS min,
    round(avg(l_quantity), 6) AS mean, round(sum(l_quantity), 2) AS sum, round(var_pop(l_quantity), 6) AS var, round(stddev_pop(l_quantity), 6) AS std,
    round(var_samp(l_quantity), 6) AS var_u, round(stddev_samp(l_quantity), 6) AS std_u FROM lineitem""",
)
def summary_of_reductions(t):
    q = t.lineitem.l_quantity
    s = m.summary(
        count=q.count(), nelements=q.nelements(), nunique=q.nunique(), max=q.max(), min=q.min(), mean=q.mean(), sum=q.sum(), var=q.var(), std=q.std(), var_u=q.var(unbiased=True), std_u=q.std(unbiased=True)
    )
    return rounded(m.frame(s, spark=t.spark), {c: 2 if c == "sum" else 6 for c in ("mean", "sum", "var", "std", "var_u", "std_u")})


@query("SELECT bool_or(l_quantity > 49) AS any_big, bool_and(l_quantity > 0) AS all_some FROM lineitem")
def any_and_all(t):
    q = t.lineitem.l_quantity
    return m.summary(any_big=(q > 49).any(), all_some=(q > 0).all())


@query("SELECT round(sqrt(sum(l_tax * l_tax)), 6) AS l2, round(sum(abs(l_tax)), 6) AS l1, max(abs(l_tax)) AS linf, round(pow(sum(pow(abs(l_tax), 3)), 1.0 / 3), 6) AS l3 FROM lineitem", 6, ("l1", "l2", "l3"))
def vector_norms(t):
    x = t.lineitem.l_tax
    return m.summary(l1=x.vnorm(1), l2=x.vnorm(), l3=x.vnorm(3), linf=x.vnorm(m.inf))


@query("SELECT CAST(count(*) AS BIGINT) AS value FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)")
def nunique_of_rows(t):
    df = m.frame(t.lineitem[["l_returnflag", "l_linestatus"]].nunique(), spark=t.spark)
    return df.toDF("value")


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM orders")
def nrows(t):
    return m.frame(t.orders.nrows, spark=t.spark).toDF("n")


@query("SELECT round(max(o_totalprice) - min(o_totalprice), 2) AS spread FROM orders", 2, ("spread",))
def arithmetic_of_reductions(t):
    p = t.orders.o_totalprice
    return m.summary(spread=p.max() - p.min())


@query("SELECT round((count(*) FILTER (o_totalprice > 100000)) / count(*), 9) AS share FROM orders", 9, ("share",))
def share_of_rows(t):
    o = t.orders
    return (o[o.o_totalprice > 100000].o_orderkey.count() / o.o_orderkey.count()).label("share")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) FROM orders) - (SELECT avg(o_totalprice) FROM orders WHERE o_custkey % 2 = 0)")
def selection_by_two_reductions(t):
    o = t.orders
    return o[o.o_totalprice > o.o_totalprice.max() - o[o.o_custkey % 2 == 0].o_totalprice.mean()].o_orderkey


@query("SELECT round(stddev_pop(epoch_us(ts) / 1e6), 2) AS sd, round(avg(epoch_us(ts) / 1e6 - 946684800), 2) AS mean FROM events", 2, ("sd", "mean"))
def moments_of_time_differences(t):
    d = t.events.ts - dt.datetime(2000, 1, 1)
    return m.summary(sd=d.std().dt.total_seconds(), mean=d.mean().dt.total_seconds())


# -- projection and columns ------------------------------------------------------------------
@query("SELECT c_name, c_acctbal FROM customer")
def projection(t):
    return t.customer[["c_name", "c_acctbal"]]


@query("SELECT c_mktsegment FROM customer")
def field(t):
    return t.customer.c_mktsegment


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def drop_field(t):
    return t.customer.drop_field("c_name")


@query("SELECT c_acctbal AS balance FROM customer")
def label(t):
    return t.customer.c_acctbal.label("balance")


@query("SELECT n_nationkey AS id, n_name AS nation, n_regionkey FROM nation")
def relabel(t):
    return t.nation.relabel(n_nationkey="id", n_name="nation")


@query("SELECT s_name, s_acctbal * 2 AS twice, s_suppkey + s_nationkey AS both FROM supplier")
def merge(t):
    s = t.supplier
    return m.merge(s.s_name, twice=s.s_acctbal * 2, both=s.s_suppkey + s.s_nationkey)


@query("SELECT p_partkey, p_name, p_brand, p_type, p_retailprice, p_size + 1 AS p_size, p_retailprice / p_size AS per FROM part")
def transform(t):
    p = t.part
    return m.transform(p, p_size=p.p_size + 1, per=p.p_retailprice / p.p_size)


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS text, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders")
def coerce(t):
    o = t.orders
    return m.merge(o.o_orderkey, text=o.o_orderkey.coerce("string"), whole=o.o_totalprice.coerce("int64"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def cast(t):
    o = t.orders
    return m.merge(o.o_orderkey, o_custkey=o.o_custkey.cast("var * ?int64"))


@query("SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'done') AS status FROM orders")
def coalesce(t):
    df = t.spark.read.parquet(f"{t.folder}/orders.parquet").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("s"))
    o = m.data(df, "var * {o_orderkey: int64, s: ?string}", spark=t.spark)
    return m.merge(o.o_orderkey, status=m.coalesce(o.s, "done"))


# -- filters ---------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 40 AND l_discount <= 0.02) OR NOT (l_returnflag <> 'R') AND l_tax = 0.08")
def selection(t):
    x = t.lineitem
    return x[((x.l_quantity > 40) & (x.l_discount <= 0.02)) | (~(x.l_returnflag != "R") & (x.l_tax == 0.08))][["l_orderkey", "l_linenumber"]]


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def selection_by_reduction(t):
    o = t.orders
    return o[o.o_totalprice > o.o_totalprice.mean()][["o_orderkey", "o_totalprice"]]


@query("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE')")
def isin(t):
    c = t.customer
    return c[c.c_mktsegment.isin(["BUILDING", "AUTOMOBILE"])].c_custkey


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def isin_table(t):
    c, o = t.customer, t.orders
    return c[c.c_custkey.isin(o[o.o_totalprice > 300000].o_custkey)].c_custkey


@query("SELECT p_partkey, p_name FROM part WHERE regexp_full_match(p_name, '.*a.?.*') AND regexp_full_match(p_brand, 'Brand#[1-3].')")
def like(t):
    p = t.part
    return p[p.p_name.like("*a*") & p.p_brand.like("Brand#[1-3]?")][["p_partkey", "p_name"]]


@query("SELECT vec AS k, isnan(v) OR v IS NULL AS missing FROM (SELECT l_orderkey * 10 + l_linenumber AS vec, CASE WHEN l_tax = 0 THEN 'nan'::DOUBLE WHEN l_tax = 0.01 THEN NULL ELSE l_tax END AS v FROM lineitem)")
def isnan_and_null(t):
    tax = F.col("l_tax")
    df = t.spark.read.parquet(f"{t.folder}/lineitem.parquet").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.when(tax == 0, F.lit(float("nan"))).when(tax == 0.01, None).otherwise(tax).alias("v"))
    x = m.data(df, spark=t.spark)
    return m.merge(x.k, missing=x.v.isnan())


@query("SELECT k, v IS NOT NULL AS there FROM (SELECT o_orderkey AS k, nullif(o_orderstatus, 'F') AS v FROM orders)")
def notnull(t):
    df = t.spark.read.parquet(f"{t.folder}/orders.parquet").select(F.col("o_orderkey").alias("k"), F.nullif(F.col("o_orderstatus"), F.lit("F")).alias("v"))
    x = m.data(df, spark=t.spark)
    return m.merge(x.k, there=x.v.notnull())


# -- joins and concatenation -----------------------------------------------------------------
@query("SELECT c.c_custkey, c.c_name, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey")
def join_differing_keys(t):
    j = m.join(t.customer, t.nation, "c_nationkey", "n_nationkey")
    return j[["c_custkey", "c_name", "n_name"]]


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def join_left(t):
    return m.join(t.customer[["c_custkey", "c_name"]], t.orders[["o_orderkey", "o_custkey"]], "c_custkey", "o_custkey", how="left")


@query("SELECT s_nationkey AS k, s_name, c_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN customer ON s_nationkey = c_nationkey WHERE s_nationkey IS NOT NULL UNION ALL SELECT c_nationkey, NULL, c_name FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def join_right(t):
    s = t.supplier
    j = m.join(s[s.s_acctbal > 5000][["s_nationkey", "s_name"]], t.customer[["c_nationkey", "c_name"]], "s_nationkey", "c_nationkey", how="right")
    return j.relabel(s_nationkey="k")


@query("SELECT coalesce(a.k, b.k) AS k, CAST(a.n AS BIGINT) AS n_left, CAST(b.n AS BIGINT) AS n_right FROM (SELECT c_custkey % 40 AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a FULL JOIN (SELECT s_suppkey % 40 AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def join_outer_of_groups(t):
    c, s = t.customer, t.supplier
    c = c[c.c_acctbal > 9000]
    a = m.by((c.c_custkey % 40).label("k"), n=c.c_custkey.count())
    b = m.by((s.s_suppkey % 40).label("k"), n=s.s_suppkey.count())
    return m.join(a, b, "k", how="outer")


@query(
    """WITH a AS (SELECT nullif(c_nationkey, 3) AS k, c_custkey FROM customer), b AS (SELECT nullif(n_nationkey, 3) AS k, n_name FROM nation)
    SELECT coalesce(a.k, b.k) AS k, c_custkey, n_name FROM a FULL JOIN b ON a.k = b.k"""
)
def join_null_keys(t):
    """Null keys match nothing and are kept by an outer join."""
    null = lambda name, key: F.nullif(F.col(key), F.lit(3)).alias("k")
    read = lambda name, key, rest: m.data(t.spark.read.parquet(f"{t.folder}/{name}.parquet").select(null(name, key), rest), spark=t.spark)
    return m.join(read("customer", "c_nationkey", "c_custkey"), read("nation", "n_nationkey", "n_name"), "k", how="outer")


@query("SELECT a.n_regionkey, a.n_name AS n_name_left, b.n_name AS n_name_right FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_self(t):
    n = t.nation[["n_name", "n_regionkey"]]
    return m.join(n, n, "n_regionkey")


@query("SELECT r_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1", 2, ("total",))
def join_chain(t):
    j = m.join(m.join(m.join(t.orders, t.customer, "o_custkey", "c_custkey"), t.nation, "c_nationkey", "n_nationkey"), t.region, "n_regionkey", "r_regionkey")
    return m.by(j.r_name, total=j.o_totalprice.sum())


@query("SELECT l_orderkey, l_linenumber, l_suppkey, s_name, p_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_quantity > 45")
def join_then_filter(t):
    j = m.join(m.join(t.lineitem, t.supplier, "l_suppkey", "s_suppkey"), t.part, "l_partkey", "p_partkey")
    return j[j.l_quantity > 45][["l_orderkey", "l_linenumber", "l_suppkey", "s_name", "p_name"]]


@query("SELECT o_orderkey, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0")
def foreign_key(t):
    o = m.link(t.orders, "o_custkey", t.customer, "c_custkey")
    s = m.merge(o.o_orderkey, segment=o.o_custkey.c_mktsegment)
    return s[o.o_custkey.c_acctbal > 0]


@query("SELECT o_custkey AS k FROM orders UNION ALL SELECT c_custkey FROM customer")
def concat(t):
    return m.concat(t.orders[["o_custkey"]].relabel(o_custkey="k"), t.customer[["c_custkey"]].relabel(c_custkey="k"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return m.concat(t.customer[["c_nationkey"]].relabel(c_nationkey="k"), t.supplier[["s_nationkey"]].relabel(s_nationkey="k")).distinct()


# -- order -----------------------------------------------------------------------------------
@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def sort_head(t):
    return t.orders[["o_orderkey", "o_totalprice"]].sort(["o_totalprice", "o_orderkey"], ascending=False).head(25)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
def sort_tail(t):
    return t.orders[["o_orderkey", "o_totalprice"]].sort(["o_totalprice", "o_orderkey"]).tail(25)


@query("SELECT o_orderkey, o_totalprice + o_custkey AS k FROM orders ORDER BY k, o_orderkey")
def sort_by_expression_whole(t):
    o = t.orders
    return m.merge(o.o_orderkey, k=o.o_totalprice + o.o_custkey).sort(["k", "o_orderkey"])


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey OFFSET 40 LIMIT 60")
def slice_range(t):
    return t.orders[["o_orderkey", "o_custkey"]][40:100]


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) WHERE i % 7 = 3")
def slice_step(t):
    return t.orders[["o_orderkey"]][3::7]


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS i FROM orders) WHERE i IN (1, 5) UNION ALL SELECT min(o_orderkey) FROM orders")
def slice_list(t):
    return t.orders[["o_orderkey"]][[0, -1, -5]]


@query("SELECT event_id, lag(value, 2) OVER (ORDER BY event_id) AS before FROM events")
def shift_back(t):
    e = t.events
    return m.merge(e.event_id, before=e.value.shift(2))


@query("SELECT event_id, round(value - lag(value, 1) OVER (ORDER BY event_id), 6) AS rise, lead(value, 1) OVER (ORDER BY event_id) AS after FROM events", 6, ("rise",))
def shift_difference(t):
    e = t.events
    return m.merge(e.event_id, rise=e.value - e.value.shift(1), after=e.value.shift(-1))


@query("SELECT event_id FROM (SELECT event_id, value, lag(value, 1) OVER (ORDER BY event_id) AS p FROM events) WHERE value > p")
def selection_by_shift(t):
    e = t.events
    return e[e.value > e.value.shift(1)].event_id


@query("SELECT lead(n_name, 1) OVER (ORDER BY n_nationkey) AS n_name FROM nation")
def shift_ahead(t):
    return t.nation.n_name.shift(-1)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey OFFSET 40")
def slice_open(t):
    return t.orders[["o_orderkey", "o_custkey"]][40:]


@query("SELECT least(100, count(*))::BIGINT AS drawn, least(100, count(*))::BIGINT AS different, least(100, count(*))::BIGINT AS members FROM orders")
def sample_members(t):
    """Drawn rows are different rows of the table."""
    o = t.orders[["o_orderkey", "o_totalprice"]]
    drawn = m.frame(o.sample(n=100, seed=5), spark=t.spark)
    found = drawn.join(m.frame(o, spark=t.spark), ["o_orderkey", "o_totalprice"], "left_semi")
    return drawn.agg(F.count(F.lit(1)).alias("drawn"), F.count_distinct("o_orderkey").alias("different")).join(found.agg(F.count(F.lit(1)).alias("members")))


@query("SELECT least(100, count(*))::BIGINT AS n FROM orders")
def sample_n(t):
    return m.frame(t.orders.sample(n=100, seed=3).nrows, spark=t.spark).toDF("n")


@query("SELECT floor(count(*) * 0.25 + 0.5)::BIGINT AS n FROM orders")
def sample_frac(t):
    return m.frame(t.orders.sample(frac=0.25, seed=3).nrows, spark=t.spark).toDF("n")


@query("SELECT DISTINCT l_shipdate::DATE AS day, l_returnflag FROM lineitem")
def distinct_rows(t):
    x = t.lineitem
    return m.merge(x.l_shipdate.date.label("day"), x.l_returnflag).distinct()


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) WHERE i = 1")
def distinct_on(t):
    return t.orders[["o_custkey", "o_orderkey"]].distinct("o_custkey")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def distinct_on_any(t):
    df = t.spark.read.parquet(f"{t.folder}/orders.parquet").select("o_custkey", "o_orderkey")
    return m.data(df, spark=t.spark).distinct("o_custkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) AS i FROM orders) WHERE i = 1")
def distinct_on_descending(t):
    return t.orders.sort(["o_totalprice", "o_orderkey"], ascending=False).distinct("o_custkey")[["o_custkey", "o_orderkey"]]


# -- arithmetic and mathematics --------------------------------------------------------------
@query("SELECT o_orderkey, o_custkey * 2 - 7 AS a, o_totalprice / 3 AS b, CAST(floor(-o_custkey / 7.0) AS BIGINT) AS c, ((-o_custkey % 7) + 7) % 7 AS d, -o_custkey AS e, pow(o_custkey, 2)::DOUBLE AS f FROM orders", 6, ("b",))
def arithmetic(t):
    o = t.orders
    k = o.o_custkey
    return m.merge(o.o_orderkey, a=k * 2 - 7, b=o.o_totalprice / 3, c=(-k) // 7, d=(-k) % 7, e=-k, f=k**2)


SQL["arithmetic"] = SQL["arithmetic"].replace("o_totalprice / 3 AS b", "round(o_totalprice / 3, 6) AS b")

_MATH = "sqrt exp log log10 log1p expm1 sin cos tan sinh cosh tanh asin acos atan asinh acosh atanh radians degrees".split()
_X = {"asin": "x", "acos": "x", "atanh": "x", "acosh": "(x + 1)", "log": "(x + 1)", "log10": "(x + 1)"}
_DUCK = {"log": "ln(x + 1)", "log10": "log10(x + 1)", "log1p": "ln(1 + x)", "expm1": "exp(x) - 1", "acosh": "acosh(x + 1)"}


@query(
    "SELECT k, "
    + ", ".join(f"round({_DUCK.get(n, f'{n}(x)')}, 9) AS {n}" for n in _MATH)
    + ", abs(-x) AS abs, CAST(ceil(x * 100) AS BIGINT) AS ceil, CAST(floor(x * 100) AS BIGINT) AS floor, CAST(trunc(-x * 100) AS BIGINT) AS trunc"
    + " FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_discount AS x FROM lineitem)"
)
def math_functions(t):
    x = t.lineitem
    k, d = (x.l_orderkey * 10 + x.l_linenumber).label("k"), x.l_discount
    of = lambda n: unary(n, d + 1 if n in ("log", "log10", "acosh") else d)
    out = m.merge(k, **{n: of(n) for n in _MATH}, abs=abs(-d), ceil=unary("ceil", d * 100), floor=unary("floor", d * 100), trunc=unary("trunc", -d * 100))
    return rounded(m.frame(out, spark=t.spark), dict.fromkeys(_MATH, 9))


@query(
    """SELECT k, round(atan2(x, y), 9) AS atan2, round(sqrt(x * x + y * y), 6) AS hypot, greatest(x, y) AS greatest, least(x, y) AS least,
    CASE WHEN y - 25 < 0 THEN -abs(x) ELSE abs(x) END AS copysign, round((-x) % 7, 6) + 0.0 AS fmod, x * 8 AS ldexp, floor(y / 7)::BIGINT * 7 AS truncate
    FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_extendedprice AS x, l_quantity AS y FROM lineitem)"""
)
def binary_math_functions(t):
    z = t.lineitem
    k, x, y = (z.l_orderkey * 10 + z.l_linenumber).label("k"), z.l_extendedprice, z.l_quantity
    two = lambda n, a, b: binary_math(n, a, b)
    out = m.merge(
        k, atan2=two("atan2", x, y), hypot=two("hypot", x, y), greatest=two("greatest", x, y), least=two("least", x, y), copysign=two("copysign", x, y - 25),
        fmod=two("fmod", -x, 7), ldexp=two("ldexp", x, 3), truncate=y.truncate(7),
    )
    return rounded(m.frame(out, spark=t.spark), {"atan2": 9, "hypot": 6, "fmod": 6}).withColumn("fmod", F.col("fmod") + F.lit(0.0))


@query("SELECT k, CASE WHEN y = 0 THEN 'inf'::DOUBLE ELSE x / y END AS q FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_quantity AS x, l_discount AS y FROM lineitem)", 6, ("q",))
def division_by_zero(t):
    z = t.lineitem
    return m.merge((z.l_orderkey * 10 + z.l_linenumber).label("k"), q=z.l_quantity / z.l_discount)


SQL["division_by_zero"] = SQL["division_by_zero"].replace("ELSE x / y END", "ELSE round(x / y, 6) END")


# -- strings ---------------------------------------------------------------------------------
@query(
    """SELECT c_custkey, length(c_name) AS len, upper(c_name) AS upper, lower(c_name) AS lower, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS capitalize, strpos(c_name, '#') - 1 AS find,
    replace(c_name, '0', 'o') AS replace, c_name || '-' || c_mktsegment AS cat, substr(c_name, 3, 5) AS slice, reverse(c_name) AS backwards, left(c_name, 2) || '<>' || substr(c_name, 5) AS spliced,
    lpad(c_mktsegment, greatest(12, length(c_mktsegment))::INTEGER, '*') AS padded, repeat(c_mktsegment, 2) AS twice, c_mktsegment || '!' AS plus, printf('%s/%d', c_name, c_custkey) AS said FROM customer"""
)
def string_functions(t):
    c = t.customer
    n, s = c.c_name, c.c_mktsegment
    return m.merge(
        c.c_custkey, len=n.str.len(), upper=n.str.upper(), lower=n.str.lower(), capitalize=s.str.capitalize(), find=n.str.find("#"), replace=n.str.replace("0", "o"), cat=n.str.cat(s, sep="-"),
        slice=n.str[2:7], backwards=n.str[::-1], spliced=n.str.slice_replace(2, 4, "<>"), padded=s.str.pad(12, fillchar="*"), twice=s * 2, plus=s + "!", said=_said(c),
    )


def _said(c: Expr) -> Expr:
    return m.merge(c.c_name, c.c_custkey).map(lambda name, key: f"{name}/{key}", "string", name="said")


#: Python's white space, spelled for a DuckDB regular expression.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ASKED = (
    f"""regexp_full_match(w, '[\\p{{L}}\\p{{N}}]+') AS isalnum, regexp_full_match(w, '\\p{{L}}+') AS isalpha, regexp_full_match(w, '\\p{{N}}+') AS isnumeric, regexp_full_match(w, '{_WHITE}+') AS isspace,
    regexp_matches(w, '\\p{{Ll}}') AND NOT regexp_matches(w, '[\\p{{Lu}}\\p{{Lt}}]') AS islower, regexp_matches(w, '\\p{{Lu}}') AND NOT regexp_matches(w, '[\\p{{Ll}}\\p{{Lt}}]') AS isupper"""
)


def _asked(e: Expr) -> dict[str, Expr]:
    return {n: getattr(e.str, n)() for n in ("isalnum", "isalpha", "isnumeric", "islower", "isupper", "isspace")}


@query(f"SELECT doc_id, {_ASKED} FROM (SELECT doc_id, text AS w FROM documents)")
def string_predicates_whole(t):
    d = t.documents
    return m.merge(d.doc_id, **_asked(d.text))


@query(f"SELECT c_custkey, {_ASKED} FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS w FROM customer)")
def string_predicates_short(t):
    df = t.spark.read.parquet(f"{t.folder}/customer.parquet")
    c = m.data(df.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise(F.lower("c_mktsegment")).alias("w")), spark=t.spark)
    return m.merge(c.c_custkey, **_asked(c.w))


@query(
    f"""SELECT doc_id, regexp_replace(regexp_replace(text, '^{_WHITE}+', ''), '{_WHITE}+$', '') AS own, regexp_replace(regexp_replace(w, '^{_WHITE}+', ''), '{_WHITE}+$', '') AS both,
    regexp_replace(w, '^{_WHITE}+', '') AS left_, regexp_replace(w, '{_WHITE}+$', '') AS right_ FROM (SELECT doc_id, text, '  ' || chr(9) || text || chr(10) AS w FROM documents)"""
)
def string_strip_whole(t):
    d = t.documents
    w = ("  \t" + d.text + "\n").str
    return m.merge(d.doc_id, own=d.text.str.strip(), both=w.strip(), left_=w.lstrip(), right_=w.rstrip())


@query("SELECT c_custkey, c_mktsegment || ': ' || c_custkey || ' of ' || c_name AS said, c_name || ' %' AS plain FROM customer")
def interp(t):
    c = t.customer
    return m.merge(c.c_custkey, said=(c.c_mktsegment + ": %d of %s") % (c.c_custkey, c.c_name), plain=(c.c_name + " %s").interp("%"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(c_name, '0', 'o'), '0', 'o') AS twice, replace(c_name, '0', '') AS all_ FROM customer")
def replace_some(t):
    c = t.customer
    return m.merge(c.c_custkey, twice=c.c_name.str.replace("0", "o", 2), all_=c.c_name.str.replace("0", ""))


@query(
    """SELECT c_custkey, regexp_full_match(w, '[0-9]+') AS isdecimal, regexp_full_match(w, '[0-9]+') AS isdigit, regexp_full_match(w, '[^A-Za-z]*([A-Z][a-z]*([^A-Za-z]+|$))+') AS istitle
    FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN c_name ELSE c_mktsegment END AS w FROM customer)"""
)
def string_predicates_more(t):
    k = F.col("c_custkey")
    w = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.col("c_name")).otherwise(F.col("c_mktsegment"))
    c = m.data(t.spark.read.parquet(f"{t.folder}/customer.parquet").select("c_custkey", w.alias("w")), spark=t.spark)
    return m.merge(c.c_custkey, **{n: getattr(c.w.str, n)() for n in ("isdecimal", "isdigit", "istitle")})


@query("SELECT event_id, 0::BIGINT AS nano FROM events")
def nanosecond(t):
    e = t.events
    return m.merge(e.event_id, nano=e.ts.dt.nanosecond)


# -- dates -----------------------------------------------------------------------------------
@query(
    """SELECT event_id, ts::DATE AS date, year(ts)::BIGINT AS year, month(ts)::BIGINT AS month, day(ts)::BIGINT AS day, hour(ts)::BIGINT AS hour, minute(ts)::BIGINT AS minute, second(ts)::DOUBLE AS second,
    (epoch_us(ts) % 1000000) // 1000 AS millisecond, epoch_us(ts) % 1000000 AS microsecond, weekofyear(ts)::BIGINT AS week, dayofyear(ts)::BIGINT AS dayofyear, (isodow(ts) - 1)::BIGINT AS dayofweek,
    dayname(ts) AS weekday_name, quarter(ts)::BIGINT AS quarter, day(last_day(ts))::BIGINT AS daysinmonth, day(ts) = 1 AS is_month_start, ts::DATE = last_day(ts) AS is_month_end,
    ts::DATE = date_trunc('quarter', ts)::DATE AS is_quarter_start, ts::DATE = (date_trunc('quarter', ts) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS is_quarter_end,
    month(ts) = 1 AND day(ts) = 1 AS is_year_start, month(ts) = 12 AND day(ts) = 31 AS is_year_end, strftime(ts, '%Y/%m/%d %H-%M') AS said, strftime(ts, '%H:%M:%S.%f') AS time FROM events"""
)
def date_parts(t):
    e = t.events
    parts = (
        "date year month day hour minute second millisecond microsecond week dayofyear dayofweek weekday_name quarter daysinmonth is_month_start is_month_end is_quarter_start is_quarter_end"
        " is_year_start is_year_end time"
    ).split()
    return m.merge(e.event_id, said=e.ts.dt.strftime("%Y/%m/%d %H-%M"), **{p: getattr(e.ts.dt, p) for p in parts})


@query(
    """SELECT event_id, time_bucket(INTERVAL 20 MINUTE, ts, TIMESTAMP '1970-01-01') AS m20, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS h6,
    (DATE '1970-01-01' + ((((epoch_ms(ts::DATE) // 86400000) + 719163) // 3) * 3 - 719163)::INTEGER)::DATE AS d3, (DATE '1970-01-01' + ((((epoch_ms(ts::DATE) // 86400000) + 4) // 14) * 14 - 4)::INTEGER)::DATE AS w2,
    make_date(1970 + (((year(ts) - 1970) * 12 + month(ts) - 1) // 5 * 5) // 12, (((year(ts) - 1970) * 12 + month(ts) - 1) // 5 * 5) % 12 + 1, 1) AS mo5, make_date(1970 + (year(ts) - 1970) // 4 * 4, 1, 1) AS y4 FROM events"""
)
def date_truncate(t):
    e = t.events
    tr = e.ts.truncate
    return m.merge(e.event_id, m20=tr(20, "minutes"), h6=tr(hours=6), d3=tr(3, "day"), w2=tr(2, "weeks"), mo5=tr(5, "months"), y4=tr(years=4))


@query(
    """SELECT event_id, make_timestamp(epoch_us(ts) // 900000000 * 900000000) AS down,
    make_timestamp((epoch_us(ts) + 30000000) // 60000000 * 60000000) AS near FROM events"""
)
def date_round(t):
    e = t.events
    return m.merge(e.event_id, down=e.ts.dt.floor("15min"), up=e.ts.dt.ceil("H"), near=e.ts.dt.round("min"))


SQL["date_round"] = """SELECT event_id, make_timestamp(epoch_us(ts) - epoch_us(ts) % 900000000) AS down,
    make_timestamp(epoch_us(ts) - epoch_us(ts) % 3600000000 + CASE WHEN epoch_us(ts) % 3600000000 = 0 THEN 0 ELSE 3600000000 END) AS up,
    make_timestamp(CASE WHEN 2 * r > 60000000 OR (2 * r = 60000000 AND (d // 60000000) % 2 = 1) THEN d + 60000000 ELSE d END) AS near
    FROM (SELECT *, epoch_us(ts) % 60000000 AS r, epoch_us(ts) - epoch_us(ts) % 60000000 AS d FROM events)"""


@query("SELECT event_id, make_timestamp(CAST(floor(event_id * 1.5 * 1000000) AS BIGINT)) AS at FROM events")
def from_timestamp(t):
    e = t.events
    return m.merge(e.event_id, at=(e.event_id * 1.5).utcfromtimestamp())


@query("SELECT event_id, (epoch_us(ts) - 946684800000000) // 86400000000 AS days, ((epoch_us(ts) - 946684800000000) % 86400000000) // 1000000 AS seconds, (epoch_us(ts) - 946684800000000) / 1000000.0 AS total, ts + INTERVAL 36 HOUR AS later FROM events", 6, ("total",))
def time_differences(t):
    e = t.events
    d = e.ts - dt.datetime(2000, 1, 1)
    return m.merge(e.event_id, days=d.dt.days, seconds=d.dt.seconds, total=d.dt.total_seconds(), later=e.ts + dt.timedelta(hours=36))


@query("SELECT hour(ts)::BIGINT AS ts_hour, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1", 6, ("mean",))
def by_hour(t):
    e = t.events
    return m.by(e.ts.hour, n=e.event_id.count(), mean=e.value.mean())


# -- Python functions ------------------------------------------------------------------------
@query("SELECT o_orderkey, o_custkey * 3 + 1 AS mapped FROM orders")
def map_values(t):
    o = t.orders
    return m.merge(o.o_orderkey, mapped=o.o_custkey.map(lambda v: v * 3 + 1, "int64"))


@query("SELECT n_nationkey, n_name || ':' || n_regionkey AS said FROM nation")
def map_rows(t):
    n = t.nation
    return m.merge(n.n_nationkey, said=n[["n_name", "n_regionkey"]].map(lambda a, b: f"{a}:{b}", "string", name="said"))


@query("SELECT p_partkey, p_size * 2 AS twice FROM part")
def apply_split(t):
    def twice(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"p_partkey": pdf["p_partkey"], "twice": pdf["p_size"] * 2})

    return t.part[["p_partkey", "p_size"]].apply(twice, "var * {p_partkey: int64, twice: int32}", splittable=True)


@query("SELECT CAST(median(s_acctbal) AS DOUBLE) AS median FROM supplier", 6, ("median",))
def apply_whole(t):
    return t.supplier[["s_acctbal"]].apply(lambda pdf: pd.DataFrame({"median": [pdf["s_acctbal"].median()]}), "var * {median: float64}")


# -- arrays ----------------------------------------------------------------------------------
def _vectors(t) -> LongArray:
    df = t.spark.read.parquet(f"{t.folder}/embeddings.parquet")
    size = len(df.select("embedding").first()[0])
    rows = df.select(F.col("vec_id").alias("i0"), F.posexplode("embedding").alias("i1", "v")).withColumn("v", F.col("v").cast("double"))
    return LongArray(rows, (df.count(), size))


_LONG = "(SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query(f"SELECT i AS i0, round(avg(v), 6) AS v FROM {_LONG} GROUP BY 1", 6, ("v",))
def array_mean_of_axis(t):
    return _vectors(t).reduce("mean", axis=0).rows.withColumn("i0", F.col("i0").cast("long"))


@query(f"SELECT vec_id AS i0, 0::BIGINT AS i1, round(sqrt(sum(v * v)), 5) AS v FROM {_LONG} GROUP BY 1", 5, ("v",))
def array_norm_keepdims(t):
    return _vectors(t).reduce("vnorm", axis=1, keepdims=True).rows.withColumn("i1", F.col("i1").cast("long"))


@query(f"WITH x AS {_LONG}, w AS (SELECT i, avg(v) AS m FROM x GROUP BY 1) SELECT vec_id AS i0, round(sum(v * m), 5) AS v FROM x JOIN w USING (i) GROUP BY 1", 5, ("v",))
def array_dot(t):
    x = _vectors(t)
    return x.dot(x.reduce("mean", axis=0)).rows


@query(f"SELECT i AS i0, vec_id AS i1, v FROM {_LONG} WHERE i < 4")
def array_transpose_slice(t):
    return _vectors(t)[:, 0:4].T.rows.withColumn("i0", F.col("i0").cast("long"))


@query(f"WITH x AS {_LONG}, w AS (SELECT i, avg(v) AS m FROM x GROUP BY 1) SELECT vec_id AS i0, i AS i1, round(v - m, 5) + 0.0 AS v FROM x JOIN w USING (i)", 5, ("v",))
def array_broadcast(t):
    x = _vectors(t)
    return x.combine(x.reduce("mean", axis=0), lambda a, b: F.round(a - b, 5) + F.lit(0.0)).rows.withColumn("i1", F.col("i1").cast("long"))


@query(
    """SELECT vec_id, round(list_avg(e), 5) AS mean, round(list_sum(e), 4) AS sum, list_max(e)::FLOAT AS top, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 4) AS norm, round(list_stddev_pop(e), 5) AS std,
    CAST(len(e) AS BIGINT) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""", 5, ("mean", "std"),
)
def array_within_rows(t):
    x = t.embeddings
    v = x.embedding
    out = m.merge(x.vec_id, mean=v.mean(axis=1), sum=v.sum(axis=1), top=v.max(axis=-1), norm=v.vnorm(axis=1), std=v.std(axis=1), n=v.count(axis=1))
    return rounded(m.frame(out, spark=t.spark), {"sum": 4, "norm": 4})


@query(f"SELECT round(avg(v), 6) AS embedding_mean FROM {_LONG} GROUP BY i", 6, ("embedding_mean",))
def array_across_rows(t):
    return t.embeddings.embedding.mean(axis=0)


@query(f"SELECT round(max(v) - min(v), 6) AS spread FROM {_LONG}", 6, ("spread",))
def array_whole(t):
    v = t.embeddings.embedding
    return (v.max().coerce("float64") - v.min().coerce("float64")).label("spread")


@query(f"SELECT vec_id AS i0, i AS i1, v FROM {_LONG} WHERE i < 3 UNION ALL SELECT vec_id, i + 3, v FROM {_LONG} WHERE i < 2")
def array_concat(t):
    x = _vectors(t)
    return x[:, 0:3].concat(x[:, 0:2], axis=1).rows.withColumn("i1", F.col("i1").cast("long"))


@query(f"SELECT a.i AS i0, b.i AS i1, round(sum(a.v * b.v), 4) AS v FROM {_LONG} a JOIN {_LONG} b USING (vec_id) WHERE a.i < 5 AND b.i < 4 GROUP BY 1, 2", 4, ("v",))
def array_tensordot(t):
    x = _vectors(t)
    out = x[:, 0:5].tensordot(x[:, 0:4], axes=([0], [0])).rows
    return out.withColumns({"i0": F.col("i0").cast("long"), "i1": F.col("i1").cast("long")})


# -- sources and sinks -----------------------------------------------------------------------
def _written(t, e: Expr, suffix: str) -> str:
    """The path of an expression's rows, written into the folder that all executors share."""
    path = _place(t, suffix)
    m.into(path, e)
    return path


def _place(t, suffix: str) -> str:
    path = f"{resources.shared_folder(t.spark)}/query-{uuid.uuid4().hex}{suffix}"
    at = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


_CUSTOMER = "{c_custkey: int64, c_name: string, c_acctbal: float64, c_mktsegment: string}"
_FEW = ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"]


def _customers(t) -> Expr:
    return t.customer[_FEW]


@query("SELECT c_custkey::BIGINT AS c_custkey, c_name FROM customer WHERE c_acctbal > 100")
def csv_scan(t):
    c = m.data(_written(t, _customers(t), ".csv"), f"var * {_CUSTOMER}", spark=t.spark)
    return c[c.c_acctbal > 100][["c_custkey", "c_name"]]


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, round(max(c_acctbal), 2) AS top FROM customer GROUP BY 1", 2, ("top",))
def csv_types_found_out(t):
    c = m.data(_written(t, _customers(t), ".csv"), spark=t.spark)
    return m.by(c.c_mktsegment, n=c.c_custkey.count(), top=c.c_acctbal.max())


@query("SELECT least(30, count(*))::BIGINT AS n FROM customer")
def csv_head(t):
    c = m.data(_written(t, _customers(t), ".csv"), f"var * {_CUSTOMER}", spark=t.spark)
    return m.summary(n=c.head(30).c_custkey.count())


@query("SELECT c_custkey::BIGINT AS c_custkey, c_mktsegment FROM customer")
def csv_glob(t):
    base, c = _place(t, ""), _customers(t)
    for i in range(3):
        m.into(f"{base}/accounts_{i}.csv", c[c.c_custkey % 3 == i])
    return m.data(f"{base}/accounts_*.csv", f"var * {_CUSTOMER}", spark=t.spark)[["c_custkey", "c_mktsegment"]]


@query("SELECT n_name, n_regionkey::BIGINT AS n_regionkey FROM nation")
def json_document(t):
    """One document that holds an array of records."""
    path, n = _place(t, ".json"), m.frame(t.nation, spark=t.spark)
    n.agg(F.to_json(F.collect_list(F.struct("n_name", "n_regionkey")))).write.text(path)
    return m.data(path, "var * {n_name: string, n_regionkey: int64}", spark=t.spark)


@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_acctbal > 100 GROUP BY 1")
def json_lines(t):
    c = m.data(_written(t, _customers(t), ".jsonl"), f"var * {_CUSTOMER}", spark=t.spark)
    s = c[c.c_acctbal > 100]
    return m.by(s.c_mktsegment, n=s.c_custkey.count())


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def orc_scan(t):
    return m.data(_written(t, _customers(t), ".orc"), spark=t.spark)


@query("SELECT c_custkey, c_mktsegment FROM customer UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 100")
def append_rows(t):
    c = _customers(t)
    path = _written(t, c, ".parquet")
    resources.append(path, m.frame(c[c.c_acctbal > 100], spark=t.spark))
    return m.data(path, spark=t.spark)[["c_custkey", "c_mktsegment"]]


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def cached_dataset(t):
    """The second answer comes from the rows that were kept for the first."""
    held = m.CachedDataset(t.orders)
    build = lambda o: m.by(o.o_custkey, n=o.o_orderkey.count())
    held.compute(build, "native")
    return held.compute(build, "native")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def catalog_view(t):
    name = f"v{uuid.uuid4().hex}"
    m.frame(t.nation, spark=t.spark).createOrReplaceTempView(name)
    n = m.data(f"table:{name}", spark=t.spark)
    return n[n.n_regionkey == 1][["n_nationkey", "n_name"]]


@query("SELECT * FROM (VALUES ('list', 1::BIGINT), ('list', 2), ('dict', 3), ('pandas', 4), ('numpy', 5), ('iterator', 6)) v(kind, x)")
def python_sources(t):
    shape = "var * {kind: string, x: int64}"
    given = (
        [("list", 1), ("list", 2)], {"kind": ["dict"], "x": [3]}, pd.DataFrame({"kind": ["pandas"], "x": [4]}),
        np.array([("numpy", 5)], dtype=[("kind", "U8"), ("x", "i8")]), iter([("iterator", 6)]),
    )
    tables = [m.data(g, shape, spark=t.spark) for g in given]
    out = tables[0]
    for other in tables[1:]:
        out = m.concat(out, other)
    return out


@query("SELECT n_regionkey AS region, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1")
def service_compute(t):
    """An expression computed by the service and sent as an Arrow stream."""
    server = Server({"nation": t.nation}, port=0).start()
    try:
        client = Client(f"http://127.0.0.1:{server.port}")
        n = client.leaf("nation")
        return t.spark.createDataFrame(client.compute_arrow(m.by(n.n_regionkey.label("region"), n=n.n_name.count())))
    finally:
        server.stop()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def service_table(t):
    """A table of another service, by its URI."""
    server = Server({"nation": t.nation[["n_nationkey", "n_name", "n_regionkey"]]}, port=0).start()
    try:
        return m.frame(m.data(f"millrace://127.0.0.1:{server.port}/nation", spark=t.spark), spark=t.spark)
    finally:
        server.stop()


@query("SELECT 7::BIGINT AS made, n_nationkey, 'k' AS s FROM nation")
def literals(t):
    n = t.nation
    return m.merge(n.n_nationkey, made=(m.literal(3) + 4).coerce("int64"), s="k")


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS total, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1", 2, ("total",))
def by_summary(t):
    x = t.lineitem
    return m.by(x.l_returnflag, m.summary(total=x.l_quantity.sum(), n=x.l_orderkey.count()))


@query("SELECT c_custkey, length(c_name)::BIGINT AS len, upper(c_mktsegment) AS upper, lower(c_name) AS lower, c_name || c_mktsegment AS cat FROM customer")
def strings_by_old_names(t):
    c = t.customer
    return m.merge(c.c_custkey, len=c.c_name.str_len().coerce("int64"), upper=c.c_mktsegment.str_upper(), lower=c.c_name.str_lower(), cat=c.c_name.str_cat(c.c_mktsegment))


@query("SELECT round(sum(sqrt(o_totalprice)), 2) AS roots, max(year(o_orderdate))::BIGINT AS last, CAST(count(DISTINCT greatest(o_custkey, 9)) AS BIGINT) AS n FROM orders", 2, ("roots",))
def free_functions(t):
    o = t.orders
    return m.summary(roots=m.sum(m.sqrt(o.o_totalprice)), last=m.max(m.year(o.o_orderdate)).coerce("int64"), n=m.nunique(m.greatest(o.o_custkey, 9)))


@query("SELECT CAST(count(*) AS BIGINT) AS n, any_value(len(embedding))::BIGINT AS wide FROM embeddings")
def array_sizes(t):
    x = _vectors(t)
    return t.spark.createDataFrame([(x.nelements(0), x.nelements(1))], "n long, wide long")


@query("SELECT event_id, 0::BIGINT AS nano FROM events")
def nanoseconds_of_differences(t):
    e = t.events
    return m.merge(e.event_id, nano=(e.ts - dt.datetime(2000, 1, 1)).dt.nanoseconds)


# -- trees, streams -----------------------------------------------------------------
@query("SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def tree_round_trip(t):
    c = m.symbol("c", t.customer.dshape)
    s = c[c.c_acctbal > 0]
    tree = m.to_tree(m.by(s.c_mktsegment, n=s.c_custkey.count()), {c: "customer"})
    return m.from_tree(tree, {"customer": t.customer})


@query("SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY 1")
def free_leaf(t):
    n = m.symbol("n", "var * {n_nationkey: int32, n_name: string, n_regionkey: int32}")
    return m.frame(m.by(n.n_regionkey, n=n.n_name.count()), {n: t.nation}, spark=t.spark)


def _streamed(t, build) -> DataFrame:
    """Rows of a finished run over the events as a stream."""
    path = f"{t.folder}/events.parquet"
    schema = t.spark.read.parquet(path).schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path if "*" in path else t.folder + "/events.parque[t]")
    df = build(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    name = f"s{uuid.uuid4().hex}"
    q = df.writeStream.format("memory").queryName(name).outputMode("complete" if df.isStreaming else "append").trigger(availableNow=True).start()
    q.awaitTermination()
    return t.spark.table(name)


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events WHERE value > 0.1 GROUP BY 1", 4, ("total",))
def stream_by(t):
    def build(stream):
        e = m.symbol("e", m.data(t.spark.read.parquet(f"{t.folder}/events.parquet"), spark=t.spark).dshape)
        s = e[e.value > 0.1]
        return windows.stream_frame(m.by(s.event_type, n=s.event_id.count(), total=s.value.sum()), e, stream)

    return _streamed(t, build)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR AS window_end, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2, 3")
def stream_windows(t):
    out = _streamed(t, lambda s: windows.windowed(s, "ts", "1 hour", ["event_type"], late="1 hour", n=F.count(F.lit(1))))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query(
    """SELECT w AS window_start, w + INTERVAL 1 HOUR AS window_end, event_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type, unnest([b, b - INTERVAL 30 MINUTE]) AS w
    FROM (SELECT event_type, time_bucket(INTERVAL 30 MINUTE, ts, TIMESTAMP '1970-01-01') AS b FROM events)) GROUP BY ALL"""
)
def stream_sliding_windows(t):
    out = _streamed(t, lambda s: windows.windowed(s, "ts", "1 hour", ["event_type"], late="1 hour", slide="30 minutes", n=F.count(F.lit(1))))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query(
    """WITH e AS (SELECT event_type, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
    SELECT min(ts) AS window_start, max(ts) + INTERVAL 10 MINUTE AS window_end, event_type, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY event_type, g"""
)
def stream_sessions(t):
    out = _streamed(t, lambda s: windows.sessions(s, "ts", "10 minutes", ["event_type"], late="1 hour", n=F.count(F.lit(1))))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})
