"""Joins of keys with many rows on both sides."""
import datetime as dt
from collections import Counter

import pytest
from pyspark.sql import functions as F

import millrace as m
from millrace.operators import relational


def rows(df):
    return Counter(repr(tuple(r)) for r in df.collect())


def test_pairs_of_one_key_are_shared_out(spark, monkeypatch):
    monkeypatch.setattr(relational, "CELL_SIDE", 200, raising=False)
    a = spark.range(3_000).select(F.lit(1).alias("k"), F.col("id").alias("x"))
    b = spark.range(1_000).select(F.lit(1).alias("k"), F.col("id").alias("y"))
    for how in ("inner", "left", "right", "outer"):
        j = m.frame(m.join(m.data(a.coalesce(1), spark=spark), m.data(b.coalesce(1), spark=spark), "k", how=how), spark=spark)
        each = [r["count"] for r in j.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(each) == 3_000_000 and max(each) < 600_000
        assert tuple(j.agg(F.count_distinct("x", "y"), F.sum("x"), F.sum("y")).first()) == (3_000_000, 1_000 * 4_498_500, 3_000 * 499_500)


KEYS = {
    "int and bigint": ("int", "bigint", [1, 2, 3, 4, None]), "string": ("string", "string", ["a", "b", "c", "", None]), "double": ("double", "double", [0.0, -0.0, float("nan"), 2.5, None]),
    "timestamp": ("timestamp", "timestamp", [dt.datetime(2024, 10, 27, h, 30) for h in (0, 1, 2, 3)] + [None]), "decimal": ("decimal(10,2)", "decimal(10,2)", [None, 1, 2, 3, 4]),
    "float and double": ("float", "double", [0.5, 1.5, 2.5, 3.5, None]),
}


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_cells_give_the_rows_of_a_plain_join(spark, monkeypatch, kind, how):
    """Crowded, sparse, unmatched and null keys; some rows are there more than once."""
    left, right, values = KEYS[kind]
    made = lambda of, name, to: spark.createDataFrame([(i % 5, i // 3) for i in range(of)], f"k int, {name} int").repartition(3).select(
        F.element_at(F.array(*[F.lit(v).cast(to) for v in values]), F.col("k") + 1).alias("k"), name, (F.col(name) % 2).alias("z"))
    a, b = made(47, "x", left), made(31, "y", right)
    a, b = a.filter("k IS NULL OR x > 3"), b.filter(F.col("y") > 1).filter(F.col("k").isNull() | (F.col("k") != F.lit(values[3]).cast(right)) | (F.col("y") < 0))
    on = lambda: m.frame(m.join(m.data(a, spark=spark), m.data(b, spark=spark), "k", how=how), spark=spark)
    monkeypatch.setattr(relational, "CELL_LEAST", 1 << 60)
    want = rows(on())
    monkeypatch.setattr(relational, "CELL_LEAST", 2)
    monkeypatch.setattr(relational, "CELL_SIDE", 3)
    assert rows(on()) == want


def test_two_keys_in_cells(spark, monkeypatch):
    a = spark.createDataFrame([(i % 2, "u" if i % 3 else None, i) for i in range(60)], "k int, l string, x int")
    b = spark.createDataFrame([(i % 4, "u", i) for i in range(40)], "k int, l string, y int")
    on = lambda: m.frame(m.join(m.data(a, spark=spark), m.data(b, spark=spark), ["k", "l"], how="outer"), spark=spark)
    want = rows(on())
    monkeypatch.setattr(relational, "CELL_SIDE", 5)
    monkeypatch.setattr(relational, "CELL_LEAST", 2)
    assert rows(on()) == want and sum(want.values()) == 40 * 10 + 20 + 20


def test_a_dimension_is_joined_as_ever(spark):
    big = spark.range(12_000_000).select((F.col("id") % 2).alias("l0"))
    few = spark.range(2).select(F.col("id").alias("r0"))
    assert relational._crowded_keys(big, few, 1) is None
