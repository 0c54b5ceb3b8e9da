"""Corners of the algebra: interpolation, time differences, nested fields, databases, whole-collection functions."""
import datetime as dt
from decimal import Decimal

import pandas as pd
import pytest

import millrace as m


def test_interpolation_and_repetition(spark):
    t = m.data([("%d apples", 3), ("no %s", 4)], "var * {f: string, n: int32}", spark=spark)
    assert m.into(list, t[t.n == 3].f % t[t.n == 3].n) == ["3 apples"]
    assert m.into(list, t.f.interp(7)) == ["7 apples", "no 7"]
    assert m.into(list, t.f.str[:2].repeat(2)) == ["%d%d", "nono"] and m.into(list, t.f.str[:1] * t.n) == ["%%%", "nnnn"]
    assert m.into(list, t.f.str[0]) == ["%", "n"] and m.into(list, t.f.str[-1]) == ["s", "s"] and m.into(list, t.f.str[99]) == [None, None]
    assert m.into(list, t.f.str_len()) == [9, 5]


def test_time_differences(spark):
    a = dt.datetime(2000, 1, 1)
    t = m.data([(a, dt.timedelta(seconds=s)) for s in (0, 10, 20)], "var * {at: datetime, d: timedelta}", spark=spark)
    assert m.into(list, t.at + t.d) == [a, a + dt.timedelta(seconds=10), a + dt.timedelta(seconds=20)]
    assert m.into(list, (t.at + t.d) - t.at) == [dt.timedelta(0), dt.timedelta(seconds=10), dt.timedelta(seconds=20)]
    assert m.compute(t.d.sum()) == dt.timedelta(seconds=30) and m.compute(t.d.mean()) == dt.timedelta(seconds=10)
    assert abs(m.compute(t.d.std()).total_seconds() - (200 / 3) ** 0.5) < 1e-5
    assert m.into(list, t.d.dt.total_seconds()) == [0.0, 10.0, 20.0] and m.into(list, t.d.dt.seconds) == [0, 10, 20] and m.into(list, t.d.dt.days) == [0, 0, 0]


def test_time_differences_beyond_64_bits_in_sum(spark):
    """12,176 differences of 24 years exceed 64 bits of microseconds when they are added up."""
    d = dt.timedelta(days=8766, microseconds=7)
    rows = [(k, d + dt.timedelta(microseconds=k)) for k in (0, 1)] * 20_000 + [(2, None)]
    t = m.data(spark.createDataFrame(rows, "k int, d interval day to second"), spark=spark)
    assert m.compute(t.d.mean()) == d + dt.timedelta(microseconds=1) and m.compute(t.d.sum()) is None
    assert sorted(m.into(list, m.by(t.k, a=t.d.mean()))) == [(0, d), (1, d + dt.timedelta(microseconds=1)), (2, None)]
    far = m.data([(dt.timedelta(days=s * 100_000_000),) for s in (-1, 1, 1)], "var * {d: timedelta}", spark=spark)
    assert m.compute(far.d.sum()) == dt.timedelta(days=100_000_000) and m.compute(far.d.std()) > dt.timedelta(days=94_000_000)


def test_decimals(spark):
    t = m.data([(Decimal("1.50"),), (Decimal("2.25"),)], "var * {x: decimal[10, 2]}", spark=spark)
    assert m.compute(t.x.sum()) == Decimal("3.75") and m.into(list, t.x > 2) == [False, True]


def test_nested_fields(spark):
    df = spark.createDataFrame([((1, "a"), [1, 2]), ((2, "b"), [])], "s struct<x: int, y: string>, v array<int>")
    t = m.data(df, spark=spark)
    assert m.into(list, t.s.x) == [1, 2] and m.into(list, t[t.s.y == "b"].s.x) == [2]
    assert t.v.ndim == 2 and m.into(list, t.v) == [[1, 2], []]


def test_databases(spark):
    db = m.data({"a": spark.createDataFrame([(1, 2)], "x long, y long"), "b": spark.createDataFrame([(1, "z")], "x long, w string")}, spark=spark)
    assert db.fields == ["a", "b"] and "x: ?int64" in db.dshape
    assert m.into(list, m.join(db.a, db.b, "x")) == [(1, 2, "z")]
    leaf = m.symbol("db", "{a: var * {x: int64, y: int64}, b: var * {x: int64, w: string}}")
    e = m.join(leaf.a, leaf.b, "x").w
    assert m.compute(e, {leaf: {"a": spark.createDataFrame([(1, 2)], "x long, y long"), "b": spark.createDataFrame([(1, "z")], "x long, w string")}}, return_type=list, spark=spark) == ["z"]


def test_whole_collection_functions(spark):
    t = m.data([(3,), (1,), (2,)], "var * {x: int64}", spark=spark)
    assert m.into(list, t.apply(lambda pdf: pdf.sort_values("x").head(1), "var * {x: int64}")) == [1]
    assert m.into(list, t[t.x > 9].apply(lambda pdf: pd.DataFrame({"n": [len(pdf)]}), "var * {n: int64}")) == [0]
    assert sorted(m.into(list, t.apply(lambda pdf: pdf * 2, "var * {x: int64}", splittable=True))) == [2, 4, 6]


def test_samples(spark):
    t = m.data([(i,) for i in range(101)], "var * {x: int64}", spark=spark)
    got = m.into(list, t.sample(n=10, seed=1))
    assert len(got) == len(set(got)) == 10 and len(m.into(list, t.sample(frac=0.5))) == 51 and len(m.into(list, t.sample(n=500))) == 101


def test_coercion(spark):
    t = m.data([("1",), (None,)], "var * {x: ?string}", spark=spark)
    assert m.into(list, t.x.coerce("int64")) == [1, None]
    assert m.into(list, m.data([(0.5,)], "var * {x: float64}", spark=spark).x.utcfromtimestamp()) == [dt.datetime(1970, 1, 1, 0, 0, 0, 500000)]


def test_keepdims_and_literals(spark):
    t = m.data([(1,), (2,)], "var * {x: int64}", spark=spark)
    assert m.compute(t.x.sum(keepdims=True), return_type=list) == [3] and m.compute(m.literal(3) + 4) == 7
    assert m.into(list, m.merge(t.x, c=1, s="k")) == [(1, 1, "k"), (2, 1, "k")]
    assert m.into(list, t[m.least(t.x, 2) == t.x]) == [1, 2]


def test_free_functions(spark):
    t = m.data([(4.0, dt.datetime(2001, 2, 3, 4, 5, 6))], "var * {x: float64, w: datetime}", spark=spark)
    assert m.into(list, m.sqrt(t.x)) == [2.0] and m.compute(m.sum(t.x)) == 4.0 and m.into(list, m.year(t.w)) == [2001] and m.into(list, t.w.hour) == [4]
    assert m.shape(t) == ("var",) and m.ndim(t) == 1 and m.into(list, m.head(t.x, 1)) == [4.0]


def test_unknown_data_is_refused(spark):
    with pytest.raises(TypeError):
        m.literal(object())
    with pytest.raises(NotImplementedError):
        m.convert(spark.range(1), bytes)
