"""Rows by place, reductions over different rows, and whole numbers at their ends."""
import datetime as dt
import json
import random

import pandas as pd
import pytest

import millrace as m
from millrace.operators import relational
from millrace.operators.relational import Key

X = "var * {x: int64}"


def test_reductions_over_different_rows(spark):
    t = m.data([(1,), (2,), (3,)], X, spark=spark)
    big = t[t.x > 1]
    assert m.compute(t.x.sum() * 1000 + big.x.sum()) == 6005
    assert abs(m.compute(big.x.count() / t.x.count()) - 2 / 3) < 1e-12
    assert m.into(list, t[t.x > t.x.sum() - big.x.sum()].x.sort()) == [2, 3]
    assert m.into(list, (t.x * big.x.max() - t.x.min())) == [2, 5, 8]
    assert m.compute((big.x.sum() - t.x.sum()) / (t.x.count() + big.x.count()) + 1) == 0.8
    assert m.compute(m.summary(a=t.x.sum(), b=t.x.max()).a - big.x.sum()) == 1
    assert m.compute(t.x.sum() - big.x.sum() > 0) is True


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_shifts_beside_their_rows(spark, one_task, monkeypatch):
    monkeypatch.setattr(relational, "shifts", lambda *a, f=relational.shifts: f(*a, one_task=one_task, block=7))
    random.seed(1)
    rows = [(i, random.choice([None, *range(9)])) for i in range(100)]
    df = spark.createDataFrame(random.sample(rows, 100), "k long, v long").repartition(5)
    t = m.data(df, order=["k"], spark=spark)
    p = pd.DataFrame(rows, columns=["k", "v"]).astype("Int64")
    out = m.compute(m.merge(t.k, back=t.v.shift(2), ahead=t.v.shift(-3), far=t.v.shift(15), rise=t.v - t.v.shift(1), again=t.v.shift(1).shift(1)), spark=spark).sort_values("k").reset_index(drop=True).astype("Int64")
    for name, want in (("back", p.v.shift(2)), ("ahead", p.v.shift(-3)), ("far", p.v.shift(15)), ("rise", p.v - p.v.shift(1)), ("again", p.v.shift(2))):
        assert out[name].equals(want.rename(name)), name
    got = sorted(m.into(list, t[(t.v > t.v.shift(1)) & (t.k > 10)].k))
    assert got == [k for k, v in rows if k > 10 and v is not None and rows[k - 1][1] is not None and v > rows[k - 1][1]]
    assert m.compute((t.v - t.v.shift(1)).max()) == (p.v - p.v.shift(1)).max()
    by = {r[0]: r[1] for r in m.into(list, m.by((t.v > t.v.shift(1)).label("up"), n=t.k.count()))}
    assert sum(by.values()) == 100
    down = m.into(list, t.sort("k", ascending=False).v.shift(1))
    assert len(down) == 100


def test_order_with_ties_is_numbered_in_many_ranges(spark):
    df = spark.range(4000).selectExpr("id", "id % 3 AS tie")
    got = relational.with_ordinal(df, [Key("tie")], one_task=10)
    rows = sorted(got.collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in rows] == list(range(4000)) and [r.tie for r in rows] == sorted(r.tie for r in rows)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("__range") > 0
    again = {r.id: r.ordinal for r in relational.with_ordinal(df.repartition(7), [Key("tie")], one_task=10).collect()}
    assert again == {r.id: r.ordinal for r in rows}


def test_ranges_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(relational, "RANGE_ROWS", 20)
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 10 = 0 THEN NULL ELSE id % 2 END AS k")
    ranged = relational.with_ordinal(df, [Key("k", False)], one_task=10)
    rows = sorted(ranged.collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in rows] == list(range(3000))
    assert [r.k for r in rows] == [1] * 1500 + [0] * 1200 + [None] * 300


def test_samples_of_many_rows(spark):
    df = spark.range(2000).selectExpr("id", "id % 5 AS five").union(spark.range(10).selectExpr("id", "id % 5 AS five"))
    got = relational.sample(df, 1500, None, 3, one_task=100).collect()
    assert len(got) == 1500 and len({r.id for r in got}) >= 1490
    assert {(r.id, r.five) for r in got} <= {(i, i % 5) for i in range(2000)}
    assert {r.id for r in relational.sample(df, 1500, None, 4, one_task=100).collect()} != {r.id for r in got}
    assert relational.sample(df, None, 0.5, 3, one_task=100).count() == 1005


def test_open_slices_leave_no_single_task(spark):
    df = spark.range(100).selectExpr("id AS k")
    got = relational.slice_rows(df, 40, None, None, [Key("k")])
    assert [r.k for r in got.collect()] == list(range(40, 100))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CollectLimit" not in plan and "GlobalLimit" not in plan
    assert [r.k for r in relational.slice_rows(df, 5, 9, None, [Key("k", False)]).collect()] == [94, 93, 92, 91]


def test_first_of_each(spark):
    rows = [(1, 5, None), (1, None, "a"), (1, 7, "b"), (2, None, "c"), (3, 1, "d"), (3, 1, "e")]
    df = spark.createDataFrame(rows, "k long, o long, v string")
    first = lambda *order: {(r.k, r.o, r.v) for r in relational.first_of_each(df, ["k"], order).collect()}
    assert first(Key("o"), Key("v")) == {(1, 5, None), (2, None, "c"), (3, 1, "d")}
    assert first(Key("o", False), Key("v", False)) == {(1, 7, "b"), (2, None, "c"), (3, 1, "e")}
    assert first(Key("o", False), Key("v")) == {(1, 7, "b"), (2, None, "c"), (3, 1, "d")}
    assert len(first()) == 3 and first() == first()
    t = m.data(df, spark=spark)
    assert sorted(r[0] for r in m.into(list, t.distinct("k"))) == [1, 2, 3]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_whole_numbers_at_their_ends(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        t = m.data([(2**31 - 1, -(2**31), 7)], "var * {a: int32, b: int32, c: int32}", spark=spark)
        assert m.into(list, m.merge(p=t.a + 1, q=t.b - 1, r=t.a * 2, s=-t.b, u=t.c + 1)) == [(None, None, None, None, 8)]
        f = m.data([(1e300, 3.0), (-7.0, 2.0), (1.0, 0.0)], "var * {a: float64, b: float64}", spark=spark)
        assert m.into(list, f.a // f.b) == [None, -4, None]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_seconds_are_what_their_type_says(spark):
    t = m.data([(dt.datetime(2000, 1, 1, 1, 2, 3),)], "var * {w: datetime}", spark=spark)
    assert m.into(list, t.w.second) == [3.0] and str(t.w.second.measure) == "float64"


def test_the_service_speaks_json_and_tables_come_back_whole(spark):
    from decimal import Decimal

    from millrace.server.client import Client
    from millrace.server.service import Server, plain

    assert json.loads(json.dumps(plain([1.5, float("inf"), float("-inf"), float("nan")]), allow_nan=False)) == [1.5, "inf", "-inf", None]
    rows = [(1, 1.5, "a", dt.date(2000, 1, 2), dt.datetime(2000, 1, 2, 3, 4, 5, 6), Decimal("1.25"), b"\x00\xff", [1, 2], dt.timedelta(seconds=90)), (2, float("-inf"), None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "i long, f double, s string, d date, w timestamp_ntz, c decimal(10,2), b binary, v array<long>, t interval day to second")
    server = Server({"t": m.data(df, spark=spark)}, port=0).start()
    try:
        client = Client(f"http://127.0.0.1:{server.port}")
        assert client.table("t", spark).collect() == df.collect()
        leaf = client.leaf("t")
        got = client.compute_arrow(leaf[leaf.i == 1][["i", "c", "b", "v"]]).to_pylist()
        assert got == [{"i": 1, "c": Decimal("1.25"), "b": b"\x00\xff", "v": [1, 2]}]
        assert client.compute_arrow(leaf.f.min()).to_pylist() == [{"f_min": float("-inf")}] and client.compute(leaf.f.min())["data"] == "-inf"
        with pytest.raises(RuntimeError):
            client._ask("/compute", {"expr": {"op": "map"}}, "application/vnd.apache.arrow.stream")
    finally:
        server.stop()


def test_web_files_are_read_from_the_shared_folder(spark, tmp_path):
    import threading
    from functools import partial
    from http.server import SimpleHTTPRequestHandler, ThreadingHTTPServer

    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,b\n")
    server = ThreadingHTTPServer(("127.0.0.1", 0), partial(SimpleHTTPRequestHandler, directory=str(tmp_path)))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        t = m.data(f"http://127.0.0.1:{server.server_port}/a.csv", spark=spark)
        assert sorted(m.into(list, t)) == [(1, "a"), (2, "b")]
    finally:
        server.shutdown()
