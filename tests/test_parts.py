"""Arrays, sources, the service and streams."""
import json
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

import millrace as m
from millrace.operators.arrays import LongArray
from millrace.server.client import Client
from millrace.server.service import Server
from millrace.sources import catalog, resources
from millrace.streaming import windows


def test_arrays_like_numpy(spark):
    a, b = np.arange(24.0).reshape(2, 3, 4), np.arange(12.0).reshape(4, 3) + 1
    x, y = LongArray.of(spark, a), LongArray.of(spark, b)
    assert np.array_equal(x.T.to_numpy(), a.T) and np.array_equal(x.transpose([1, 0, 2]).to_numpy(), a.transpose(1, 0, 2))
    assert np.array_equal(x.dot(y).to_numpy(), a.dot(b)) and np.array_equal(x.tensordot(y, ([1, 2], [1, 0])).to_numpy(), np.tensordot(a, b, ([1, 2], [1, 0])))
    assert np.array_equal(x.reduce("sum", axis=1).to_numpy(), a.sum(1)) and np.array_equal(x.reduce("max", axis=(0, 2), keepdims=True).to_numpy(), a.max((0, 2), keepdims=True))
    assert np.allclose(x.reduce("std", axis=-1).to_numpy(), a.std(-1)) and x.reduce("sum").rows.first()[0] == a.sum()
    assert np.array_equal(x[1].to_numpy(), a[1]) and np.array_equal(x[:, ::-1, 1:3].to_numpy(), a[:, ::-1, 1:3]) and np.array_equal(x[0, [2, 0, 2]].to_numpy(), a[0, [2, 0, 2]])
    assert np.array_equal(x.combine(LongArray.of(spark, np.arange(4.0)), lambda p, q: p * q).to_numpy(), a * np.arange(4.0))
    assert np.array_equal(x.concat(x, axis=1).to_numpy(), np.concatenate([a, a], 1)) and x.nelements() == 24 and x.nelements(axis=(0, 2)) == 8
    for bad in (lambda: x.tensordot(y, 1 + 1), lambda: x.transpose([0, 0, 1]), lambda: x.concat(y), lambda: x.combine(y, lambda p, q: p), lambda: x.reduce("sum", axis=5)):
        with pytest.raises(ValueError):
            bad()


def test_files(spark, tmp_path):
    t = m.data([(1, "a, b", 1.5), (2, "c", None)], "var * {id: int32, name: string, v: ?float64}", spark=spark)
    for suffix in ("csv", "tsv", "json", "jsonl", "parquet", "orc"):
        path = str(tmp_path / f"t.{suffix}")
        m.into(path, t)
        got = m.data(path, spark=spark)
        assert set(m.into(list, got[["id", "name", "v"]])) == {(1, "a, b", 1.5), (2, "c", None)}, suffix
    resources.append(str(tmp_path / "t.parquet"), m.frame(t))
    assert m.compute(m.data(str(tmp_path / "t.parquet"), spark=spark).nrows) == 4
    resources.drop(str(tmp_path / "t.parquet"), spark)
    (tmp_path / "p_1.csv").write_text("id, name\n1, x\n")
    (tmp_path / "p_2.csv").write_text("id, name\n2, y\n")
    assert set(m.into(list, m.data(str(tmp_path / "p_*.csv"), spark=spark))) == {(1, "x"), (2, "y")}
    with pytest.raises(NotImplementedError):
        resources.resource("x.unknown", spark)
    (tmp_path / "c.yaml").write_text("one:\n  source: p_1.csv\ntwo: t.orc\n")
    db = catalog.from_file(str(tmp_path / "c.yaml"), spark, views=True)
    assert db.fields == ["one", "two"] and m.compute(db.one.nrows) == 1 and spark.table("one").count() == 1
    found = catalog.from_directory(str(tmp_path), spark)
    assert {"p_1", "t"} <= set(found)


def test_tables(spark):
    spark.sql("DROP TABLE IF EXISTS held")
    m.into("table:held", m.data([(1,)], "var * {x: int64}", spark=spark))
    assert m.into(list, m.data("table:held", spark=spark)) == [1]
    resources.drop("table:held", spark)


def test_service(spark):
    t = m.data([("Alice", 100), ("Bob", 200)], "var * {name: string, amount: int64}", name="accounts", spark=spark)
    server = Server({"accounts": t}, authorize=lambda h: h == "yes", allow_add=True, allow_profile=True, port=0).start()
    try:
        c = Client(f"http://127.0.0.1:{server.port}", "yes")
        leaf = c.leaf("accounts")
        assert c.compute(leaf.amount.sum())["data"] == 300
        got = c.compute(leaf[leaf.amount > 100], profile=True)
        assert got["data"] == [["Bob", 200]] and got["names"] == ["name", "amount"] and "profile" in got and got["datashape"] == leaf.dshape
        assert sorted(map(tuple, c.table("accounts", spark).collect())) == [("Alice", 100), ("Bob", 200)]
        assert c.add(again="/root/testdata/sf0.001/region.parquet") == {"added": ["again"]} and "again" in c.dshape
        for bad, status in (({"nothing": 1}, 400), ({"expr": {"op": "eval", "args": []}}, 400), ({"expr": {"leaf": "lost"}}, 400)):
            with pytest.raises(RuntimeError, match=str(status)):
                c._ask("/compute", bad)
        with pytest.raises(RuntimeError, match="401"):
            Client(c.url).dshape  # noqa: B018
        with pytest.raises(RuntimeError, match="404"):
            c._ask("/lost")
        request = urllib.request.Request(c.url + "/compute", b"x", {"Content-Type": "application/pickle", "Authorization": "yes"})
        with pytest.raises(urllib.error.HTTPError, match="415"):
            urllib.request.urlopen(request)
        assert json.dumps(m.to_tree(leaf.amount.sum(), {leaf: "accounts"}))
    finally:
        server.stop()


def test_streams_refuse_what_needs_all_rows(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 2 AS k", "timestamp_seconds(id * 600) AS ts").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("id long, k long, ts timestamp").parquet(str(tmp_path / "s"))
    e = m.symbol("e", "var * {id: int64, k: int64, ts: datetime}")
    for bad in (e.sort("id"), e.head(3), e.id.shift(1), e.distinct("k"), e[1:2]):
        with pytest.raises(ValueError):
            windows.stream_frame(bad, e, stream)
    with pytest.raises(ValueError):
        windows.stream_frame(e, e, spark.range(1))
    for name, df, want in (
        ("by_key", windows.stream_frame(m.by(e[e.id > 1].k, n=e[e.id > 1].id.sum()), e, stream), {(0, 20), (1, 24)}),
        ("by_hour", windows.windowed(stream, "ts", "1 hour", n=F.count(F.lit(1))).select("n"), {(6,), (4,)}),
        ("by_session", windows.sessions(stream, "ts", "21 minutes", ["k"], n=F.count(F.lit(1))).select("k", "n"), {(0, 5), (1, 5)}),
    ):
        q = df.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination()
        assert {tuple(r) for r in spark.table(name).collect()} == want
