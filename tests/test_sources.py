"""Spreadsheets, SQLite databases, HDF5 datasets, told types, settled orders and options of the service."""
import datetime as dt
import sqlite3
import sys
import zipfile

import numpy as np
import pytest

import millrace as m
from millrace.operators import relational
from millrace.operators.relational import Key
from millrace.server.client import Client
from millrace.server.service import Server
from millrace.sources import files

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
LINK = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(path, sheets, shared=()):
    with zipfile.ZipFile(path, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{LINK}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{''.join(f'<si><t>{x}</t></si>' for x in shared)}</sst>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{''.join(f'<row>{r}</row>' for r in rows)}</sheetData></worksheet>")


def text(ref, v):
    return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'


def test_spreadsheets(spark, tmp_path):
    head = text("A1", "id") + text("B1", "x") + text("C1", "day") + text("D1", "on") + text("E1", "who")
    one = [head, '<c r="A2"><v>1</v></c><c r="B2"><v>2</v></c><c r="C2" s="1"><v>36526</v></c><c r="D2" t="b"><v>1</v></c><c r="E2" t="s"><v>0</v></c>', "", '<c r="A4"><v>2</v></c><c r="B4"><v>2.5</v></c><c r="E4" t="e"><v>#N/A</v></c>']
    book(tmp_path / "a_1.xlsx", {"first": one, "other": [text("A1", "k"), '<c r="A2"><v>7</v></c>']}, ["Ann"])
    book(tmp_path / "a_2.xlsx", {"first": [text("A1", "who") + text("B1", "id"), text("A2", "Bo") + '<c r="B2"><v>3</v></c>']})
    t = m.data(str(tmp_path / "a_*.xlsx"), spark=spark)
    assert m.frame(t).dtypes == [("id", "bigint"), ("who", "string"), ("x", "double"), ("day", "timestamp_ntz"), ("on", "boolean")]
    assert sorted(m.into(list, t)) == [(1, "Ann", 2.0, dt.datetime(2000, 1, 1), True), (2, None, 2.5, None, None), (3, "Bo", None, None, None)]
    assert m.into(list, m.data(f"{tmp_path}/a_1.xlsx::other", spark=spark)) == [7]
    book(tmp_path / "none.xlsx", {"first": [text("A1", "a")]})
    assert m.into(list, m.data(str(tmp_path / "none.xlsx"), spark=spark)) == []


@pytest.mark.parametrize("part", [3, 1000])
def test_sqlite(spark, tmp_path, part, monkeypatch):
    path = tmp_path / "d.db"
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE t (id INTEGER PRIMARY KEY, name VARCHAR(9), v REAL, raw BLOB, day DATE, "odd ""name" NUMERIC)')
        con.executemany("INSERT INTO t VALUES (?, ?, ?, ?, ?, ?)", [(i, None if i == 4 else f"n{i}", i / 2, bytes([i + 2]), "2000-01-02", "x" if i == 5 else i) for i in range(-2, 11) if i != 3])
        con.execute("CREATE TABLE w (k TEXT PRIMARY KEY) WITHOUT ROWID")
        con.execute("INSERT INTO w VALUES ('z')")
        con.execute("CREATE TABLE none (k INT)")
        con.execute("CREATE TABLE far (k INT)")
        con.executemany("INSERT INTO far (rowid, k) VALUES (?, ?)", [(-(2**62), 1), (0, 2), (2**63 - 1, 3)])
        con.execute("CREATE VIEW seen AS SELECT id, name FROM t WHERE id > 8")
    got = files.sqlite(spark, str(path), "t", part)
    assert [t for _, t in got.dtypes] == ["bigint", "string", "double", "binary", "date", "double"]
    rows = {r[0]: tuple(r) for r in got.collect()}
    assert sorted(rows) == [i for i in range(-2, 11) if i != 3]
    assert rows[4] == (4, None, 2.0, b"\x06", dt.date(2000, 1, 2), 4.0) and rows[5][5] is None
    assert m.into(list, m.data(f"sqlite://{path}::w", spark=spark)) == ["z"] and m.into(list, m.data(f"sqlite://{path}::none", spark=spark)) == []
    assert sorted(m.into(list, m.data(f"sqlite://{path}::seen", spark=spark))) == [(9, "n9"), (10, "n10")]
    monkeypatch.setattr(files, "MOST_PARTS", 5)
    assert sorted(m.into(list, m.data(f"sqlite://{path}::far", spark=spark))) == [1, 2, 3]
    with pytest.raises(ValueError):
        m.data(f"sqlite://{path}::lost", spark=spark)


STAND_IN = '''
import numpy as np


class File:
    """Datasets are arrays in a NumPy archive."""
    def __init__(self, path, mode):
        self.held = np.load(path)
    def __getitem__(self, name):
        return self.held[name]
    def __enter__(self):
        return self
    def __exit__(self, *_):
        pass
'''


def test_hdf5_with_a_stand_in_for_its_library(spark, tmp_path, monkeypatch):
    try:
        import h5py  # noqa: F401
    except ImportError:
        (tmp_path / "h5py.py").write_text(STAND_IN)
        monkeypatch.syspath_prepend(str(tmp_path))
        spark.sparkContext.addPyFile(str(tmp_path / "h5py.py"))
        with open(tmp_path / "d.h5", "wb") as out:
            np.savez(out, t=np.array([(1, 2.5, b"a"), (2, 3.5, b"b"), (3, 4.5, b"c")], dtype=[("id", "i4"), ("v", "f8"), ("s", "S1")]), x=np.arange(12, dtype="i8").reshape(4, 3), none=np.zeros(0))
    else:
        pytest.skip("the library itself is there")
    try:
        got = files.hdf5(spark, str(tmp_path / "d.h5"), "t", part_rows=2)
        assert got.dtypes == [("id", "int"), ("v", "double"), ("s", "string")] and sorted(map(tuple, got.collect())) == [(1, 2.5, "a"), (2, 3.5, "b"), (3, 4.5, "c")]
        x = m.data(f"{tmp_path}/d.h5::x", spark=spark)
        assert sorted(m.into(list, x)) == [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]] and sorted(m.into(list, x.value.sum(axis=1))) == [3, 12, 21, 30]
        assert files.hdf5(spark, str(tmp_path / "d.h5"), "none").count() == 0
    finally:
        sys.modules.pop("h5py", None)


def test_told_types_need_no_pass_over_the_file(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,y\n")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    t = m.data(str(tmp_path / "t.csv"), "var * {id: int64, name: string}", spark=spark)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == len(before)
    assert sorted(m.into(list, t)) == [(1, "x"), (2, "y")]


def test_orders_of_many_ranges_are_settled(spark, monkeypatch):
    monkeypatch.setattr(relational, "RANGE_ROWS", 20)
    monkeypatch.setattr(relational, "MOST_RANGES", 4)
    df = spark.range(3000).repartition(5).selectExpr("id", "CASE WHEN id % 10 = 0 THEN NULL ELSE id % 2 END AS k", "id % 2 = 0 AS even")
    got = relational.with_ordinal(df, [Key("k", False), Key("id")], one_task=10)
    rows = sorted(got.collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in rows] == list(range(3000)) and set(got.columns) == {"id", "k", "even", "ordinal"}
    assert [(r.k, r.id) for r in rows] == sorted(((r.k, r.id) for r in rows), key=lambda p: ({1: 0, 0: 1, None: 2}[p[0]], p[1]))
    tied = sorted(relational.with_ordinal(df.union(df), [Key("k")], one_task=10).collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in tied] == list(range(6000)) and [r.k for r in tied] == [0] * 2400 + [1] * 3000 + [None] * 600


def test_options_of_the_service(spark, tmp_path):
    t = m.data([("Alice", 100), ("Bob", 200)], "var * {name: string, amount: int64}", name="accounts", spark=spark)
    told = []
    server = Server({"accounts": t}, allow_profile=True, profile_folder=str(tmp_path), tell=lambda err: told.append(err) or "told", port=0).start()
    try:
        c = Client(f"http://127.0.0.1:{server.port}")
        leaf = c.leaf("accounts")
        assert c.compute(leaf.sort("amount"), odo_kwargs={"orient": "columns"})["data"] == {"name": ["Alice", "Bob"], "amount": [100, 200]}
        with pytest.raises(RuntimeError, match="413"):
            c.compute(leaf, compute_kwargs={"most_rows": 1})
        with pytest.raises(RuntimeError, match="400"):
            c.compute(leaf, compute_kwargs={"engine": "x"})
        c.compute(leaf.amount.sum(), profile=True)
        assert len(list(tmp_path.glob("*/*"))) == 1
        monkey, server.datashape = server.datashape, None
        server.datashape = lambda: 1 / 0
        with pytest.raises(RuntimeError, match="500"):
            c.dshape  # noqa: B018
        server.datashape = monkey
        assert len(told) == 1 and isinstance(told[0], ZeroDivisionError)
    finally:
        server.stop()


def test_service_tables_keep_their_types(spark):
    df = spark.sql("SELECT 1 a, interval '3' hour c, binary('q') d, array(1, 2) e, timestamp_ntz'2000-01-01 01:02:03' f, cast(1.5 as decimal(10, 2)) g, double('inf') h")
    server = Server({"t": m.data(df, spark=spark), "none": m.data(df.filter("a > 1"), spark=spark)}, port=0).start()
    try:
        c = Client(f"http://127.0.0.1:{server.port}")
        assert c.table("t", spark).collect() == df.collect()
        assert c.table("none", spark).collect() == [] and c.table("none", spark).columns == df.columns
    finally:
        server.stop()
