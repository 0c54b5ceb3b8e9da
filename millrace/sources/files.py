"""Tables in files that Spark has no reader for: spreadsheets, SQLite databases and HDF5 datasets.

Each is read on the executors, in parts where the file can be entered at a row.  SQLite and
HDF5 files are opened by their path, so they must lie in a folder that the driver and all
executors see; spreadsheets come through Spark's own file readers.  The functions that run on
executors stand inside others, so that they travel with the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a task reads of a file that can be entered at a row, and the most tasks; beyond them each reads more.
PART_ROWS, MOST_PARTS = 1_000_000, 10_000


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _ranges(lo: int, hi: int, rows: int) -> list[range]:
    """``range(lo, hi)`` in pieces of ``rows``, or of more where there were too many."""
    step = max(rows, -(-(hi - lo) // MOST_PARTS))
    return [range(i, min(i + step, hi)) for i in range(lo, hi, step)]


# -- spreadsheets ----------------------------------------------------------------------------
def _sheet_reader():
    """A function ``(bytes, sheet) -> rows``; a row is a list of (kind, text) cells, empty ones None."""

    def rows(content: bytes, sheet: str | None):
        import datetime as dt
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
        book = zipfile.ZipFile(io.BytesIO(content))

        def tree(name):
            return ElementTree.fromstring(book.read(name)) if name in book.namelist() else ElementTree.Element("none")

        def text_of(e):
            return "".join(t.text or "" for t in e.iter(f"{main}t"))

        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        top = tree("xl/workbook.xml")
        start = dt.datetime(1904, 1, 1) if any(p.get("date1904") in ("1", "true") for p in top.iter(f"{main}workbookPr")) else dt.datetime(1899, 12, 30)
        sheets = {s.get("name"): targets[s.get(link)] for s in top.iter(f"{main}sheet")}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet!r} among {list(sheets)}")
        place = next(iter(sheets.values())) if sheet is None else sheets[sheet]
        place = place.lstrip("/") if place.startswith("/") else f"xl/{place}"
        shared = [text_of(e) for e in tree("xl/sharedStrings.xml").iter(f"{main}si")]
        styles = tree("xl/styles.xml")
        custom = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower() for f in styles.iter(f"{main}numFmt")}
        # fixed values: the numbers of the built-in formats of dates and times
        dated = {*range(14, 23), *range(45, 48)} | {n for n, code in custom.items() if re.search("[ymdhs]", code)}
        formats = [int(x.get("numFmtId", 0)) for xs in styles.iter(f"{main}cellXfs") for x in xs]

        def cell(c):
            kind, v = c.get("t", "n"), c.find(f"{main}v")
            if kind == "inlineStr":
                return "string", text_of(c)
            if v is None or v.text is None:
                return None
            if kind == "s":
                return "string", shared[int(v.text)]
            if kind == "b":
                return "boolean", "true" if v.text == "1" else "false"
            if kind == "n":
                if formats and formats[int(c.get("s", 0))] in dated:
                    at = start + dt.timedelta(microseconds=round(float(v.text) * 86_400_000_000))
                    return "timestamp_ntz", at.isoformat(" ")
                whole = re.fullmatch(r"[+-]?\d{1,18}", v.text)
                return "bigint" if whole else "double", v.text
            return None if kind == "e" else ("string", v.text)

        def column(ref):
            out = 0
            for ch in ref:
                if not ch.isalpha():
                    break
                out = out * 26 + ord(ch.upper()) - 64
            return out - 1

        with book.open(place) as raw:
            for _, e in ElementTree.iterparse(raw):
                if e.tag != f"{main}row":
                    continue
                out = []
                for i, c in enumerate(e.iter(f"{main}c")):
                    at = column(c.get("r")) if c.get("r") else i
                    out.extend([None] * (at + 1 - len(out)))
                    out[at] = cell(c)
                yield out
                e.clear()

    return rows


def xlsx(spark: SparkSession, path: str, sheet: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """The rows of a sheet (``path::sheet``, else the first) of one or many workbooks, below a line of names.

    A file is one task: a sheet holds at most 1,048,576 rows.  Columns are met by name; without
    a schema a pass over the files finds the types: of differing ones the wider number, else text.
    Empty cells and errors are null, wholly empty rows are left out.
    """
    path, _, named = path.partition("::")
    sheet = sheet or named or None
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = _sheet_reader()

    def kinds(batches):
        import pyarrow as pa

        for batch in batches:
            seen: dict[tuple[str, str], int] = {}
            for content in batch.column(0).to_pylist():
                lines = rows(content, sheet)
                names = [c and c[1] for c in next(lines, [])]
                for i, n in enumerate(names):
                    if n is not None:
                        seen.setdefault((n, ""), i)
                for line in lines:
                    for n, c in zip(names, line):
                        if n is not None and c is not None:
                            seen.setdefault((n, c[0]), names.index(n))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int32())], ["name", "kind", "place"])

    if schema is None:
        # one row for each column and kind
        found = files.mapInArrow(kinds, "name string, kind string, place int").groupBy("name").agg(F.collect_set("kind").alias("kinds"), F.min("place").alias("place")).orderBy("place", "name").collect()

        def wider(kinds):
            kinds = set(kinds) - {""}
            return next(iter(kinds)) if len(kinds) == 1 else "double" if kinds == {"bigint", "double"} else "string"

        wanted = [(r["name"], wider(r["kinds"])) for r in found]
    else:
        wanted = [(f.name, f.dataType) for f in schema.fields]
    names = [n for n, _ in wanted]

    def cells(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0).to_pylist():
                lines = rows(content, sheet)
                head = [c and c[1] for c in next(lines, [])]
                at = [head.index(n) if n in head else None for n in names]
                held = []
                for line in lines:
                    if not any(line):
                        continue
                    held.append([line[i][1] if i is not None and i < len(line) and line[i] is not None else None for i in at])
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], ["cells"])
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], ["cells"])

    got = files.mapInArrow(cells, "cells array<string>")
    return got.select(*[F.try_element_at("cells", F.lit(i + 1)).cast(kind).alias(n) for i, (n, kind) in enumerate(wanted)])


# -- SQLite ----------------------------------------------------------------------------------
#: The affinity rules of declared types in SQLite, in the order in which they are tried.
AFFINITY = (("BOOL", "boolean"), ("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("TIME", "timestamp_ntz"), ("DATE", "date"))


def sqlite(spark: SparkSession, path: str, name: str, part_rows: int = PART_ROWS) -> DataFrame:
    """A table or view of an SQLite database: ``sqlite:///folder/file.db::name``.

    A table with row ids is read in ranges of them, one task each; a view or a table without
    them in one task.  Values that do not fit their declared type are null.
    """
    import sqlite3

    path = _local(path)
    quoted = '"' + name.replace('"', '""') + '"'
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        columns = [(n, next((t for word, t in AFFINITY if word in (declared or "").upper()), "double")) for _, n, declared, *_ in con.execute(f"PRAGMA table_info({quoted})")]
        if not columns:
            raise ValueError(f"no table {name!r} in {path}")
        try:
            lo, hi = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted}").fetchone()
            parts = [(0, -1, False)] if lo is None else [(r.start, r[-1], False) for r in _ranges(lo, hi + 1, part_rows)]
            if not con.execute("SELECT 1 FROM sqlite_master WHERE name = ? AND type = 'table'", (name,)).fetchone():
                parts = [(0, 0, True)]
        except sqlite3.OperationalError:  # no row ids
            parts = [(0, 0, True)]
    wanted = ", ".join('"' + n.replace('"', '""') + '"' for n, _ in columns)
    kinds = ["binary" if t == "binary" else "string" for _, t in columns]

    def read(batches):
        import sqlite3

        import pyarrow as pa

        types = [pa.binary() if k == "binary" else pa.string() for k in kinds]

        def plain(v, k):
            if v is None or isinstance(v, bytes) == (k == "binary"):
                return v if v is None or k == "binary" or isinstance(v, str) else repr(v)
            return v.decode(errors="replace") if k == "string" else str(v).encode()

        con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        for batch in batches:
            for p in batch.to_pylist():
                where, args = ("", ()) if p["whole"] else (" WHERE rowid BETWEEN ? AND ?", (p["lo"], p["hi"]))
                cursor = con.execute(f"SELECT {wanted} FROM {quoted}{where}", args)
                while held := cursor.fetchmany(10_000):
                    yield pa.RecordBatch.from_arrays([pa.array([plain(v, k) for v in column], t) for column, k, t in zip(zip(*held), kinds, types)], [f"c{i}" for i in range(len(kinds))])

    asked = spark.createDataFrame(parts, "lo long, hi long, whole boolean").repartition(len(parts))
    got = asked.mapInArrow(read, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)))
    return got.select(*[(F.col(f"c{i}") if t in ("string", "binary") else F.col(f"c{i}").try_cast(t)).alias(n) for i, (n, t) in enumerate(columns)])


# -- HDF5 ------------------------------------------------------------------------------------
def hdf5(spark: SparkSession, path: str, dataset: str | None = None, part_rows: int = PART_ROWS) -> DataFrame:
    """A dataset of an HDF5 file: ``file.h5::group/name``; needs ``h5py`` on the driver and the executors.

    Records are columns; of an array each row along the first axis is a value, or an array of them.
    Rows are read in ranges, one task each.
    """
    import h5py
    import numpy as np

    path, _, named = path.partition("::")
    path, dataset = _local(path), dataset or named
    with h5py.File(path, "r") as f:
        shape, dtype = f[dataset].shape, f[dataset].dtype
    #: Spark's names of NumPy's numbers; unsigned ones take the next wider type.
    plain = {"b1": "boolean", "i1": "tinyint", "i2": "smallint", "i4": "int", "i8": "bigint", "u1": "smallint", "u2": "int", "u4": "bigint", "f4": "float", "f8": "double"}

    def kind(t, depth):
        name = plain.get(np.dtype(t).str[1:], "string")
        return "array<" * depth + name + ">" * depth

    fields = [(n, kind(dtype[n].base, len(dtype[n].shape))) for n in dtype.names] if dtype.names else [("value", kind(dtype, len(shape) - 1))]

    def read(batches):
        import h5py
        import pyarrow as pa

        def texts(v):
            return v.decode(errors="replace") if isinstance(v, bytes) else [texts(x) for x in v] if isinstance(v, list) else v

        for batch in batches:
            for p in batch.to_pylist():
                with h5py.File(path, "r") as f:
                    got = f[dataset][p["lo"] : p["hi"]]
                for i in range(0, len(got), 10_000):
                    some = got[i : i + 10_000]
                    columns = [some[n].tolist() for n, _ in fields] if some.dtype.names else [some.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([texts(v) for v in c], t) for c, t in zip(columns, arrow)], [n for n, _ in fields])

    from pyspark.sql.pandas.types import to_arrow_type

    parts = [(r.start, r.stop) for r in _ranges(0, shape[0], part_rows)]
    made = T.StructType([T.StructField(n, T.DataType.fromDDL(k)) for n, k in fields])
    arrow = [to_arrow_type(x.dataType) for x in made.fields]
    asked = spark.createDataFrame(parts, "lo long, hi long")
    return (asked.repartition(len(parts)) if parts else asked).mapInArrow(read, made)
