"""Computing expressions and looking at them."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import types
from .expr import Expr, bound, constant_type
from .lower import VALUE, Lowering
from .types import Record, is_


def session() -> SparkSession:
    """The active session, or a local one."""
    return SparkSession.getActiveSession() or SparkSession.builder.master("local[*]").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def as_frame(source: Any, spark: SparkSession, measure=None) -> DataFrame:
    """A DataFrame of what a leaf can be bound to: a DataFrame, a path or URI, rows, a dict of columns, pandas.

    Text files are read with the types of ``measure`` where it is given, without a pass to find them out.
    """
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, Expr):
        return Lowering(spark).frame(source)
    if isinstance(source, str):
        from ..sources.resources import resource, takes_schema

        told = {"schema": types.to_spark(measure)} if isinstance(measure, Record) and takes_schema(source) else {}
        return resource(source, spark, **told)
    kind = types.to_spark(measure) if isinstance(measure, Record) else None
    if isinstance(source, RDD):
        return spark.createDataFrame(source, kind)
    if isinstance(source, pd.DataFrame):
        rows = source.astype(object).where(source.notna(), None)
        return spark.createDataFrame(list(map(tuple, rows.itertuples(index=False, name=None))), kind) if kind else spark.createDataFrame(source)
    if isinstance(source, dict):
        return as_frame(pd.DataFrame(source), spark, measure)
    if hasattr(source, "dtype") and getattr(source, "ndim", 0) == 1 and source.dtype.names:
        source = source.tolist()
    rows = list(source)
    if rows and not isinstance(rows[0], (tuple, list, dict)):
        rows = [(r,) for r in rows]
        kind = kind or (f"{VALUE} {types.to_spark(measure).simpleString()}" if measure is not None else [VALUE])
    return spark.createDataFrame(rows, kind)


def _scope(e: Expr, data: Any, spark: SparkSession) -> list[tuple[Expr, DataFrame]]:
    free = [leaf for leaf in e.leaves() if leaf.op == "symbol"]
    if data is None:
        return []
    if isinstance(data, dict) and all(isinstance(k, Expr) for k in data):
        pairs = list(data.items())
    elif len(free) == 1:
        pairs = [(free[0], data)]
    else:
        raise ValueError("say which data is for which leaf")
    out = []
    for leaf, source in pairs:
        if isinstance(leaf.measure, Record) and not leaf.dims and isinstance(source, dict):
            # a database: its fields are tables
            for name, table in source.items():
                out.append((leaf[name], as_frame(table, spark)))
            continue
        df = as_frame(source, spark, leaf.measure)
        out.append((leaf, df))
    return out


def frame(e: Expr, data: Any = None, spark: SparkSession | None = None) -> DataFrame:
    """The DataFrame of an expression; nothing runs."""
    spark = spark or session()
    return Lowering(spark, _scope(e, data, spark)).frame(e)


def compute(e: Expr, data: Any = None, return_type: Any = "core", spark: SparkSession | None = None) -> Any:
    """The value of an expression.

    ``return_type`` is ``native`` (a DataFrame), ``core`` (a Python value, a pandas DataFrame or
    Series), or one of the types that :func:`into` knows.
    """
    df = frame(e, data, spark)
    if return_type in ("native", DataFrame):
        return df
    if return_type != "core":
        return convert(df, return_type)
    if not e.dims:
        row = df.first()
        if isinstance(e.measure, Record):
            return tuple(row) if row else None
        value = row[0] if row else None
        return _core(value, e)
    got = df.toPandas()
    return got if isinstance(e.measure, Record) else got.iloc[:, 0]


def _core(value, e: Expr):
    if value is None:
        return None
    if is_(e.measure, "datetime", "date", "timedelta", "string", "bool"):
        return value
    return float(value) if is_(e.measure, "float32", "float64") else value


def convert(df: DataFrame, to: Any):
    """A DataFrame as another type: list, tuple, set, dict, iterator, pandas, NumPy or Arrow."""
    import numpy as np
    import pyarrow as pa

    if to in (list, tuple, set, frozenset):
        rows = [tuple(r) if len(df.columns) > 1 else r[0] for r in df.collect()]
        return to(rows)
    if to is dict:
        return {k: list(v) for k, v in df.toPandas().items()}
    if to is Iterator or to is iter:
        return (tuple(r) if len(df.columns) > 1 else r[0] for r in df.toLocalIterator())
    if to is pd.DataFrame:
        return df.toPandas()
    if to is pd.Series:
        return df.toPandas().iloc[:, 0]
    if to is np.ndarray:
        got = df.toPandas()
        return got.iloc[:, 0].to_numpy() if got.shape[1] == 1 else got.to_records(index=False)
    if to is pa.Table:
        return df.toArrow()
    if to in (int, float, str, bool):
        return to(df.first()[0])
    raise NotImplementedError(f"no conversion to {to!r}")


def into(to: Any, e: Any, data: Any = None, **options):
    """An expression's rows (or any source's) as a type, or written to a path or table: ``into('out.parquet', t)``."""
    from ..sources.resources import write

    spark = session()
    df = frame(e, data, spark) if isinstance(e, Expr) else as_frame(e, spark)
    return write(df, to, **options) if isinstance(to, str) else convert(df, to)


def iterate(e: Expr):
    return convert(frame(e), iter)


def peek(e: Expr, n: int = 10):
    """The first rows of a bound expression as pandas, or its value."""
    if any(leaf.op == "symbol" for leaf in e.leaves()):
        return e
    if not e.dims:
        return compute(e)
    return frame(e).limit(n + 1).toPandas()


def short(e: Expr, n: int = 10) -> str:
    """What an expression looks like: of a bound one the first rows, else how it was built."""
    if any(leaf.op == "symbol" for leaf in e.leaves()) or not e.leaves():
        return str(e)
    got = peek(e, n)
    if not e.dims:
        return repr(got)
    return f"{got.head(n)}" + ("\n..." if len(got) > n else "")


def to_html(e: Expr, n: int = 10) -> str:
    if any(leaf.op == "symbol" for leaf in e.leaves()):
        return f"<pre>{e}</pre>"
    got = peek(e, n)
    return got.head(n).to_html() if isinstance(got, pd.DataFrame) else f"<pre>{got}</pre>"


def data(source: Any, dshape: str | None = None, name: str | None = None, fields: list[str] | None = None, order=(), spark: SparkSession | None = None, schema: str | None = None) -> Expr:
    """A leaf bound to a source; its type is found out unless told, as ``dshape`` or as the ``schema`` of its rows.

    An array of two or more dimensions is a column of arrays, or a table if ``fields`` are named.
    ``order`` names columns that put the rows in order for ``tail``, slices and ``shift`` where
    no sort is given.
    """
    if isinstance(source, Expr):
        return source
    spark = spark or session()
    if schema is not None:
        if dshape is not None:
            raise TypeError("give dshape or schema")
        dshape = f"var * {schema}"
    if getattr(source, "ndim", 0) > 1 and hasattr(source, "dtype") and hasattr(source, "tolist"):
        if fields or dshape:
            source = list(map(tuple, source.tolist()))
        else:
            shape, kind = source.shape, constant_type(source.flat[0].item() if source.size else 0.0)
            kind = types.Scalar(str(source.dtype)) if str(source.dtype) in types.SPARK else kind
            df = spark.createDataFrame([(r,) for r in source.tolist()], f"`{name or VALUE}` {types.to_spark(types.Nested(shape[1:], kind)).simpleString()}")
            return bound(df, tuple(shape), kind, name or VALUE, order)
    if isinstance(source, dict) and source and all(isinstance(v, (str, DataFrame)) for v in source.values()):
        return Database({k: data(v, name=k, spark=spark) for k, v in source.items()})
    measure = types.parse(dshape)[1] if dshape else None
    df = as_frame(source, spark, measure)
    if fields:
        df = df.toDF(*fields)
    found = types.from_spark(df.schema)
    if measure is None:
        measure = found
    elif isinstance(measure, Record) and df.columns != measure.names:
        df = df.toDF(*measure.names)
    if not isinstance(measure, Record):
        df = df.toDF(name or VALUE)
        return bound(df, ("var",), measure, name or VALUE, order)
    if [n for n in order if n not in df.columns]:
        raise ValueError(f"{list(order)} are not all columns")
    return bound(df, ("var",), measure, name, order)


class Database(dict):
    """Named bound tables, by key or attribute."""

    def __getattr__(self, name: str):
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None

    @property
    def fields(self) -> list[str]:
        return list(self)

    @property
    def dshape(self) -> str:
        return "{" + ", ".join(f"{k}: {v.dshape}" for k, v in self.items()) + "}"


class CachedDataset:
    """A source whose computed expressions are kept: the DataFrame of each is persisted on first use."""

    def __init__(self, source: Any, dshape: str | None = None):
        self.data = source if isinstance(source, Expr) else data(source, dshape)
        self.held: dict[Expr, DataFrame] = {}

    def compute(self, build, return_type: Any = "core"):
        """The value of ``build(leaf)``, from the cache if it was computed before."""
        e = build(self.data)
        known = next((k for k in self.held if k.isidentical(e)), None)
        if known is None:
            self.held[e] = frame(e).persist()
            known = e
        df = self.held[known]
        if return_type != "core":
            return df if return_type == "native" else convert(df, return_type)
        return (df.first()[0] if not isinstance(e.measure, Record) else tuple(df.first())) if not e.dims else df.toPandas()

    def clear(self) -> None:
        for df in self.held.values():
            df.unpersist()
        self.held.clear()


def create_index(source: Any, columns, name: str | None = None, unique: bool = False, ignore_existing: bool = False, concurrently: bool = False) -> Any:
    """Checks the columns and does nothing else: columnar files are pruned by their statistics, which sorted writing sharpens.

    With ``unique`` the values are counted, and repeated ones are an error.
    """
    e = source if isinstance(source, Expr) else data(source)
    names = [columns] if isinstance(columns, str) else list(columns)
    if any(n not in e.fields for n in names):
        raise ValueError(f"{e.dshape} lacks some of {names}")
    if unique and not frame(e).groupBy(*names).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise ValueError(f"{names} repeat")
    return source
