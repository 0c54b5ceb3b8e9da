"""Expressions to DataFrames and Columns: one plan for a whole expression, left to Catalyst.

``frame`` gives the DataFrame of an expression with rows; ``columns`` the Columns of an
expression over the rows of its root.  Further operations can be added with ``lowering``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, maths, reductions, strings
from ..operators import relational
from ..operators.relational import Key
from . import types
from .expr import ALIGNED, ELEMENTWISE, Bound, Expr, root
from .types import FLOATS, ForeignKey, Record, is_, is_integral

#: What an expression of one column without a name is called in its DataFrame.
VALUE = "value"
ROW_OPS: dict[str, Callable[[Lowering, Expr], DataFrame]] = {}


class NoOrder(ValueError):
    """Rows are asked for by place but have no order."""


def lowering(op: str):
    """Register how an operation with rows becomes a DataFrame."""

    def put(f):
        ROW_OPS[op] = f
        return f

    return put


class Lowering:
    """One lowering: the session, and what the free leaves stand for."""

    def __init__(self, spark: SparkSession, scope: list[tuple[Expr, DataFrame]] = ()):
        self.spark, self.scope = spark, list(scope)
        #: Shifts that stand beside the rows they are aligned with, and their columns' names.
        self.moved: list[tuple[Expr, str]] = []

    # -- rows ------------------------------------------------------------------------------
    def frame(self, e: Expr) -> DataFrame:
        """The rows of ``e``, its columns by its fields (``value`` for a nameless column)."""
        for leaf, df in self.scope:
            if e.isidentical(leaf):
                return df
        if e.op == "reduce" and e.args[1].ndim > 1:
            return self._across(e)
        if not e.dims and e.op != "slice":
            return self._single(e)
        if e.op in ALIGNED:
            df = self._root_frame(e)
            return df.select(*self._named(e))
        if e.op not in ROW_OPS:
            raise NotImplementedError(f"{e.op} has no lowering")
        return ROW_OPS[e.op](self, e)

    def _single(self, e: Expr) -> DataFrame:
        """One row for an expression of a single value or record."""
        if e.op == "summary":
            names, parts = e.args[:2]
            df, put = self._reduced(parts)
            return df.agg(*[put(p).alias(n) for n, p in zip(names, parts, strict=True)])
        parts = _single_parts(e)
        if e.op == "field" and e.args[0].op not in ELEMENTWISE:  # of one record: a summary, or a row taken by its place
            return self.frame(e.args[0]).select(F.col(f"`{e.args[1]}`"))
        if _one_root(parts):
            df, put = self._reduced((e,))
            return df.agg(put(e).alias(e._name or VALUE))
        return self.spark.range(1).select(self._of_parts(e).alias(e._name or VALUE))

    def _of_parts(self, e: Expr) -> Column:
        """A single value whose parts are taken of different rows: a scalar subquery for each run of them over the same rows."""
        if e.op not in ELEMENTWISE or _one_root(_single_parts(e)) or e.op == "field" and e.args[0].op not in ELEMENTWISE:
            return F.lit(e.args[0]) if e.op == "literal" else self.frame(e).scalar()
        return self._combine(e, self._of_parts)

    def _across(self, e: Expr) -> DataFrame:
        """A reduction of arrays over the rows, and perhaps inner axes: a row for each place of the first axis that is left.

        Elements are exploded with their places and aggregated by those that are left, so that no
        array but one of the result is ever put together.
        """
        op, child, axes, keepdims, options = e.args
        name, inner = e._name or VALUE, range(1, child.ndim)
        df = self._root_frame(child).select(self.column(child).alias("__v"))
        for k in inner:
            df = df.select(*[f"__i{j}" for j in range(1, k)], F.posexplode("__v").alias(f"__i{k}", "__v"))
        v = F.col("__v").cast("int") if is_(child.measure, "bool") and op in ("sum", "mean", "var", "std") else F.col("__v")
        out = reductions.aggregate(op, v, **dict(options))
        kept = [(f"__i{k}", F.lit(0) if k in axes else F.col(f"__i{k}")) for k in inner if keepdims or k not in axes]
        if keepdims:
            kept = [("__i0", F.lit(0)), *kept]
        cells = df.groupBy(*[c.alias(n) for n, c in kept]).agg(out.cast(types.to_spark(e.measure)).alias("__v"))
        places = [n for n, _ in kept]
        for j in range(len(places) - 1, 0, -1):
            cells = cells.groupBy(*places[:j]).agg(F.sort_array(F.collect_list(F.struct(places[j], "__v"))).getField("__v").alias("__v"))
        return (cells.orderBy(places[0]) if places else cells).select(F.col("__v").alias(name))

    def _root_frame(self, *es: Expr) -> DataFrame:
        """The rows that expressions are aligned with, and their shifts beside them."""
        es = [e for e in es if e.dims] or list(es)
        base = root(es[0])
        linked = base.op == "link" and any(t.op == "deref" for e in es for t in e.subterms())
        df = _linked(self, base) if linked else self.frame(base)
        wanted: list[Expr] = []
        for x in (x for e in es for x in _shifts(e)):
            if not any(x.isidentical(w) for w in wanted):
                wanted.append(x)
        if not wanted:
            return df
        df, keys, _ = (df, self.order(base), None) if linked else _keyed(self, base)
        while wanted:  # a shift of a shift comes after it
            ready = [x for x in wanted if not any(y.isidentical(w) for y in _shifts(x.args[0]) for w in wanted)]
            named = [(x, f"__shift{len(self.moved) + i}") for i, x in enumerate(ready)]
            df = relational.shifts(df, [(n, self.column(x.args[0]), x.args[1]) for x, n in named], keys)
            self.moved += named
            wanted = [x for x in wanted if not any(x is r for r in ready)]
        return df

    def _named(self, e: Expr) -> list[Column]:
        got = self.columns(e)
        if isinstance(got, dict):
            return [c.alias(n) for n, c in got.items()]
        return [got.alias(e._name or VALUE)]

    def _reduced(self, parts, *more: Expr) -> tuple[DataFrame, Callable[[Expr], Column]]:
        """The rows that reductions are taken of, and what turns an expression of them into an aggregate."""
        below = [t.args[1] for p in parts for t in _single_parts(p)]
        return self._root_frame(*below, *more), lambda p: self._aggregate(p, root(below[0]))

    def _aggregate(self, e: Expr, base: Expr) -> Column:
        """An expression of reductions over ``base`` as an aggregate Column."""
        if e.op == "reduce":
            op, child, _, _, options = e.args
            m = child.measure
            if isinstance(m, Record):
                if op == "nunique":
                    # a row with nulls counts too, which count_distinct over several columns would skip
                    return F.count_distinct(F.struct(*self._named(child)))
                return reductions.aggregate(op, None)
            c = self.column(child)
            if is_(m, "bool") and op in ("sum", "mean", "var", "std"):
                c = c.cast("int")
            out = reductions.aggregate(op, c, delta=is_(m, "timedelta"), **dict(options))
            return out.cast("bigint") if op == "sum" and is_(e.measure, "int64") else out
        return self._combine(e, lambda x: self._aggregate(x, base))

    # -- columns ---------------------------------------------------------------------------
    def column(self, e: Expr) -> Column:
        got = self.columns(e)
        if isinstance(got, dict):
            raise TypeError(f"{e.dshape} is a table")
        return got

    def columns(self, e: Expr) -> Column | dict[str, Column]:
        """The Column of ``e`` over its root's DataFrame; of a table, its Columns by name."""
        if e.op == "literal":
            return F.lit(e.args[0])
        if e.op == "shift" and e.dims and not any(e.isidentical(leaf) for leaf, _ in self.scope):
            return F.col(next(n for x, n in reversed(self.moved) if x.isidentical(e)))
        if e.dims and (e.op not in ELEMENTWISE or any(e.isidentical(leaf) for leaf, _ in self.scope)):
            if isinstance(e.measure, Record):
                return {n: F.col(f"`{n}`") for n in e.measure.names}
            return F.col(f"`{e._name or VALUE}`")
        if not e.dims and (e.op in ("reduce", "summary", "other", "slice") or any(t.op == "reduce" for t in e.subterms())):
            return self.frame(e).scalar()
        return self._combine(e, self.columns)

    def _combine(self, e: Expr, get: Callable[[Expr], Column | dict[str, Column]]):
        """An element-wise operation, its operands got by ``get``."""
        return getattr(self, f"_{e.op}")(e, get)

    def _literal(self, e, get):
        return F.lit(e.args[0])

    def _field(self, e, get):
        t, name = e.args
        got = get(t)
        return got[name] if isinstance(got, dict) else got.getField(name)

    def _deref(self, e, get):
        key, name = e.args
        return F.col(f"`{key._name}.{name}`")

    def _project(self, e, get):
        got = get(e.args[0])
        return {n: got[n] for n in e.args[1]}

    def _label(self, e, get):
        return get(e.args[0])

    def _relabel(self, e, get):
        new = dict(e.args[1])
        return {new.get(n, n): c for n, c in get(e.args[0]).items()}

    def _merge(self, e, get):
        out = {}
        for p in e.args:
            got = get(p)
            out |= got if isinstance(got, dict) else {p._name: got}
        return out

    def _coerce(self, e, get):
        child, to = e.args
        kind = types.to_spark(e.measure)
        c = get(child)
        if is_(child.measure, "datetime") and is_integral(e.measure):
            return dates.micros(c).cast(kind)
        return c.cast(kind)

    def _cast(self, e, get):
        return get(e.args[0])

    def _coalesce(self, e, get):
        kind = types.to_spark(e.measure)
        return F.coalesce(*[get(x).cast(kind) for x in e.args])

    def _map(self, e, get):
        child, f = e.args
        kind = types.to_spark(e.measure)
        got = get(child)
        if isinstance(got, dict):
            names = list(got)

            @F.pandas_udf(kind)
            def of_row(rows: pd.DataFrame) -> pd.Series:
                return pd.Series([f(*r) for r in rows.itertuples(index=False, name=None)], dtype=object)

            return of_row(F.struct(*[got[n].alias(n) for n in names]))

        @F.pandas_udf(kind)
        def of_value(values: pd.Series) -> pd.Series:
            return pd.Series([None if v is None or v is pd.NaT else f(v) for v in values.astype(object).where(values.notna(), None)], dtype=object)

        return of_value(got)

    def _within(self, e, get):
        op, child, axes, keepdims, options = e.args
        kind = types.to_spark(e.measure)

        def at(c: Column, gone: list[bool]) -> Column:
            if all(gone):
                for _ in gone[1:]:
                    c = F.flatten(c)
                out = reductions.of_array(op, c, kind, **dict(options))
                for _ in gone if keepdims else ():
                    out = F.array(out)
                return out
            if not gone[0]:
                return F.transform(c, lambda x: at(x, gone[1:]))
            if keepdims:
                raise NotImplementedError("an axis is kept only when all after it go too")
            # exchange the axis with the next, until nothing but axes that go come after it
            across = F.transform(F.sequence(F.lit(0), F.array_size(c[0]) - 1), lambda j: F.transform(c, lambda x: F.get(x, j)))
            return at(across, [gone[1], gone[0], *gone[2:]])

        return at(get(child), [k in axes for k in range(1, child.ndim)])

    def _isin(self, e, get):
        child, keys = e.args
        c = get(child)
        if isinstance(keys, Expr):
            other = keys.args[0]
            held = self.frame(other).toDF("k")
            # an uncorrelated IN: Catalyst makes it a semi join where it is a condition of rows
            return c.isin(held)
        return c.isin(list(keys))

    def _binary(self, e, get):
        op, a, b = e.args
        x, y = get(a), get(b)
        whole = is_integral(e.measure) and op in maths.WHOLE
        m, n = (t.measure.key if isinstance(t.measure, ForeignKey) else t.measure for t in (a, b))
        if whole:
            return maths.WHOLE[op](x, y)
        if op == "+":
            return F.concat(x, y) if is_(m, "string") else x + y
        if op == "-":
            if is_(m, "date", "datetime") and is_(n, "date", "datetime"):
                return x.cast("timestamp") - y.cast("timestamp")
            return x - y
        if op == "*":
            if is_(m, "string"):
                return F.repeat(x, y.cast("int"))
            if is_(n, "string"):
                return F.repeat(y, x.cast("int"))
            return x * y
        if op == "/":
            return maths.true_div(x, y)
        if op == "//":
            return maths.floor_div(x, y, is_integral(e.measure) and is_integral(m) and is_integral(n)).cast(types.to_spark(e.measure))
        if op == "%":
            return maths.floor_mod(x, y)
        if op == "**":
            return F.pow(x, y)
        simple = {
            "==": lambda: x == y, "!=": lambda: x != y, "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y,
            "&": lambda: x & y, "|": lambda: x | y, "atan2": lambda: F.atan2(x, y), "hypot": lambda: F.hypot(x, y),
            "copysign": lambda: maths.copysign(x, y), "fmod": lambda: maths.fmod(x, y), "ldexp": lambda: maths.ldexp(x, y),
            "greatest": lambda: F.greatest(x, y), "least": lambda: F.least(x, y),
        }
        return simple[op]()

    def _unary(self, e, get):
        op, a = e.args
        c = get(a)
        if op == "not":
            return ~c
        if op == "neg":
            return F.try_subtract(F.lit(0).cast(types.to_spark(e.measure)), c) if is_integral(e.measure) else -c
        if op == "isnan":
            return maths.is_missing(c, is_(a.measure, *FLOATS))
        if op == "notnull":
            return ~maths.is_missing(c, is_(a.measure, *FLOATS))
        if op == "trunc":
            return maths.trunc(c)
        if op in ("abs", "ceil", "floor"):
            return getattr(F, op)(c)
        return maths.unary(op, c)

    def _string(self, e, get):
        fn, a, args = e.args
        c = get(a)
        if fn in strings.PREDICATES:
            return strings.predicate(fn, c)
        if fn == "len":
            return F.length(c).cast("bigint")
        if fn in ("upper", "lower"):
            return getattr(F, fn)(c)
        if fn in ("strip", "lstrip", "rstrip"):
            return strings.strip(c, {"strip": "both", "lstrip": "left", "rstrip": "right"}[fn])
        if fn == "cat":
            return strings.cat(c, get(args[0]), args[1])
        if fn == "interp":
            return strings.interp(c, *[get(x) if isinstance(x, Expr) else F.lit(x) for x in args])
        if fn == "find":
            return strings.find(c, args[0]).cast("bigint")
        return {"capitalize": strings.capitalize, "replace": strings.replace, "pad": strings.pad, "slice": strings.slice_, "char": strings.char_at, "slice_replace": strings.slice_replace, "like": strings.like}[fn](c, *args)

    def _date(self, e, get):
        part, a, args = e.args
        c = get(a)
        if part == "utcfromtimestamp":
            return dates.from_seconds(c)
        if part == "truncate":
            return dates.truncate(c, *args)
        if part == "strftime":
            return dates.strftime(c, args[0])
        if part in ("round", "floor", "ceil"):
            return dates.to_frequency(c, args[0], part)
        if part.startswith("delta_"):
            return dates.DELTA_PARTS[part[6:]](c)
        return dates.PARTS[part](c)

    # -- order -----------------------------------------------------------------------------
    def order(self, e: Expr) -> list[Key]:
        """What the rows of ``e`` are ordered by: the nearest sort below, or the order its source was bound with."""
        if e.op == "sort":
            return self._sort_keys(e)
        if e.op == "data" and e.args[0].order:
            return [Key(n) for n in e.args[0].order]
        if e.op in ELEMENTWISE or e.op in ("select", "head", "tail", "slice", "sample", "shift", "link"):
            return self.order(e.args[-1] if e.op in ("binary",) and not e.args[1].dims else next(i for i in e.inputs if i.dims))
        raise NoOrder("these rows have no order: sort them first, or bind the data with order=")

    def _sort_keys(self, e: Expr) -> list[Key]:
        t, keys, ascending = e.args
        if not keys and not isinstance(t.measure, Record):
            return [Key(t._name or VALUE, ascending)]
        names = keys or tuple(t.fields)
        return [Key(self.column(k) if isinstance(k, Expr) else k, ascending) for k in names]


def _single_parts(e: Expr) -> list[Expr]:
    """What a single value is made of, element by element: reductions, summaries and rows taken by place."""
    if e.op in ELEMENTWISE:
        return [x for i in e.inputs for x in _single_parts(i)]
    return [] if e.op == "literal" else [e]


def _one_root(parts: list[Expr]) -> bool:
    """Whether the parts are reductions of the same rows."""
    if not parts or any(p.op != "reduce" or p.args[1].ndim > 1 for p in parts):
        return False
    first = root(parts[0].args[1])
    return all(root(p.args[1]).isidentical(first) for p in parts[1:])


def _shifts(e: Expr) -> list[Expr]:
    """The shifts among what is aligned with the rows of ``e``, inner ones first."""
    if e.op not in ALIGNED:
        return []
    return [x for i in e.inputs for x in _shifts(i)] + [e] * (e.op == "shift")


def _linked(low: Lowering, e: Expr) -> DataFrame:
    """The rows of a linked table that point somewhere, with the target's fields as ``column.field``."""
    t, column, target, key = e.args
    right = low.frame(target)
    right = right.select(F.col(f"`{key}`").alias("__key"), *[F.col(f"`{n}`").alias(f"{column}.{n}") for n in target.measure.names])
    left = low._root_frame(t)
    return left.join(right, left[column] == right["__key"]).drop("__key")


@lowering("data")
def _data(low: Lowering, e: Expr) -> DataFrame:
    held: Bound = e.args[0]
    if isinstance(held.source, DataFrame):
        return held.source
    if callable(held.source):
        return held.source(low.spark)
    raise TypeError(f"no rows in {held.source!r}")


@lowering("symbol")
def _symbol(low: Lowering, e: Expr) -> DataFrame:
    raise ValueError(f"no data for {e._name!r}")


@lowering("link")
def _link(low: Lowering, e: Expr) -> DataFrame:
    return low.frame(e.args[0])


@lowering("select")
def _select(low: Lowering, e: Expr) -> DataFrame:
    t, pred = e.args
    base = low._root_frame(t, pred)
    return base.filter(low.column(pred)).select(*low._named(t))


@lowering("join")
def _join(low: Lowering, e: Expr) -> DataFrame:
    a, b, left, right, how, rest, more = e.args
    keep = lambda t, keys, names: list(zip([n for n in t.fields if n not in keys], names, strict=True))
    casts = {}
    for l, r in zip(left, right, strict=True):
        if types.to_spark(a.measure[l]) != types.to_spark(e.measure[l]) or types.to_spark(b.measure[r]) != types.to_spark(e.measure[l]):
            casts[l] = types.to_spark(e.measure[l])
    return relational.join(low.frame(a), low.frame(b), list(zip(left, right, strict=True)), how, keep(a, left, rest), keep(b, right, more), casts)


@lowering("concat")
def _concat(low: Lowering, e: Expr) -> DataFrame:
    return low.frame(e.args[0]).union(low.frame(e.args[1]))


@lowering("by")
def _by(low: Lowering, e: Expr) -> DataFrame:
    grouper, names, parts = e.args
    df, put = low._reduced((*parts,), grouper)
    return df.groupBy(*low._named(grouper)).agg(*[put(p).alias(n) for n, p in zip(names, parts, strict=True)])


@lowering("summary")
def _summary(low: Lowering, e: Expr) -> DataFrame:
    return low._single(e)


@lowering("reduce")
def _reduce(low: Lowering, e: Expr) -> DataFrame:
    return low._single(e)


@lowering("sort")
def _sort(low: Lowering, e: Expr) -> DataFrame:
    t = e.args[0]
    keys = low._sort_keys(e)
    if any(isinstance(k, Expr) for k in e.args[1]):
        return low._root_frame(t, *(k for k in e.args[1] if isinstance(k, Expr))).orderBy(*[k.sort for k in keys]).select(*low._named(t))
    return low.frame(t).orderBy(*[k.sort for k in keys])


@lowering("head")
def _head(low: Lowering, e: Expr) -> DataFrame:
    t, n = e.args
    return low.frame(t).limit(n)


def _keyed(low: Lowering, t: Expr) -> tuple[DataFrame, list[Key], list[str]]:
    """The rows of ``t`` with its order's columns beside them, the keys, and the names of the rows' own columns."""
    keys = low.order(t)
    df = low.frame(t)
    if all(k.name in df.columns for k in keys):
        return df, keys, df.columns
    # the keys were projected away or are expressions: take them from the root's rows
    df = low._root_frame(t).select(*low._named(t), *[k.column.alias(f"__o{i}") for i, k in enumerate(keys)])
    return df, [Key(f"__o{i}", k.ascending) for i, k in enumerate(keys)], [n for n in df.columns if not n.startswith("__o")]


@lowering("tail")
def _tail(low: Lowering, e: Expr) -> DataFrame:
    df, keys, names = _keyed(low, e.args[0])
    return relational.tail(df, e.args[1], keys).select(*names)


@lowering("slice")
def _slice(low: Lowering, e: Expr) -> DataFrame:
    t, (kind, *args) = e.args
    df, keys, names = _keyed(low, t)
    if kind == "slice":
        return relational.slice_rows(df, *args, keys).select(*names)
    return relational.take_rows(df, args, keys).select(*names)


@lowering("sample")
def _sample(low: Lowering, e: Expr) -> DataFrame:
    t, n, frac, seed = e.args
    return relational.sample(low.frame(t), n, frac, seed)


@lowering("distinct")
def _distinct(low: Lowering, e: Expr) -> DataFrame:
    t, on = e.args
    if not on:
        return low.frame(t).distinct()
    try:
        df, keys, names = _keyed(low, t)
    except NoOrder:
        df, keys, names = low.frame(t), [], t.fields
    return relational.first_of_each(df, on, keys).select(*[f"`{n}`" for n in names])


@lowering("apply")
def _apply(low: Lowering, e: Expr) -> DataFrame:
    t, f, splittable = e.args
    df = low.frame(t)
    kind = types.to_spark(e.measure)
    from pyspark.sql import types as T

    schema = kind if isinstance(kind, T.StructType) else T.StructType([T.StructField(e._name or VALUE, kind)])

    def each(batches):
        for pdf in batches:
            out = f(pdf)
            yield out if isinstance(out, pd.DataFrame) else pd.DataFrame({schema.names[0]: out})

    if splittable:
        return df.mapInPandas(each, schema)
    # the function needs the whole collection: one task gets it all, as the caller asks
    names = df.columns
    return df.coalesce(1).mapInPandas(lambda batches: each([pd.concat([*batches] or [pd.DataFrame(columns=names)], ignore_index=True)]), schema)
