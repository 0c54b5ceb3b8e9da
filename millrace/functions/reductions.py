"""Reductions as aggregate Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def _delta(micros: Column) -> Column:
    """A time difference of microseconds; null where it does not hold them."""
    held = F.when(F.abs(micros) <= (1 << 63) - 1, micros).cast("bigint")
    day, minute = 24 * 60 * 60 * 10**6, 60 * 10**6
    days = F.call_function("div", held, F.lit(day)).cast("int")
    minutes = F.call_function("div", held % day, F.lit(minute)).cast("int")
    return F.make_dt_interval(days, F.lit(0), minutes, ((held % minute).cast("decimal(18,0)") / 10**6).cast("decimal(18,6)"))


def _spread(kind: str, c: Column, unbiased: bool, delta: bool) -> Column:
    from .dates import delta_micros

    f = {"var": (F.var_pop, F.var_samp), "std": (F.stddev_pop, F.stddev_samp)}[kind][bool(unbiased)]
    if not delta:
        return f(c)
    seconds = f(delta_micros(c) / 10**6)
    return _delta(seconds.cast("decimal(24,6)") * 10**6) if kind == "std" else seconds


def _of_deltas(op: str, c: Column) -> Column:
    """The exact sum or mean of time differences, the latter in whole microseconds.

    They are added up as decimals, which hold a billion of the longest at least; Spark's own sum and mean add
    them up in 64 bits and fail when that goes beyond 292,000 years, as 12,000 differences of 24 years do.
    """
    from .dates import delta_micros

    total = F.sum(delta_micros(c).cast("decimal(28,0)"))
    return _delta(F.round(total / F.count(c)) if op == "mean" else total)


def _norm(c: Column, order) -> Column:
    size = F.abs(c.cast("double"))
    if order in (None, 2, "fro"):
        return F.sqrt(F.sum(size * size))
    if order == float("inf"):
        return F.max(size)
    if order == float("-inf"):
        return F.min(size)
    if order == 0:
        return F.sum((size != 0).cast("int"))
    if order == 1:
        return F.sum(size)
    return F.pow(F.sum(F.pow(size, F.lit(float(order)))), F.lit(1.0 / order))


def aggregate(op: str, c: Column | None, *, unbiased: bool = False, order=None, delta: bool = False) -> Column:
    """The aggregate for a reduction; ``c`` is None to count rows.

    Nulls are skipped; of nothing, sums and the like are null, counts 0.
    """
    if op == "nelements" or c is None:
        return F.count(F.lit(1))
    if op in ("var", "std"):
        return _spread(op, c, unbiased, delta)
    if delta and op in ("sum", "mean"):
        return _of_deltas(op, c)
    if op == "vnorm":
        return _norm(c, order)
    plain = {"sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "any": F.bool_or, "all": F.bool_and, "count": F.count, "nunique": F.count_distinct}
    return plain[op](c)


def of_array(op: str, a: Column, kind: DataType, *, unbiased: bool = False, order=None) -> Column:
    """The reduction of an array in each row, of type ``kind``; nulls are skipped, and of nothing sums and the like are null, counts 0."""
    x = F.filter(a, lambda v: v.isNotNull())
    n = F.coalesce(F.array_size(x), F.lit(0))
    total = lambda f, of=x: F.aggregate(of, F.lit(0.0), lambda t, v: t + f(v.cast("double")))
    some = lambda c: F.when(n > 0, c)
    if op == "nelements":
        out = F.coalesce(F.array_size(a), F.lit(0))
    elif op == "count":
        out = n
    elif op == "nunique":
        out = F.coalesce(F.array_size(F.array_distinct(x)), F.lit(0))
    elif op in ("min", "max"):
        out = F.array_min(x) if op == "min" else F.array_max(x)
    elif op in ("any", "all"):
        out = some((F.exists if op == "any" else F.forall)(x, lambda v: v))
    elif op == "sum":
        out = some(F.aggregate(x, F.lit(0).cast(kind), lambda t, v: (t + v.cast(kind)).cast(kind)))
    elif op == "mean":
        out = some(total(lambda v: v) / n)
    elif op in ("var", "std"):
        mean = total(lambda v: v) / F.when(n > 0, n)
        out = total(lambda v: (v - mean) * (v - mean)) / F.when(n > int(bool(unbiased)), n - int(bool(unbiased)))
        out = F.sqrt(out) if op == "std" else out
    else:
        size = F.transform(x, lambda v: F.abs(v.cast("double")))
        if order in (float("inf"), float("-inf")):
            out = F.array_max(size) if order > 0 else F.array_min(size)
        elif order == 0:
            out = some(total(lambda v: F.when(v != 0, 1.0).otherwise(0.0), size))
        else:
            p = 2.0 if order in (None, "fro") else float(order)
            out = some(F.pow(total(lambda v: F.pow(v, F.lit(p)), size), F.lit(1 / p)))
    return out.cast(kind)
