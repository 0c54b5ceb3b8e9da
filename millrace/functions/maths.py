"""Arithmetic and mathematics on Columns.

Division, remainder and overflow of whole numbers are guarded, so they behave alike in ANSI and
other sessions: what has no value is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Functions of one number that give a double and bear Spark's own name.
UNARY = (
    "sqrt sin sinh cos cosh tan tanh exp expm1 log log10 log1p acos acosh asin asinh atan atanh radians degrees"
).split()


#: Sums, differences and products of whole numbers; null where the type does not hold them.
WHOLE = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}


def unary(name: str, c: Column) -> Column:
    """One of :data:`UNARY`."""
    if name not in UNARY:
        raise ValueError(f"no such function: {name}")
    return getattr(F, name)(c.cast("double"))


def true_div(a: Column, b: Column) -> Column:
    """Division of doubles as in IEEE 754: x/0 is infinite or NaN, never an error; null if either is."""
    x, y = a.cast("double"), b.cast("double")
    by_zero = F.when(F.isnan(x) | (x == 0), F.lit(float("nan"))).otherwise(F.signum(x) * F.lit(float("inf")))
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when(y == 0, by_zero).otherwise(x / F.when(y != 0, y))


def floor_div(a: Column, b: Column, integral: bool) -> Column:
    """Division rounded down, a whole number; null where the divisor is zero or the type does not hold it.  Whole numbers are never taken through doubles."""
    if not integral:
        q = a.cast("double") / F.when(b != 0, b.cast("double"))
        return F.when(F.abs(q) < float(1 << 63), F.floor(q))
    x, y = a.cast("long"), F.when(b != 0, b.cast("long"))
    q = F.call_function("div", x, y)
    return F.when((x % y != 0) & ((x < 0) != (y < 0)), q - 1).otherwise(q)


def floor_mod(a: Column, b: Column) -> Column:
    """The remainder with the sign of the divisor; null where the divisor is zero."""
    y = F.when(b != 0, b)
    r = a % y
    return F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r)


def trunc(c: Column) -> Column:
    return c.cast("bigint")


def copysign(a: Column, b: Column) -> Column:
    return F.abs(a.cast("double")) * F.when(b < 0, F.lit(-1.0)).otherwise(F.lit(1.0))


def fmod(a: Column, b: Column) -> Column:
    """The remainder with the sign of the dividend; null where the divisor is zero."""
    return a.cast("double") % F.when(b != 0, b.cast("double"))


def ldexp(a: Column, b: Column) -> Column:
    return a.cast("double") * F.pow(F.lit(2.0), b)


def truncate(c: Column, p) -> Column:
    """The multiple of ``p`` at or below the number."""
    return F.floor(c / F.lit(p)) * F.lit(p)


def is_missing(c: Column, floating: bool) -> Column:
    """Null, or for floating-point numbers also NaN."""
    return (F.isnan(c) | c.isNull()) if floating else c.isNull()
