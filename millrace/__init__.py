"""millrace: a typed expression algebra that lowers to Spark DataFrame plans."""

from __future__ import annotations

from .functions.maths import UNARY as _UNARY
from .plans import expr as _expr
from .plans.expr import (
    Expr, apply, binary_math, by, cast, coalesce, coerce, concat, count_values, distinct, drop_field, isin, join, label, link, literal, merge, project,
    relabel, sample, select, shift, sort, summary, symbol, transform, truncate,
)
from .plans.results import CachedDataset, Database, compute, convert, create_index, data, frame, into, peek
from .plans.tree import from_tree, to_tree

inf, nan = float("inf"), float("nan")

# free functions: one for each function of a column
for _name in (*_UNARY, "abs", "ceil", "floor", "trunc", "isnan", "notnull"):
    globals()[_name] = (lambda name: lambda e: _expr.unary(name, e))(_name)
for _name in ("atan2", "copysign", "fmod", "hypot", "ldexp", "greatest", "least"):
    globals()[_name] = (lambda name: lambda a, b: _expr.binary_math(name, a, b))(_name)
for _name in _expr.REDUCTIONS:
    globals()[_name] = (lambda name: lambda e, *args, **kw: getattr(e, name)(*args, **kw))(_name)
for _name in ("date", "time", "year", "month", "day", "hour", "minute", "second", "millisecond", "microsecond"):
    globals()[_name] = (lambda name: lambda e: _expr.date_part(e, name))(_name)


def head(t, n=10):
    return t.head(n)


def tail(t, n=10):
    return t.tail(n)


def like(e, glob):
    return e.like(glob)


def shape(e):
    return e.shape


def ndim(e):
    return e.ndim
