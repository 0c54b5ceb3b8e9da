"""Expressions as plain trees of JSON, and back.

A tree is ``{"op": ..., "args": [...], ...}``.  Only the operations named here are accepted, and
functions never travel: a tree from elsewhere can compute, but not run code.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from . import expr as E
from .expr import Expr

#: Operations that may come in a tree, and the builder that checks their types again.
BUILDERS: dict[str, Callable] = {
    "field": E.field,
    "project": lambda t, names: E.project(t, list(names)),
    "label": E.label,
    "relabel": lambda t, pairs: E.relabel(t, dict(pairs)),
    "merge": lambda *parts: E.merge(*parts),
    "coerce": E.coerce,
    "cast": E.cast,
    "coalesce": E.coalesce,
    "deref": E.field,
    "select": E.select,
    "sort": lambda t, keys, ascending: _sorted(t, keys, ascending),
    "head": lambda t, n: t.head(n),
    "tail": lambda t, n: t.tail(n),
    "sample": E.sample,
    "shift": E.shift,
    "distinct": lambda t, on: E.distinct(t, *on),
    "concat": E.concat,
    "unary": E.unary,
    "by": lambda grouper, names, parts: E.by(grouper, **dict(zip(names, parts, strict=True))),
    "summary": lambda names, parts, keepdims: E.summary(keepdims, **dict(zip(names, parts, strict=True))),
}
MATH = ("atan2", "copysign", "fmod", "hypot", "ldexp", "greatest", "least")


def _sorted(t, keys, ascending):
    if len(keys) == 1 and isinstance(keys[0], Expr):
        return E.sort(t, keys[0], ascending)
    return E.sort(t, list(keys) or None, ascending)


def _value(v: Any) -> Any:
    if isinstance(v, dt.datetime):
        return {"datetime": v.isoformat()}
    if isinstance(v, dt.date):
        return {"date": v.isoformat()}
    if isinstance(v, dt.timedelta):
        return {"timedelta": v.total_seconds()}
    if isinstance(v, Decimal):
        return {"decimal": str(v)}
    if isinstance(v, frozenset | set):
        return {"set": sorted(map(_value, v), key=repr)}
    if v is None or isinstance(v, (bool, int, float, str)):
        return v
    raise TypeError(f"{v!r} cannot travel")


def to_tree(e: Any, names: dict[Expr, str] | None = None) -> Any:
    """The tree of an expression; leaves in ``names`` go by name."""
    if isinstance(e, tuple):
        return [to_tree(x, names) for x in e]
    if not isinstance(e, Expr):
        return _value(e)
    for leaf, name in (names or {}).items():
        if e.isidentical(leaf):
            return {"leaf": name}
    if e.op == "symbol":
        return {"op": "symbol", "args": [e._name, e.dshape]}
    if e.op == "data":
        raise TypeError("a bound source cannot travel; name it")
    if e.op in ("map", "apply"):
        raise TypeError("functions cannot travel")
    return {"op": e.op, "args": [to_tree(a, names) for a in e.args]} | ({"name": e._name} if e._name else {})


def from_tree(tree: Any, leaves: dict[str, Any] | None = None) -> Any:
    """The expression of a tree; ``leaves`` are what its names stand for."""
    if isinstance(tree, list):
        return tuple(from_tree(x, leaves) for x in tree)
    if not isinstance(tree, dict):
        return tree
    if "leaf" in tree:
        at: Any = leaves
        for part in str(tree["leaf"]).split("/"):
            if not isinstance(at, dict) or part not in at:
                raise ValueError(f"no table {tree['leaf']!r}")
            at = at[part]
        return at
    for kind, make in (("datetime", dt.datetime.fromisoformat), ("date", dt.date.fromisoformat), ("timedelta", lambda s: dt.timedelta(seconds=s)), ("decimal", Decimal)):
        if set(tree) == {kind}:
            return make(tree[kind])
    if set(tree) == {"set"}:
        return frozenset(from_tree(x, leaves) for x in tree["set"])
    if "op" not in tree:
        raise ValueError("a tree needs an operation")
    op, args = tree["op"], [from_tree(a, leaves) for a in tree.get("args", [])]
    return _build(op, args)


def _build(op: str, args: list) -> Expr:
    if op == "symbol":
        return E.symbol(*args)
    if op == "literal":
        return E.literal(*args)
    if op == "binary":
        return (E.binary_math if args[0] in MATH else E.binary)(*args)
    if op == "string":
        return E.string(args[1], args[0], *args[2])
    if op == "date":
        part, e, more = args
        if part == "utcfromtimestamp":
            return e.utcfromtimestamp()
        if part == "truncate":
            return E.truncate(e, *more)
        if part.startswith("delta_"):
            out = getattr(e.dt, part[6:])
            return out() if callable(out) else out
        return E.date_part(e, part, *more)
    if op == "isin":
        e, keys = args
        return E.isin(e, keys.args[0] if isinstance(keys, Expr) else keys)
    if op == "other":
        return Expr("other", (args[0],), (), E.Scalar("bool"))
    if op == "slice":
        t, (kind, *more) = args
        return E.slice_rows(t, slice(*more) if kind == "slice" else list(more) if kind == "list" else more[0])
    if op == "join":
        a, b, left, right, how, rest, more = args
        kept = [n for n in a.fields if n not in left], [n for n in b.fields if n not in right]
        ends = ["_left", "_right"]
        for i, (old, new) in enumerate(((kept[0], rest), (kept[1], more))):
            for x, y in zip(old, new, strict=True):
                if x != y:
                    ends[i] = y.removeprefix(x)
        return E.join(a, b, list(left), list(right), how, tuple(ends))
    if op == "link":
        return E.link(*args)
    if op in ("reduce", "within"):
        name, e, axes, keepdims, options = args
        return E.reduction(name, e, tuple(axes), keepdims, **dict(options))
    if op in BUILDERS:
        return BUILDERS[op](*args)
    raise ValueError(f"no operation {op!r}")
