"""Types, names and errors of expressions, without data."""
import pytest

import millrace as m
from millrace.plans import types
from millrace.plans.types import Scalar

T = m.symbol("t", "var * {name: ?string, amount: int32, id: int64, price: float64, when: datetime, day: date, ok: bool}")
U = m.symbol("u", "var * {name: string, city: string, id: int32}")


@pytest.mark.parametrize(
    "text",
    ["var * {name: ?string, amount: int64}", "10 * 20 * float32", "int8", "?datetime", "var * {a: var * {b: int32}, c: map[int64, {d: string}]}", "decimal[10, 2]", "{t: var * {x: int32}}"],
)
def test_types_read_back(text):
    dims, measure = types.parse(text)
    assert " * ".join([*map(str, dims), str(measure)]) == text


@pytest.mark.parametrize("text", ["var * {", "nothing", "var * {a int32}", "{a: int32} x"])
def test_bad_types(text):
    with pytest.raises(ValueError):
        types.parse(text)


@pytest.mark.parametrize(
    "a, b, want",
    [("int8", "int64", "int64"), ("int32", "float32", "float64"), ("int16", "float32", "float32"), ("uint8", "int8", "int16"), ("date", "datetime", "datetime"), ("bool", "int32", "int32"), ("null", "string", "?string")],
)
def test_promotion(a, b, want):
    assert str(types.promote(Scalar(a), Scalar(b))) == want


def test_spark_types_round_trip():
    _, measure = types.parse("{a: int8, b: ?float32, c: string, d: date, e: ?datetime, f: timedelta, g: decimal[12, 3], h: bool}")
    assert str(types.from_spark(types.to_spark(measure))) == str(measure)


@pytest.mark.parametrize(
    "e, shape",
    [
        (T.amount + T.id, "var * int64"), (T.amount / 2, "var * float64"), (T.amount // 2, "var * int32"), (T.amount * 1.5, "var * float64"), (T.name == "x", "var * ?bool"), (T.name.like("a*"), "var * ?bool"),
        (T.when - T.when, "var * timedelta"), (T.when.year, "var * int32"), (T.when.second, "var * float64"), (T.when.truncate(3, "days"), "var * date"), (T.when.truncate(minutes=5), "var * datetime"),
        (T.amount.sum(), "int64"), (T.price.sum(), "float64"), (T.amount.mean(), "float64"), (T.ok.any(), "bool"), (T.count(), "int64"), (T.amount.sum(keepdims=True), "1 * int64"), (T.amount.shift(1), "var * ?int32"),
        (T[T.amount > 3][["id"]], "var * {id: int64}"), (m.by(T.name, n=T.id.count()), "var * {name: ?string, n: int64}"), (T.name.str.len(), "var * ?int64"), (m.coalesce(T.name, "x"), "var * string"),
        (T.amount.coerce("float64"), "var * float64"), (m.summary(b=T.id.max(), a=T.id.min()), "{a: int64, b: int64}"), (T[2:5], "var * {name: ?string, amount: int32, id: int64, price: float64, when: datetime, day: date, ok: bool}"),
        (m.join(T[["id", "amount"]], U, "id", how="left"), "var * {id: int64, amount: int32, name: ?string, city: ?string}"), (T.ok & ~T.ok, "var * bool"), (-T.amount, "var * int32"), (m.sqrt(T.amount), "var * float64"),
        (m.ceil(T.price), "var * int64"), (T[0].amount, "int32"), (T.amount.vnorm(), "float64"), (T.amount.count_values(), "var * {amount: int32, count: int64}"),
    ],
)
def test_shapes(e, shape):
    assert e.dshape == shape


@pytest.mark.parametrize(
    "e, name",
    [(T.amount.sum(), "amount_sum"), (T.when.year, "when_year"), (T.when.truncate(days=2), "when"), (T.amount + 1, "amount"), (T.amount + T.id, None), (T.amount * T.amount, "amount"), (T.count(), "count"), (T.id.label("x"), "x"), ((T.id + T.amount).mean(), "mean")],
)
def test_names(e, name):
    assert e._name == name


@pytest.mark.parametrize(
    "build, error",
    [
        (lambda: T.nothing, AttributeError), (lambda: T["nothing"], ValueError), (lambda: T[["id", "nothing"]], ValueError), (lambda: T.amount.str, AttributeError), (lambda: T.name.sum(), TypeError), (lambda: T.name + 1, TypeError),
        (lambda: T.when + T.when, TypeError), (lambda: T.when == "", TypeError), (lambda: T.day == "2000-01-01T10:00:00", TypeError), (lambda: T[T.amount], TypeError), (lambda: T[U.id > 3], ValueError), (lambda: T.amount + U.id, ValueError),
        (lambda: m.merge(T.id, T.id), ValueError), (lambda: m.merge(T.id.max(), T.id.min()), TypeError), (lambda: T.relabel(nothing="x"), ValueError), (lambda: T.drop_field("nothing"), ValueError), (lambda: m.join(T, U, how="semi"), ValueError),
        (lambda: m.join(T, U, "name", "id"), TypeError), (lambda: m.concat(T, U), TypeError), (lambda: T.amount.shift(1.5), TypeError), (lambda: T.sample(), TypeError), (lambda: T.sample(n=0), ValueError), (lambda: T.sample(frac=2), ValueError),
        (lambda: T.sort("nothing"), ValueError), (lambda: T.distinct("nothing"), ValueError), (lambda: T.amount.notnull, None), (lambda: T.amount.notnull(), AttributeError), (lambda: m.by(T.name, T.amount.sum()), ValueError), (lambda: T.name.map(len), TypeError),
        (lambda: T.name.str.cat(T.amount), TypeError), (lambda: T.name * 1.5, TypeError), (lambda: T.when.truncate(3, "fortnights"), ValueError), (lambda: T.when.dt.strftime("%Q"), ValueError), (lambda: bool(T.ok), TypeError), (lambda: ~T.amount, TypeError),
        (lambda: m.transform(T, replace=False, id=T.id + 1), ValueError), (lambda: T.amount.sum(axis=1), ValueError), (lambda: setattr(T, "x", 1), AttributeError),
    ],
)
def test_errors(build, error):
    if error is None:
        build()
        return
    with pytest.raises(error):
        build()


def test_keywords_come_by_name_and_replaced_fields_last():
    assert m.merge(T.id, b=T.amount, a=T.price).fields == ["id", "a", "b"]
    assert m.transform(T[["id", "amount"]], id=T.id + 1).fields == ["amount", "id"]
    assert T.relabel(id="id").isidentical(T)


def test_identity_and_substitution():
    a, b = T[T.amount > 3].id.sum(), T[T.amount > 3].id.sum()
    assert a.isidentical(b) and hash(a) == hash(b) and not a.isidentical(T[T.amount > 4].id.sum())
    other = m.symbol("o", T.dshape)
    assert a.subs({T: other}).leaves()[0].isidentical(other)


@pytest.mark.parametrize(
    "e",
    [
        m.by(T[T.amount > 3][["name"]], x=T[T.amount > 3].id.sum() / 2).sort("x", ascending=False).head(3), m.join(T[["id", "name"]], U, "id", suffixes=("_l", "_r")), T[T.when > "2000-01-01"].amount.shift(2), T.name.str[1:-1].str.upper(),
        T.name.isin(["a", "b"]), T.when.truncate(20, "minutes"), m.concat(T, T).distinct("name"), T[3:9:2], T[[1, 2]], m.atan2(T.amount, 2), m.transform(T, z=m.coalesce(T.name, "none")), m.summary(a=T.id.var(unbiased=True)), T.sort(T.amount + 1),
    ],
)
def test_trees_read_back(e):
    import json

    assert m.from_tree(json.loads(json.dumps(m.to_tree(e)))).isidentical(e)


def test_trees_carry_no_code():
    with pytest.raises(TypeError):
        m.to_tree(T.amount.map(lambda x: x, "int64"))
    for tree in ({"op": "eval", "args": ["1"]}, {"op": "__class__", "args": []}, {"args": []}, {"leaf": "x"}):
        with pytest.raises(ValueError):
            m.from_tree(tree, {})
