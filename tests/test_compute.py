"""Values: Spark against pandas on the same small tables."""
import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

import millrace as m
from millrace.operators.relational import Key, shift, take_rows, with_ordinal

ROWS = [(100, 1, "Alice"), (200, 2, "Bob"), (300, 3, "Charlie"), (-400, 4, "Dan"), (500, 5, "Edith")]
SHAPE = "var * {amount: int64, id: int64, name: string}"
P = pd.DataFrame(ROWS, columns=["amount", "id", "name"])
S = m.symbol("s", SHAPE)


def rows(v):
    if isinstance(v, pd.DataFrame):
        return sorted(map(repr, (tuple(x.item() if hasattr(x, "item") else x for x in r) for r in v.itertuples(index=False, name=None))))
    if isinstance(v, (pd.Series, np.ndarray)):
        return sorted(repr(x.item() if hasattr(x, "item") else x) for x in v)
    return repr(round(float(v), 9)) if isinstance(v, (float, np.floating)) else repr(v.item() if hasattr(v, "item") else v)


CASES = [
    (S.id, P.id), (S[["name", "id"]], P[["name", "id"]]), (S.amount + S.id, P.amount + P.id), (S[S.amount > 100], P[P.amount > 100]), (S.amount.sum(), P.amount.sum()), (S.amount.mean(), P.amount.mean()),
    (S.amount.std(), P.amount.std(ddof=0)), (S.amount.var(unbiased=True), P.amount.var()), (S.amount.nunique(), 5), (S.count(), 5), (S.nrows, 5), ((S.amount > 0).any(), True), ((S.amount > 0).all(), False),
    (S.amount // 3, P.amount // 3), (S.amount % 7, P.amount % 7), (S.amount % -7, P.amount % -7), (S.amount / 4, P.amount / 4), (S.amount * 2 - 1, P.amount * 2 - 1), (-S.amount, -P.amount), (abs(S.amount), P.amount.abs()),
    (S.sort("amount").head(2), P.sort_values("amount").head(2)), (S.sort("amount").tail(2), P.sort_values("amount").tail(2)), (S.sort("amount", ascending=False)[1:3], P.sort_values("amount", ascending=False)[1:3]),
    (S.name.str.len(), P.name.str.len()), (S.name.str.upper(), P.name.str.upper()), (S.name.str[1:3], P.name.str[1:3]), (S.name.str[-2:], P.name.str[-2:]), (S.name.str[::-2], P.name.str[::-2]), (S.name.str.find("i"), P.name.str.find("i")),
    (S.name.like("*i*"), P.name.str.contains("i")), (S.name.str.pad(7, "right", "."), P.name.str.pad(7, "right", ".")), (S.name.str.slice_replace(1, 3, "--"), P.name.str.slice_replace(1, 3, "--")), (S.name.str.replace("l", "L", 1), P.name.str.replace("l", "L", n=1)),
    (m.by(S.amount > 0, total=S.id.sum()).relabel(amount="up"), P.assign(up=P.amount > 0).groupby("up", as_index=False).agg(total=("id", "sum"))), (m.transform(S, z=S.amount * 2), P.assign(z=P.amount * 2)), (S.relabel(id="key"), P.rename(columns={"id": "key"})),
    (S.id.isin([1, 9]), P.id.isin([1, 9])), (S.amount.max() - S.amount.min(), 900), (S.name.count_values().sort("name").head(1), pd.DataFrame({"name": ["Alice"], "count": [1]})), (m.concat(S, S).distinct(), P), (S.name.map(len, "int64"), P.name.map(len)),
    (m.merge(S.id, t=S[["id", "amount"]].map(lambda a, b: a + b, "int64", name="t")), pd.DataFrame({"id": P.id, "t": P.id + P.amount})), (S[S.amount > S.amount.mean()], P[P.amount > P.amount.mean()]), (S.amount - S.amount.mean(), P.amount - P.amount.mean()),
    (m.join(S[["id", "name"]], S[["id", "amount"]], "id"), P[["id", "name"]].merge(P[["id", "amount"]])), (S.amount.truncate(150), P.amount // 150 * 150), (S.name.str.capitalize(), P.name.str.capitalize()), (m.greatest(S.amount, S.id * 60), np.maximum(P.amount, P.id * 60)),
    (S.sort("id")[[0, -1]], P.iloc[[0, -1]]), (S.sort("id")[::2], P[::2]), (S.sort("id")[::-1].head(9), P), (S.sort("id")[-2:], P[-2:]), (S.sort("id").amount.shift(1).coerce("?float64"), P.amount.shift(1)),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_like_pandas(spark, i):
    e, want = CASES[i]
    got = m.compute(e, ROWS, spark=spark)
    if isinstance(want, pd.Series) and want.dtype.kind == "f":
        assert np.allclose(sorted(got.astype(float).fillna(1e99)), sorted(want.fillna(1e99)))
    else:
        assert rows(got) == rows(want)


def test_return_types(spark):
    t = m.data(ROWS, SHAPE, spark=spark)
    assert m.compute(t.amount.sum(), return_type=int) == 700 and isinstance(m.compute(t, return_type="native"), type(spark.range(1)))
    assert m.into(list, t.id.sort()) == [1, 2, 3, 4, 5] and m.into(set, t[["id"]]) == {1, 2, 3, 4, 5}
    assert m.into(dict, t[t.id < 3][["id"]]) == {"id": [1, 2]} and m.into(pd.DataFrame, t).shape == (5, 3) and m.into(np.ndarray, t.id).shape == (5,)
    assert len(t) == 5 and int(t.amount.sum()) == 700 and float(t.amount.mean()) == 140.0 and len(list(t)) == 5 and bool((t.amount > 0).any())
    assert "Alice" in repr(t) and "Alice" in t._repr_html_() and t.peek(2).shape[0] == 3 and repr(S) == "s"
    with pytest.raises(ValueError):
        m.compute(m.join(S, m.symbol("o", SHAPE), "id"), ROWS)
    with pytest.raises(ValueError):
        m.compute(m.data(ROWS, SHAPE, spark=spark).tail(2))  # no order


def test_nulls_and_nan(spark):
    t = m.data([("a", 1.0), (None, float("nan")), ("c", None)], "var * {k: ?string, v: ?float64}", spark=spark)
    assert m.into(list, m.merge(t.k, x=t.v.isnan())) == [("a", False), (None, True), ("c", True)]
    assert m.into(list, t.v.notnull()) == [True, False, False] and m.into(list, t.k.notnull()) == [True, False, True]
    assert m.into(list, m.coalesce(t.k, "z")) == ["a", "z", "c"]
    assert set(m.into(list, m.by(t.k, n=t.nelements()))) == {("a", 1), (None, 1), ("c", 1)}
    assert m.compute(t[["k"]].nunique()) == 3 and m.compute(t.k.count()) == 2
    assert m.compute(t[t.k == "nothing"].v.sum()) is None and m.compute(t[t.k == "nothing"].k.count()) == 0
    ends = m.into(list, m.data([(3,), (None,), (1,)], "var * {x: ?int64}", spark=spark).sort("x", ascending=False))
    assert ends == [3, 1, None]


def test_joins(spark):
    left, right = [(1, "a"), (2, "b"), (None, "n")], [(2, "x"), (3, "y"), (None, "z")]
    a, b = m.symbol("a", "var * {k: ?int64, v: string}"), m.symbol("b", "var * {k: ?int64, v: string}")
    of = lambda how: set(m.compute(m.join(a, b, "k", how=how), {a: left, b: right}, return_type=list, spark=spark))
    assert of("inner") == {(2, "b", "x")}
    assert of("left") == {(1, "a", None), (2, "b", "x"), (None, "n", None)}
    assert of("right") == {(2, "b", "x"), (3, None, "y"), (None, None, "z")}
    assert of("outer") == {(1, "a", None), (2, "b", "x"), (3, None, "y"), (None, "n", None), (None, None, "z")}


def test_truncation(spark):
    t = m.data([(dt.datetime(2000, 1, 1, 12, 10),), (dt.datetime(2000, 6, 25, 12, 35, 12),)], "var * {w: datetime}", spark=spark)
    assert m.into(list, t.w.truncate(20, "minutes")) == [dt.datetime(2000, 1, 1, 12), dt.datetime(2000, 6, 25, 12, 20)]
    assert m.into(list, t.w.truncate(2, "weeks")) == [dt.date(1999, 12, 19), dt.date(2000, 6, 18)]
    assert m.into(list, t.w.truncate(3, "days")) == [dt.date(1999, 12, 31), dt.date(2000, 6, 25)]
    assert m.into(list, t.w.truncate(years=4)) == [dt.date(1998, 1, 1)] * 2


def test_division_like_ieee(spark):
    t = m.data([(1, 0), (-1, 0), (0, 0), (7, 2)], "var * {a: int64, b: int64}", spark=spark)
    got = m.into(list, t.a / t.b)
    assert got[0] == math.inf and got[1] == -math.inf and math.isnan(got[2]) and got[3] == 3.5
    assert m.into(list, t.a // t.b) == [None, None, None, 3] and m.into(list, t.a % t.b) == [None, None, None, 1]
    big = m.data([(2**62 + 1, 2)], "var * {a: int64, b: int64}", spark=spark)
    assert m.into(list, big.a // big.b) == [2**61]


def test_string_questions(spark):
    words = ["", "abc", "ABC", "Abc De", "12", "½", "a1", " \t", "ǅ", "Éa", "a_b", "x y", "٣", "²"]
    t = m.data([(w,) for w in words], "var * {w: string}", spark=spark)
    for q in ("isalnum", "isalpha", "isdecimal", "isdigit", "isnumeric", "isspace", "islower", "isupper", "istitle"):
        assert m.into(list, getattr(t.w.str, q)()) == [getattr(w, q)() for w in words], q
    for a, b, c in ((None, None, -1), (1, None, None), (-2, None, None), (None, -1, None), (0, 9, 2), (3, 1, None), (None, None, 2), (5, 0, -2)):
        assert m.into(list, t.w.str[a:b:c]) == [w[a:b:c] for w in words]
    for glob in ("a*", "?bc", "[aA]bc", "[!a]*", "*_*", "a%", "[", "*"):
        import fnmatch

        assert m.into(list, t.w.like(glob)) == [fnmatch.fnmatchcase(w, glob) for w in words], glob


def test_order_in_ranges(spark):
    """Numbering, shifting and taking rows without one task that holds them all."""
    df = spark.range(3000).selectExpr("id", "pmod(id * 7919, 1000) AS k", "IF(id % 11 = 0, NULL, pmod(id * 31, 97)) AS v")
    for asc in (True, False):
        keys = [Key("v", asc), Key("id")]
        pdf = df.toPandas().sort_values(["v", "id"], ascending=[asc, True], na_position="last").reset_index(drop=True)
        got = with_ordinal(df, keys, "at", one_task=0).toPandas().sort_values("at").reset_index(drop=True)
        assert list(got["at"]) == list(range(3000)) and list(got["id"]) == list(pdf["id"])
        moved = {r.id: r.k for r in shift(df, "k", 3, keys, one_task=0).collect()}
        want = dict(zip(pdf["id"], pdf["k"].shift(3)))
        assert all((moved[i] is None and math.isnan(want[i])) or moved[i] == want[i] for i in moved)
    assert [r.id for r in take_rows(df, [2, 0, -1, 2], [Key("id")]).collect()] == [2, 0, 2999, 2]
    with pytest.raises(IndexError):
        take_rows(df, [3000], [Key("id")])


def test_cache_and_index(spark):
    cached = m.CachedDataset(m.data(ROWS, SHAPE, spark=spark))
    assert cached.compute(lambda t: t.amount.sum()) == 700 and cached.compute(lambda t: t.amount.sum()) == 700 and len(cached.held) == 1
    cached.clear()
    t = m.data(ROWS, SHAPE, spark=spark)
    assert m.create_index(t, "id", unique=True) is t
    with pytest.raises(ValueError):
        m.create_index(t, "nothing")
    with pytest.raises(ValueError):
        m.create_index(m.concat(t, t), "id", unique=True)


def test_foreign_key(spark):
    p = m.data([(1, "red", 2.5), (2, "blue", 3.0)], "var * {product_id: int64, color: string, price: float64}", spark=spark)
    o = m.link(m.data([(1, 1, 5), (2, 2, 1), (3, 9, 1)], "var * {order_id: int64, product_id: int64, quantity: int64}", spark=spark), "product_id", p)
    assert set(m.into(list, m.merge(o.order_id, c=o.product_id.color))) == {(1, "red"), (2, "blue")}
    assert m.compute((o.product_id.price * o.quantity).sum()) == 15.5 and m.compute(o.quantity.sum()) == 7
    assert set(m.into(list, m.by(o.product_id.color, q=o.quantity.sum()))) == {("red", 5), ("blue", 1)}


def test_plans_are_pushed_down(spark):
    t = m.data(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet"), spark=spark)
    s = t[t.l_quantity > 40]
    plan = m.frame(m.by(s.l_returnflag, n=s.l_orderkey.count()))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan and "l_comment" not in plan and "l_tax" not in plan and plan.count("Exchange") == 1
    top = m.frame(t.sort("l_quantity").head(3))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in top
