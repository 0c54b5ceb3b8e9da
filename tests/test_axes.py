"""Arrays as expressions, against NumPy."""
import itertools

import numpy as np
import pytest

import millrace as m

RNG = np.random.default_rng(3)
A2, A3 = RNG.integers(-9, 9, (5, 4)), RNG.normal(size=(3, 4, 2))
OF = {"sum": np.sum, "min": np.min, "max": np.max, "mean": np.mean, "var": np.var, "std": np.std}


def value(e):
    out = m.compute(e)
    return np.array(out.tolist() if hasattr(out, "tolist") else out, float)


@pytest.mark.parametrize("a", [A2, A3], ids=["2", "3"])
def test_reductions_over_axes(spark, a):
    x = m.data(a, spark=spark)
    assert x.shape == a.shape and np.allclose(value(x), a)
    for n in range(1, a.ndim + 1):
        for axes in itertools.combinations(range(a.ndim), n):
            for op, f in OF.items():
                e = getattr(x, op)(axis=axes)
                assert e.ndim == a.ndim - n
                assert np.allclose(value(e), f(a, axis=axes)), (op, axes)
    assert np.allclose(value(x.vnorm(axis=a.ndim - 1)), np.linalg.norm(a, axis=a.ndim - 1))
    assert np.allclose(value(x.sum(axis=-1, keepdims=True)), a.sum(-1, keepdims=True)) and np.allclose(value(x.max(axis=0, keepdims=True)), a.max(0, keepdims=True))
    assert np.allclose(value(x.mean(keepdims=True)), a.mean(keepdims=True)) and m.compute(x.nelements()) == a.size and value(x.count(axis=0)).sum() == a.size
    assert abs(m.compute(x.max() - x.min()) - np.ptp(a)) < 1e-12
    with pytest.raises(ValueError):
        x.sum(axis=a.ndim)


def test_array_columns_beside_others(spark):
    df = spark.createDataFrame([(1, [1, None, 3]), (2, []), (3, None), (4, [7, 7])], "k long, v array<long>")
    t = m.data(df, spark=spark)
    v = t.v  # fields of a merge come by name: e, mean, n, s, sd, u
    out = m.into(list, m.merge(t.k, e=v.nelements(axis=1), mean=v.mean(axis=1), n=v.count(axis=1), s=v.sum(axis=1), sd=v.std(axis=1, unbiased=True), u=v.nunique(axis=1)))
    assert [r[:-2] + r[-1:] for r in out] == [(1, 3, 2.0, 2, 4, 2), (2, 0, None, 0, None, 0), (3, 0, None, 0, None, 0), (4, 2, 7.0, 2, 14, 1)]
    assert [r[-2] for r in out[1:]] == [None, None, 0.0] and abs(out[0][-2] - 2**0.5) < 1e-12
    assert sorted(m.into(list, t[t.v.sum(axis=1) > 5].k)) == [4] and m.compute(t.v.sum(axis=1).sum()) == 18 and m.compute(t.v.sum()) == 18
    got = m.into(list, m.summary(axis=1, lo=t.v.min(), hi=t.v.max()))
    assert got == [(3, 1), (None, None), (None, None), (7, 7)]  # hi, lo
    leaf = m.symbol("t", t.dshape)
    for e in (leaf.v.sum(axis=1), leaf.v.max(axis=0), leaf.v.mean()):
        back = m.from_tree(m.to_tree(e, {leaf: "t"}), {"t": leaf})
        assert back.isidentical(e)


def test_more_sources(spark):
    rows = [(1, "a"), (2, "b")]
    assert m.into(list, m.data(rows, schema="{k: int64, s: string}", spark=spark)) == rows
    assert m.into(list, m.data(spark.sparkContext.parallelize(rows), "var * {k: int64, s: string}", spark=spark)) == rows
    assert m.into(list, m.data(A2, fields=["a", "b", "c", "d"], spark=spark).b) == A2[:, 1].tolist()
    with pytest.raises(TypeError):
        m.data(rows, "var * {k: int64, s: string}", schema="{k: int64, s: string}", spark=spark)
