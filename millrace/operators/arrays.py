"""N-dimensional arrays in long form: a row for each element, an index column for each axis.

Index columns are ``i0``, ``i1``, ... and the element is ``v``.  Elements that are not there
count as absent, so sparse arrays cost what they hold.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reductions import aggregate

#: A contraction whose smaller side is known to hold at most so many elements is broadcast.
BROADCAST_ELEMENTS = 200_000


class LongArray:
    """An array: its rows and its shape."""

    def __init__(self, rows: DataFrame, shape: Sequence[int]):
        self.shape = tuple(int(n) for n in shape)
        self.rows = rows.select(*[F.col(c) for c in self.axes], "v")

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def axes(self) -> list[str]:
        return [f"i{k}" for k in range(len(self.shape))]

    @classmethod
    def of(cls, spark: SparkSession, values) -> LongArray:
        """From nested lists or a NumPy array."""
        import numpy as np

        a = np.asarray(values)
        kind = "double" if a.dtype.kind == "f" else "boolean" if a.dtype.kind == "b" else "long"
        rows = [(*map(int, i), a[i].item()) for i in product(*map(range, a.shape))]
        return cls(spark.createDataFrame(rows, ", ".join([*(f"i{k} int" for k in range(a.ndim)), f"v {kind}"])), a.shape)

    @classmethod
    def from_table(cls, df: DataFrame, indices: Sequence[str], value: str, shape: Sequence[int]) -> LongArray:
        """From the columns of a table."""
        return cls(df.select(*[F.col(c).alias(f"i{k}") for k, c in enumerate(indices)], F.col(value).alias("v")), shape)

    def _axis(self, axis: int) -> int:
        if not -self.ndim <= axis < self.ndim:
            raise ValueError(f"no axis {axis}")
        return axis % self.ndim

    def transpose(self, axes: Sequence[int] | None = None) -> LongArray:
        """Axes in another order, reversed unless told."""
        order = [self._axis(a) for a in (range(self.ndim - 1, -1, -1) if axes is None else axes)]
        if sorted(order) != list(range(self.ndim)):
            raise ValueError("every axis is needed once")
        return LongArray(self.rows.select(*[F.col(f"i{a}").alias(f"i{k}") for k, a in enumerate(order)], "v"), [self.shape[a] for a in order])

    T = property(transpose)

    def tensordot(self, other: LongArray, axes: int | tuple = 2) -> LongArray:
        """Sum of products over paired axes: the last of this with the first of the other if a number is given."""
        if isinstance(axes, int):
            mine, theirs = list(range(self.ndim - axes, self.ndim)), list(range(axes))
        else:
            mine, theirs = ([a] if isinstance(a, int) else list(a) for a in axes)
            mine, theirs = [self._axis(a) for a in mine], [other._axis(a) for a in theirs]
        if len(mine) != len(theirs) or any(self.shape[a] != other.shape[b] for a, b in zip(mine, theirs, strict=True)):
            raise ValueError("the contracted axes differ in size")
        free_a = [a for a in range(self.ndim) if a not in mine]
        free_b = [b for b in range(other.ndim) if b not in theirs]
        left = self.rows.select(*[F.col(f"i{a}").alias(f"l{k}") for k, a in enumerate(free_a)], *[F.col(f"i{a}").alias(f"c{k}") for k, a in enumerate(mine)], F.col("v").alias("x"))
        right = other.rows.select(*[F.col(f"i{b}").alias(f"r{k}") for k, b in enumerate(free_b)], *[F.col(f"i{b}").alias(f"c{k}") for k, b in enumerate(theirs)], F.col("v").alias("y"))
        size = 1
        for n in other.shape:
            size *= n
        right = F.broadcast(right) if size <= BROADCAST_ELEMENTS else right
        keys = [f"c{k}" for k in range(len(mine))]
        both = left.join(right, keys) if keys else left.crossJoin(right)  # an outer product has every pair of elements
        names = [f"l{k}" for k in range(len(free_a))] + [f"r{k}" for k in range(len(free_b))]
        out = both.groupBy(*names).agg(F.sum(F.col("x") * F.col("y")).alias("v"))
        return LongArray(out.select(*[F.col(n).alias(f"i{k}") for k, n in enumerate(names)], "v"), [*(self.shape[a] for a in free_a), *(other.shape[b] for b in free_b)])

    def dot(self, other: LongArray) -> LongArray:
        """The last axis of this with the first, or the last but one, of the other."""
        return self.tensordot(other, ([self.ndim - 1], [max(0, other.ndim - 2)]))

    def reduce(self, op: str, axis: int | Sequence[int] | None = None, keepdims: bool = False, **options) -> LongArray:
        """A reduction over some axes, or all."""
        gone = sorted({self._axis(a) for a in (range(self.ndim) if axis is None else [axis] if isinstance(axis, int) else axis)})
        kept = [a for a in range(self.ndim) if a not in gone]
        agg = aggregate(op, F.col("v"), **options).alias("v")
        rows = self.rows.groupBy(*[f"i{a}" for a in kept]).agg(agg)
        if keepdims:
            return LongArray(rows.select(*[F.lit(0).alias(f"i{a}") if a in gone else F.col(f"i{a}") for a in range(self.ndim)], "v"), [1 if a in gone else n for a, n in enumerate(self.shape)])
        return LongArray(rows.select(*[F.col(f"i{a}").alias(f"i{k}") for k, a in enumerate(kept)], "v"), [self.shape[a] for a in kept])

    def combine(self, other: LongArray, f) -> LongArray:
        """Element by element, axes of size 1 stretched to the other's, as many axes as the larger has."""
        n = max(self.ndim, other.ndim)
        a, b = self._stretched(n), other._stretched(n)
        if any(x != y and 1 not in (x, y) for x, y in zip(a.shape, b.shape, strict=True)):
            raise ValueError(f"shapes {self.shape} and {other.shape} do not go together")
        on = [k for k in range(n) if a.shape[k] == b.shape[k] != 1]
        left = a.rows.select(*[F.col(f"i{k}").alias(f"l{k}") for k in range(n)], F.col("v").alias("x"))
        right = b.rows.select(*[F.col(f"i{k}").alias(f"r{k}") for k in range(n)], F.col("v").alias("y"))
        if on:
            both = left.join(right, [F.col(f"l{k}") == F.col(f"r{k}") for k in on])
        else:
            both = left.crossJoin(right)  # stretched along every axis: every pair is an element of the result
        index = [F.col(f"l{k}" if a.shape[k] >= b.shape[k] else f"r{k}").alias(f"i{k}") for k in range(n)]
        return LongArray(both.select(*index, f(F.col("x"), F.col("y")).alias("v")), [max(x, y) for x, y in zip(a.shape, b.shape, strict=True)])

    def _stretched(self, n: int) -> LongArray:
        more = n - self.ndim
        return LongArray(self.rows.select(*[F.lit(0).alias(f"i{k}") for k in range(more)], *[F.col(c).alias(f"i{k + more}") for k, c in enumerate(self.axes)], "v"), [1] * more + list(self.shape)) if more else self

    def map(self, f) -> LongArray:
        """A Column function of every element."""
        return LongArray(self.rows.withColumn("v", f(F.col("v"))), self.shape)

    def __getitem__(self, key) -> LongArray:
        """Numbers drop an axis; slices and lists keep it, renumbered."""
        key = key if isinstance(key, tuple) else (key,)
        key = key + (slice(None),) * (self.ndim - len(key))
        if len(key) > self.ndim:
            raise IndexError("more places than axes")
        rows, out, shape = self.rows, [], []
        for a, (k, n) in enumerate(zip(key, self.shape, strict=True)):
            c = F.col(f"i{a}")
            if isinstance(k, int):
                if not -n <= k < n:
                    raise IndexError(f"axis {a} has {n} places")
                rows = rows.filter(c == k % n)
                continue
            if isinstance(k, slice):
                lo, hi, step = k.indices(n)
                size = len(range(lo, hi, step))
                inside = (c >= lo) & (c < hi) & ((c - lo) % step == 0) if step > 0 else (c <= lo) & (c > hi) & ((F.lit(lo) - c) % -step == 0)
                rows = rows.filter(inside)
                out.append(((c - lo) / step).cast("int"))
            else:
                places = [x % n for x in k]
                size = len(places)
                rows = rows.filter(c.isin(sorted(set(places))))
                new = F.array(*[F.when(c == x, F.lit(j)) for j, x in enumerate(places)])
                rows = rows.withColumn(f"p{a}", F.explode(F.array_compact(new)))
                out.append(F.col(f"p{a}"))
            shape.append(size)
        return LongArray(rows.select(*[c.alias(f"i{j}") for j, c in enumerate(out)], "v"), shape)

    def concat(self, other: LongArray, axis: int = 0) -> LongArray:
        """One after the other along an axis."""
        axis = self._axis(axis)
        if self.ndim != other.ndim or any(x != y for k, (x, y) in enumerate(zip(self.shape, other.shape, strict=True)) if k != axis):
            raise ValueError(f"shapes {self.shape} and {other.shape} do not go together")
        moved = other.rows.withColumn(f"i{axis}", F.col(f"i{axis}") + self.shape[axis])
        return LongArray(self.rows.unionByName(moved), [x + y if k == axis else x for k, (x, y) in enumerate(zip(self.shape, other.shape, strict=True))])

    def nelements(self, axis: int | Sequence[int] | None = None) -> int:
        out = 1
        for a in range(self.ndim) if axis is None else [axis] if isinstance(axis, int) else axis:
            out *= self.shape[self._axis(a)]
        return out

    def to_numpy(self):
        """The whole array on the driver, absent elements 0."""
        import numpy as np

        got = self.rows.toPandas()
        out = np.zeros(self.shape, got["v"].dtype if len(got) else float)
        out[tuple(got[c] for c in self.axes)] = got["v"]
        return out
