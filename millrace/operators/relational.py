"""Relational operators on DataFrames that need more than one built-in call."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Up to so many rows are put in order in one task; more are ordered in ranges.
ONE_TASK = 200_000
#: Rows of a range of a distributed order, the most ranges, and sampled rows for each.
RANGE_ROWS, MOST_RANGES, SAMPLES = 250_000, 1024, 30
#: The most ranges of a table that is put in order as files.
MOST_SETTLED = 50_000
#: Rows of a block in which values are shifted.
SHIFT_ROWS = 100_000
#: A key with more pairs than the square of CELL_SIDE, and at least so many rows on both sides, is joined in cells of that square.
CELL_SIDE, CELL_LEAST = 3_000, 16
#: Buckets by which such keys are looked for, and the most partitions that cells are dealt to.
KEY_BUCKETS, MOST_CELL_TASKS = 65_536, 10_000


class Key:
    """A sort key: a column and its direction; nulls come last in either."""

    def __init__(self, column: Column | str, ascending: bool = True):
        self.name = column if isinstance(column, str) else None
        self.column = F.col(f"`{column}`") if isinstance(column, str) else column
        self.ascending = ascending

    @property
    def sort(self) -> Column:
        return self.column.asc_nulls_last() if self.ascending else self.column.desc_nulls_last()

    @property
    def reverse(self) -> Column:
        return self.column.desc_nulls_first() if self.ascending else self.column.asc_nulls_first()


def join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], how: str, left_rest: Sequence[tuple[str, str]], right_rest: Sequence[tuple[str, str]], types: dict | None = None) -> DataFrame:
    """Equi-join with the output spelled out: the keys by the left's names, then the rest under new names.

    Null keys match nothing.  The key comes from the side that is preserved, or both.  Keys with
    many rows on both sides, whose pairs outgrow their rows, are joined in cells, see :func:`_in_cells`.
    """
    types = types or {}
    l = left.select([F.col(n).alias(f"l{i}") for i, (n, _) in enumerate(on)] + [F.col(n).alias(f"lr{i}") for i, (n, _) in enumerate(left_rest)])
    r = right.select([F.col(n).alias(f"r{i}") for i, (_, n) in enumerate(on)] + [F.col(n).alias(f"rr{i}") for i, (n, _) in enumerate(right_rest)])
    cond = [F.col(f"l{i}") == F.col(f"r{i}") for i in range(len(on))]
    kind = {"outer": "full_outer"}.get(how, how)
    crowded = _crowded_keys(l, r, len(on))
    both = l.join(r, cond, kind) if crowded is None else _in_cells(l, r, cond, kind, *crowded)

    def key(i: int, name: str) -> Column:
        c = {"right": F.col(f"r{i}"), "outer": F.coalesce(f"l{i}", f"r{i}")}.get(how, F.col(f"l{i}"))
        return (c.cast(types[name]) if name in types else c).alias(name)

    return both.select(
        [key(i, n) for i, (n, _) in enumerate(on)]
        + [F.col(f"lr{i}").alias(n) for i, (_, n) in enumerate(left_rest)]
        + [F.col(f"rr{i}").alias(n) for i, (_, n) in enumerate(right_rest)]
    )


#: Types of keys that compare alike on the driver's way to the executors.
_PLAIN = (T.IntegralType, T.FractionalType, T.BooleanType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _crowded_keys(l: DataFrame, r: DataFrame, n: int) -> tuple[DataFrame, int] | None:
    """The keys whose pairs need more than one cell, with the parts each side is cut into and the number of their first cell; and how many cells there are.

    Rows are counted by a hash of the key first, which leaves nothing more to do in nearly all
    joins; only where a bucket is crowded are keys themselves counted there.  The keys that come
    of it are at most one for every CELL_SIDE rows.
    """
    spark, kinds = l.sparkSession, [(l.schema[f"l{i}"].dataType, r.schema[f"r{i}"].dataType) for i in range(n)]
    if l.isStreaming or r.isStreaming or not n:
        return None
    for a, b in kinds:
        if not (isinstance(a, _PLAIN) and (a == b or isinstance(a, T.IntegralType) and isinstance(b, T.IntegralType))) or isinstance(a, T.StringType) and a.simpleString() != "string":
            return None
    names = [f"h{i}" for i in range(n)]
    bucket = F.pmod(F.xxhash64(*names), F.lit(KEY_BUCKETS))

    def keys(df: DataFrame, side: str) -> DataFrame:
        there = df.filter(" AND ".join(f"{side}{i} IS NOT NULL" for i in range(n)))
        return there.select(*[F.col(f"{side}{i}").cast("long" if a != b else a).alias(names[i]) for i, (a, b) in enumerate(kinds)])

    def crowds(x: DataFrame, y: DataFrame, by: Sequence) -> DataFrame:
        count = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
        both = count(x, "__l").join(count(y, "__r"), [b if isinstance(b, str) else "__bucket" for b in by])
        return both.filter((F.least("__l", "__r") >= CELL_LEAST) & (F.col("__l").cast("double") * F.col("__r") > CELL_SIDE**2))

    x, y = keys(l, "l"), keys(r, "r")
    full = [row[0] for row in crowds(x, y, [bucket.alias("__bucket")]).select("__bucket").collect()]
    if not full:
        return None
    if len(full) <= 1_000:
        x, y = (df.filter(bucket.isin(full)) for df in (x, y))
    found = crowds(x, y, names).toArrow()
    if not found.num_rows:
        return None
    parts = [_parts(*k) for k in zip(found["__l"].to_pylist(), found["__r"].to_pylist(), strict=True)]
    firsts = [0, *itertools.accumulate(a * b for a, b in parts)]
    out = found.select(names)
    for name, values in (("__a", [a for a, _ in parts]), ("__b", [b for _, b in parts]), ("__first", firsts[:-1])):
        out = out.append_column(name, pa.array(values, pa.int64()))
    return spark.createDataFrame(out), firsts[-1]


def _parts(left: int, right: int) -> tuple[int, int]:
    """How many parts the rows of a key are cut into on either side, so that a cell has about CELL_SIDE squared pairs."""
    if min(left, right) > CELL_SIDE:
        return -(-left // CELL_SIDE), -(-right // CELL_SIDE)
    cut = -(-left * right // CELL_SIDE**2)
    return (cut, 1) if left > right else (1, cut)


def _in_cells(l: DataFrame, r: DataFrame, cond: Sequence[Column], kind: str, crowded: DataFrame, cells: int) -> DataFrame:
    """A join in which no task makes all pairs of a crowded key.

    Of such a key the left's rows are dealt to parts, and so are the right's; each part of one
    side meets each of the other in a cell of its own, and cells are dealt to tasks.  These keys
    are there on both sides, so all their rows match, whatever the kind of the join.  All other
    rows, those without a match among them, are joined as ever.
    """
    mine = lambda side: [F.col(f"{side}{i}") == F.col(f"h{i}") for i in range(len(cond))]
    held = F.broadcast(crowded)
    rest = l.join(held, mine("l"), "left_anti").join(r.join(held, mine("r"), "left_anti"), cond, kind)

    def dealt(df: DataFrame, side: str, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit((1 << 31) - 1))
        kept = df.withColumn("__part", part).join(held, mine(side)).withColumn("__part", F.col("__part") % F.col(own))
        kept = kept.withColumn("__other", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        i, j = ("__part", "__other") if side == "l" else ("__other", "__part")
        cell = F.col("__first") + F.col(i) * F.col("__b") + F.col(j)
        return kept.select(*df.columns, cell.alias(f"__cell_{side}")).repartition(min(cells, MOST_CELL_TASKS), f"__cell_{side}")

    x, y = dealt(l, "l", "__a", "__b"), dealt(r, "r", "__b", "__a")
    met = x.join(y.hint("merge"), F.col("__cell_l") == F.col("__cell_r"))
    return rest.unionByName(met.select(*l.columns, *r.columns))


def first_of_each(df: DataFrame, on: Sequence[str], order: Sequence[Key]) -> DataFrame:
    """The first row, by an order, of each value of the fields ``on``; without an order the least row.

    Where all keys have one direction, the first row of a group is an aggregate, so a group of
    any size costs one row a task; nulls are marked so that they come last.
    """
    names = df.columns
    if not order or len({k.ascending for k in order}) == 1:
        up = not order or order[0].ascending
        rank = [F.struct(k.column.isNull() if up else k.column.isNotNull(), k.column) for k in order] or [F.struct(*names)]
        held = df.select(F.struct(*[r.alias(f"o{i}") for i, r in enumerate(rank)]).alias("o"), F.struct(*names).alias("row"), *[F.col(n).alias(f"k{i}") for i, n in enumerate(on)])
        best = held.groupBy(*[f"k{i}" for i in range(len(on))]).agg((F.min_by if up else F.max_by)("row", "o").alias("row"))
        return best.select("row.*")
    w = Window.partitionBy(*on).orderBy(*[k.sort for k in order])
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def _at_or_after(order: Sequence[Key], values: Sequence) -> Column:
    """Whether a row stands at or after the given key values."""
    out = F.lit(True)
    for k, v in reversed(list(zip(order, values, strict=True))):
        if v is None:
            out = k.column.isNull() & out
            continue
        beyond = (k.column > F.lit(v)) if k.ascending else (k.column < F.lit(v))
        out = F.coalesce(beyond, F.lit(False)) | k.column.isNull() | (k.column.eqNullSafe(F.lit(v)) & out)
    return out


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A hash of the whole row (but for maps, which have none)."""
    return F.xxhash64(F.lit(seed), *[F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))])


def with_ordinal(df: DataFrame, order: Sequence[Key], name: str = "ordinal", one_task: int = ONE_TASK) -> DataFrame:
    """Rows numbered from 0 in an order; rows that tie in it come by a hash of the whole row.

    A small table (its rows are counted) is numbered in one task.  Otherwise a bounded sample
    gives splitters of the order, as many as the rows ask for; rows are numbered within ranges,
    and the counts of the ranges, one row for each, are added up.  A row finds its range by
    halving, and no task holds more than a range.  A table that asks for more than
    ``MOST_RANGES`` of them is settled in order instead, see :func:`_settled_order`.
    """
    rows = df.count()
    order = [*order, Key(row_hash(df))]
    if rows <= one_task:
        return df.withColumn(name, (F.row_number().over(Window.orderBy(*[k.sort for k in order])) - 1).cast("long"))
    if rows // RANGE_ROWS > MOST_RANGES:
        return _settled_order(df, order, min(MOST_SETTLED, rows // RANGE_ROWS), name)
    ranges = max(8, rows // RANGE_ROWS)
    probe = df.select(*[k.column.alias(f"k{i}") for i, k in enumerate(order)])
    ranked = [Key(f"k{i}", k.ascending).sort for i, k in enumerate(order)]
    seen = probe.sample(min(1.0, ranges * SAMPLES / rows), seed=7).limit(4 * ranges * SAMPLES).orderBy(*ranked).collect()
    cuts = list(dict.fromkeys(tuple(seen[i * len(seen) // ranges]) for i in range(1, ranges))) if seen else []

    def place_of(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(_at_or_after(order, cuts[middle]), place_of(middle + 1, hi)).otherwise(place_of(lo, middle))

    ranged = df.withColumn("__range", place_of(0, len(cuts)))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*[k.sort for k in order])) - 1
    return _added_up(ranged, ranged.withColumn("__place", place), name)


def _added_up(ranged: DataFrame, placed: DataFrame, name: str) -> DataFrame:
    """Places within ranges, plus the rows of all ranges before, which are at most MOST_SETTLED sums."""
    counts = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.join(F.broadcast(counts.select("__range", before.alias("__before"))), "__range")
    return numbered.withColumn(name, (F.col("__before") + F.col("__place")).cast("long")).drop("__range", "__place", "__before")


def _settled_order(df: DataFrame, order: Sequence[Key], ranges: int, name: str) -> DataFrame:
    """Rows numbered by one range partitioning, written in order to the shared folder.

    Spark samples the ranges anew whenever a plan runs, so rows and counts of ranges are only
    certain to fit together once they are written; a lost executor then costs its files' rereading.
    The files go when the application ends.
    """
    from ..sources.resources import shared_folder

    spark = df.sparkSession
    sorts = [k.sort for k in order]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    held = df.repartitionByRange(ranges, *sorts).withColumn("__range", F.spark_partition_id()).sortWithinPartitions(*sorts).withColumn("__place", place)
    path = f"{shared_folder(spark)}/order-{uuid.uuid4().hex}"
    held.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    settled = spark.read.parquet(path)
    return _added_up(settled, settled, name)


def tail(df: DataFrame, n: int, order: Sequence[Key]) -> DataFrame:
    """The last ``n`` rows, in order: the first of the reversed order, put back."""
    return df.orderBy(*[k.reverse for k in order]).limit(n).orderBy(*[k.sort for k in order])


def slice_rows(df: DataFrame, start: int | None, stop: int | None, step: int | None, order: Sequence[Key]) -> DataFrame:
    """Python's ``rows[start:stop:step]`` in an order."""
    if (step or 1) == 1 and not start and stop is None:
        return df.orderBy(*[k.sort for k in order])
    if (step or 1) == 1 and (start or 0) >= 0 and stop is not None and 0 <= stop <= ONE_TASK:
        out = df.orderBy(*[k.sort for k in order]).limit(stop)  # a top-k
        return out.offset(start) if start else out
    lo, hi, by = slice(start, stop, step).indices(df.count())
    at = F.col("__at")
    numbered = with_ordinal(df, order, "__at")
    inside = (at >= lo) & (at < hi) & ((at - lo) % by == 0) if by > 0 else (at <= lo) & (at > hi) & ((F.lit(lo) - at) % -by == 0)
    return numbered.filter(inside).orderBy(at.asc() if by > 0 else at.desc()).drop("__at")


def take_rows(df: DataFrame, places: Sequence[int], order: Sequence[Key]) -> DataFrame:
    """The rows at some places, in the order these are given; negative ones count from the end."""
    n = df.count()
    wanted = [p + n if p < 0 else p for p in places]
    if any(not 0 <= p < n for p in wanted):
        raise IndexError(f"there are {n} rows")
    spark = df.sparkSession
    asked = spark.createDataFrame(list(enumerate(wanted)), "__out int, __at long")
    return with_ordinal(df, order, "__at").join(F.broadcast(asked), "__at").orderBy("__out").drop("__at", "__out")


def sample(df: DataFrame, n: int | None, frac: float | None, seed: int, one_task: int = ONE_TASK) -> DataFrame:
    """Exactly ``n`` rows, or the share ``frac`` of them rounded half up, without replacement.

    The rows come first in the order of a seeded hash of the whole row: a few by a top-k, many
    by their numbers in that order, which no single task works out.
    """
    if n is None:
        n = int(frac * df.count() + 0.5)
    chance = row_hash(df, seed + 1)
    if n <= one_task:
        return df.orderBy(chance, F.rand(seed)).limit(n)
    return with_ordinal(df, [Key(chance)], "__at", one_task).filter(F.col("__at") < n).drop("__at")


def shifts(df: DataFrame, moved: Sequence[tuple[str, Column, int]], order: Sequence[Key], one_task: int = ONE_TASK, block: int = SHIFT_ROWS) -> DataFrame:
    """``df`` with columns ``(name, column, n)`` beside it: the column's value ``n`` rows before in an order.

    Beyond ``one_task`` rows they are numbered in ranges and cut into blocks by their numbers;
    the rows at the edge of a block also go to its neighbour, so that no task needs more than
    a block and nothing is joined.
    """
    if df.count() <= one_task:
        w = Window.orderBy(*[k.sort for k in order], row_hash(df).asc())
        return df.select("*", *[F.lag(c, n).over(w).alias(name) for name, c, n in moved])
    back, ahead = max(0, *[n for _, _, n in moved]), max(0, *[-n for _, _, n in moved])
    size = max(block, back, ahead)
    held = with_ordinal(df.select("*", *[c.alias(name) for name, c, _ in moved]), order, "__at", one_task)
    inside = F.pmod("__at", F.lit(size))
    to = F.array_compact(F.array(F.lit(0), F.when(inside >= size - back, 1), F.when(inside < ahead, -1)))
    dealt = held.select("*", F.explode(to).alias("__to")).withColumn("__block", F.floor(F.col("__at") / size) + F.col("__to"))
    w = Window.partitionBy("__block").orderBy("__at")
    kept = [F.col(f"`{n}`") for n in df.columns]
    out = dealt.select(*kept, "__to", *[F.lag(name, n).over(w).alias(name) for name, _, n in moved])
    return out.filter("__to = 0").drop("__to")


def shift(df: DataFrame, column: str, n: int, order: Sequence[Key], one_task: int = ONE_TASK, block: int = SHIFT_ROWS) -> DataFrame:
    """``df`` with ``column`` replaced by its value ``n`` rows before in an order."""
    out = shifts(df, [("__moved", F.col(f"`{column}`"), n)], order, one_task, block)
    return out.select(*[F.col("__moved").alias(c) if c == column else F.col(f"`{c}`") for c in df.columns])
