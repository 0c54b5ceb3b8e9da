"""Expressions on streams, and windowed reductions with a watermark.

Selections, projections and ``by`` lower to streaming plans as they are.  What needs all rows
in order is refused before anything starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.expr import Expr
from ..plans.lower import Lowering

#: Operations that need the whole table.
WHOLE = {"sort", "tail", "slice", "shift", "sample", "head", "apply"}


def stream_frame(e: Expr, leaf: Expr, stream: DataFrame) -> DataFrame:
    """The streaming DataFrame of an expression over one streaming leaf."""
    if not stream.isStreaming:
        raise ValueError("the data is no stream")
    for t in e.subterms():
        if t.op in WHOLE or (t.op == "distinct" and t.args[1]):
            raise ValueError(f"{t.op} needs all rows, which a stream does not have")
    return Lowering(stream.sparkSession, [(leaf, stream)]).frame(e)


def windowed(stream: DataFrame, time: str, size: str, keys=(), late: str = "0 seconds", slide: str | None = None, **aggregates) -> DataFrame:
    """Reductions in tumbling (or sliding) windows of event time: ``window_start, window_end``, the keys, the aggregates.

    Rows later than ``late`` behind the newest are left out, and state is kept no longer.
    ``aggregates`` are aggregate Columns by name.
    """
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(*[c.alias(n) for n, c in sorted(aggregates.items())])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *sorted(aggregates))


def sessions(stream: DataFrame, time: str, gap: str, keys=(), late: str = "0 seconds", **aggregates) -> DataFrame:
    """Reductions in sessions that end after ``gap`` without a row of the key."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*[c.alias(n) for n, c in sorted(aggregates.items())])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *sorted(aggregates))
