"""Sharding by sampled splitters, under the law ``bytes``: shards of nearly equal size.

Records are ordered by a key, the hash of their text, so that equal texts stand together.  A
size-weighted sample of keys gives quantile boundaries, which cut the order into many more
ranges than shards; ranges that prove overfull when all records are measured are subdivided
by key.  A range of one key (a group of copies) stays whole while it fits a shard, and is
subdivided by record beyond that.  Whole groups that fill more than a range are placed first,
the largest on the emptiest shard; the other parts then fill the shards up in order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .runtime import settle

#: Ranges: at least PER_SHARD for a shard, about RANGE_ROWS rows each, never more than MOST_RANGES.
PER_SHARD, RANGE_ROWS, MOST_RANGES, SAMPLES_PER_RANGE = 64, 50_000, 200_000, 8


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, key``: what sharding needs to know of a record."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )


def splitters(measured: DataFrame, total: int, ranges: int) -> np.ndarray:
    """Ascending boundaries from a size-weighted sample; range i holds keys in [b[i-1], b[i]).

    A record enters the sample with a probability in proportion to its size (by a hash of it,
    so that a rerun draws the same); the sample has about ``SAMPLES_PER_RANGE * ranges`` keys.
    A key that spans several quantiles gets a range of its own.
    """
    wanted = SAMPLES_PER_RANGE * ranges
    u = (F.pmod(F.xxhash64("doc_id", "key", F.lit(11)), F.lit(1 << 31)) + 0.5) / float(1 << 31)
    chance = F.col("size") * F.lit(wanted / max(1, total))
    got = measured.filter(u < chance).select("key", F.greatest(chance, F.lit(1.0)).alias("w")).groupBy("key").agg(F.sum("w").alias("w")).toPandas()
    if not len(got):
        return np.zeros(0, np.int64)
    got = got.sort_values("key")
    keys, before = got.key.to_numpy(np.int64), np.cumsum(got.w.to_numpy())
    step = before[-1] / ranges
    at = np.unique(np.searchsorted(before, step * np.arange(1, ranges), "right"))
    cuts = keys[at[at < len(keys)]]
    hot = keys[(got.w.to_numpy() >= step) & (keys < np.iinfo(np.int64).max)]
    return np.unique(np.concatenate([cuts, hot, hot + 1]))


def deal_out(sizes: np.ndarray, shards: int, large: float) -> np.ndarray:
    """The shard of each part: those over ``large`` first, the largest on the emptiest shard, then the rest in order up to what each shard has left."""
    out, fill = np.zeros(len(sizes), np.int64), np.zeros(shards)
    for i in sorted(np.flatnonzero(sizes > large).tolist(), key=lambda i: (-sizes[i], i)):
        out[i] = fill.argmin()
        fill[out[i]] += sizes[i]
    rest = np.flatnonzero(sizes <= large)
    room = np.maximum(0, max(fill.max(), sizes.sum() / shards) - fill)
    room *= sizes[rest].sum() / max(1.0, room.sum())
    middle = np.cumsum(sizes[rest]) - sizes[rest] / 2
    out[rest] = np.minimum(np.searchsorted(np.cumsum(room), middle, "right"), shards - 1)
    return out


def assign_shards(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Sizes are UTF-8 bytes plus 8 (a null text has none).  Equal texts share a shard unless
    their group alone is over a shard's fair size.  Very long texts are measured whole.
    Null and repeated ids are fine; every row gets a shard and a slot of its own, slots being
    gapless from 0 in each shard; an empty table gives no rows; other columns are ignored.
    """
    held = settle(measure(docs, id_col, text_col), "measured")
    told = held.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    rows, total = told.n, told.bytes or 0
    ranges = int(min(MOST_RANGES, max(PER_SHARD * shards, rows // RANGE_ROWS)))
    cuts = splitters(held, total, ranges)

    told_cuts = docs.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(told_cuts.value, key.to_numpy(), "right").astype(np.int32))

    ranged = held.withColumn("r", range_of("key"))
    fair = max(1.0, total / ranges)
    sizes = ranged.groupBy("r").agg(F.sum("size").alias("bytes"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    one_key = F.col("lo") == F.col("hi")
    least = F.when(one_key, F.lit(total / shards)).otherwise(F.lit(fair))  # what a range may hold before it is subdivided
    # the driver sees one row for each range, at most 2 * MOST_RANGES + 1
    over = sizes.select("r", one_key.alias("one_key"), F.when(F.col("bytes") <= least, 1).otherwise(F.ceil(F.col("bytes") / F.lit(fair))).cast("int").alias("parts"))
    split = F.when(F.col("one_key"), F.xxhash64("doc_id", F.lit(5))).otherwise(F.xxhash64("key", F.lit(5)))
    cells = ranged.join(F.broadcast(over), "r").withColumn("p", F.when(F.col("parts") > 1, F.pmod(split, F.col("parts"))).otherwise(F.lit(0)).cast("int"))
    parts = cells.groupBy("r", "p").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).toPandas().sort_values(["r", "p"])
    parts["shard"] = deal_out(parts.bytes.to_numpy(np.float64), shards, fair)
    parts["before"] = parts.groupby("shard").n.cumsum() - parts.n
    # one row for each part, bounded like the ranges
    deal = docs.sparkSession.createDataFrame(parts[["r", "p", "shard", "before"]].astype({"r": int, "p": int, "shard": int, "before": int}), "r int, p int, shard int, before long")
    place = F.row_number().over(Window.partitionBy("r", "p").orderBy("key", "doc_id", "text_crc32"))
    return (
        cells.withColumn("at", place).join(F.broadcast(deal), ["r", "p"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("at") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the records of ``docs`` under ``path/shard=N``; ids must be unique here."""
    deal = assign_shards(docs, shards, id_col, text_col).select(F.col("doc_id").alias(id_col), "shard", "slot")
    docs.join(deal, id_col).repartition("shard", F.floor(F.col("slot") / 100_000)).write.partitionBy("shard").parquet(path)
