"""Quality rules: a hashed n-gram log-likelihood ratio of trusted target to raw corpus.

Word n-grams (n = 1, 2) of whole texts fall into ``2**bits`` hash buckets.  One multinomial is
estimated from all documents, another from trusted ones; a document's score is the mean over
its n-grams of the log ratio of the two, so it does not depend on the length.  A document is
kept when its score reaches a fixed threshold; nothing is drawn at random.

The raw counts cover every document.  With ``tuning_rows=None``, as the queries have it, all
labelled good documents are trusted and the threshold is set on all labelled ones, a trusted one
scored without its own n-grams in the trusted counts.  With a number the threshold is set on a
sample, ``tuning_rows`` of either label, and all other good ones are trusted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .columns import blocks, flat, mix
from .runtime import release, settle, ship
from .words import BLANK, Words

#: Characters that count as symbols, and the base rule's limits.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 0.5
NGRAMS = (1, 2)
#: Ids of trusted documents that are broadcast (16 MB of them); of more, texts and ids are shuffled.
MOST_IDS = 1 << 21
#: Labelled scores in a range that is sorted by itself.
RANGE_ROWS = 250_000


@dataclass
class Model:
    """Log ratio of each bucket, and the least score of a document that is kept."""

    ratio: np.ndarray
    threshold: float

    @property
    def bits(self) -> int:
        return len(self.ratio).bit_length() - 1


def buckets(words: Words, bits: int):
    """For each n the buckets of the n-grams and the rows they stand in."""
    for n in NGRAMS:
        h, at = words.windows(n)
        yield (mix(h + np.uint64(n)) & np.uint64((1 << bits) - 1)).astype(np.int64), words.rows[at]


def scores(words: Words, ratio: np.ndarray) -> np.ndarray:
    total, count = np.zeros(words.n_rows), np.zeros(words.n_rows)
    for bucket, rows in buckets(words, len(ratio).bit_length() - 1):
        total += np.bincount(rows, ratio[bucket], words.n_rows)
        count += np.bincount(rows, minlength=words.n_rows)
    return total / np.maximum(count, 1)


def left_out_scores(words: Words, raw: np.ndarray, target: np.ndarray, smooth: float) -> np.ndarray:
    """The score of each row by trusted counts that lack the row's own n-grams; it means nothing for rows that are not in them."""
    size = len(raw)
    bucket, rows = (np.concatenate(x) for x in zip(*buckets(words, size.bit_length() - 1), strict=True))
    if words.n_rows == 1:  # a long text: its n-grams are not sorted
        own = np.bincount(bucket, minlength=size)[bucket]
    else:
        _, which, own = np.unique(rows * size + bucket, return_inverse=True, return_counts=True)
        own = own[which]
    n = np.bincount(rows, minlength=words.n_rows)
    one = np.log(np.maximum(target[bucket] - own, 0) + smooth) - np.log(raw + smooth)[bucket]
    whole = np.log(raw.sum() + smooth * size) - np.log(np.maximum(target.sum() - n, 0) + smooth * size)
    return np.where(n > 0, np.bincount(rows, one, words.n_rows) / np.maximum(n, 1) + whole, 0.0)


def base_features(words: Words) -> dict[str, np.ndarray]:
    """The base counts of each row."""
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    lead = (words.data & 0xC0) != 0x80
    return {
        "n_words": words.counts,
        "word_chars": words.per_row(np.flatnonzero(lead & ~BLANK[words.data])),
        "n_symbols": words.per_row(np.flatnonzero(symbol[words.data])),
        "n_dup_lines": words.duplicate_lines(),
        "n_repeat_words": words.repeated_words(3),
    }


def _blocks(column):
    data, offsets = flat(column)
    for a, b in blocks(data, offsets):
        yield a, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def log_ratio(raw: np.ndarray, target: np.ndarray, smooth: float) -> np.ndarray:
    size = len(raw)
    one = np.log(target + smooth) - np.log(target.sum() + smooth * size)
    return one - (np.log(raw + smooth) - np.log(raw.sum() + smooth * size))


def choose_threshold(good: np.ndarray, bad: np.ndarray, weight: float = 5.0) -> float:
    """The cut that best separates the tuning scores, a lost good document weighing ``weight`` bad ones.

    Of equally good cuts the middle of the widest gap; without bad scores just below the good
    ones, without good ones 0.
    """
    if not len(good):
        return 0.0
    if not len(bad):
        return float(good.min()) - 0.05
    at = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[at[0] - 0.1], (at[1:] + at[:-1]) / 2])
    gap = np.concatenate([[0.0], np.diff(at)])
    won = weight * (1 - np.searchsorted(np.sort(good), cuts) / len(good)) + np.searchsorted(np.sort(bad), cuts) / len(bad)
    best = np.flatnonzero(won >= won.max() - 1e-12)
    return float(cuts[best[np.argmax(gap[best])]])


def threshold_of_all(scored: DataFrame, ranges: int = 1, weight: float = 5.0) -> float:
    """:func:`choose_threshold` over a table: ``score`` and, in ``good`` and ``bad``, how many documents of either have it.

    The scores are sorted in ``ranges``, of which the driver sees a row each.
    """
    spark = scored.sparkSession
    each = scored.groupBy("score").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    each = settle(each.repartitionByRange(ranges, "score").withColumn("part", F.spark_partition_id()), "scores")
    sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.min("score").alias("lo"), F.max("score").alias("hi")]
    parts, before, n_good, n_bad, last = each.groupBy("part").agg(*sums).orderBy("lo").collect(), [], 0, 0, None
    for p in parts:
        before.append((p.part, n_good, n_bad, last))
        n_good, n_bad, last = n_good + p.good, n_bad + p.bad, p.hi
    if not n_good or not n_bad:
        release(each)
        return parts[0].lo - 0.05 if n_good else 0.0
    run = Window.partitionBy("part").orderBy("score")
    lower = F.coalesce(F.lag("score").over(run), "last")
    below = lambda c: F.col(f"{c}_before") + F.coalesce(F.sum(c).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = each.join(F.broadcast(spark.createDataFrame(before, "part int, good_before long, bad_before long, last double")), "part").select(
        F.coalesce((F.col("score") + lower) / 2, F.col("score") - 0.1).alias("cut"),
        F.coalesce(F.col("score") - lower, F.lit(0.0)).alias("gap"),
        (weight * (1 - below("good") / n_good) + below("bad") / n_bad).alias("won"),
    )
    most = cuts.agg(F.max("won")).first()[0]
    cut = cuts.filter(F.col("won") >= most - 1e-12).orderBy(F.desc("gap"), "cut").first().cut
    release(each)
    return cut


def _counted(texts: DataFrame, bits: int) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket; the driver holds 2**bits of them."""
    size = 1 << bits

    def count(batches):
        n = np.zeros(size, np.int64)
        for b in batches:
            for _, words in _blocks(b.column(0)):
                for bucket, _ in buckets(words, bits):
                    n += np.bincount(bucket, minlength=size)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    found, n = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas(), np.zeros(size)
    n[found.bucket] = found.n
    return n


def _fit_all(pairs: DataFrame, known: DataFrame, bits: int, smooth: float, most_ids: int) -> Model:
    """The model of all labelled rows; of more than ``most_ids`` all texts are scored, and the scores are joined."""
    kinds = known.filter("q IN (0, 1)").groupBy("id").agg(F.max("q").alias("good"), (1 - F.min("q")).alias("bad"))
    n_kinds = kinds.count()
    few = n_kinds <= most_ids
    good = kinds.filter("good = 1").select("id")
    good = F.broadcast(good) if few else good.hint("merge")
    raw, target = _counted(pairs.select("t"), bits), _counted(pairs.join(good, "id", "left_semi").select("t"), bits)
    ratio = log_ratio(raw, target, smooth)
    if not n_kinds:
        return Model(ratio, 0.0)
    told = pairs.sparkSession.sparkContext.broadcast((ratio, raw, target))

    def rate(batches):
        ratio, raw, target = told.value
        for b in batches:
            for a, words in _blocks(b.column(1)):
                at = np.flatnonzero(words.counts >= LEAST_WORDS)
                both = [pa.array(x[at]) for x in (scores(words, ratio), left_out_scores(words, raw, target, smooth))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(a + at)), *both], names=["id", "score", "left_out"])

    some = pairs.join(F.broadcast(kinds.select("id")), "id", "left_semi") if few else pairs.filter("id IS NOT NULL")
    some = some.mapInArrow(rate, "id long, score double, left_out double").groupBy("id").agg(F.min("score").alias("score"), F.min("left_out").alias("left_out"))
    own = F.when(F.col("good") == 1, F.col("left_out")).otherwise(F.col("score")).alias("score")
    return Model(ratio, threshold_of_all(some.join(kinds, "id").select(own, "good", "bad"), 1 + n_kinds // RANGE_ROWS))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = 16,
    smooth: float = 0.5,
    tuning_rows: int | None = 2_000,
    most_ids: int = MOST_IDS,
) -> Model:
    """Both multinomials and the threshold.

    ``labels`` has ``id_col`` and ``quality`` (1 good, 0 bad; rows with nulls are passed over,
    rows that repeat an id count once).  Ids are integers; null texts have no words, and a
    document counts as often as it comes.  Trusted documents are found by a join: their ids are
    broadcast while there are at most ``most_ids``, else shuffled.

    With ``tuning_rows=None`` every good document is trusted and the threshold is set on every
    labelled one of at least 50 words, an id once by its least score; a trusted one is scored
    without its own n-grams in the trusted counts, as a document that has no label is.  Else
    tuned is on the labelled rows of either kind with the smallest id hashes, of the good ones
    every third, and all other good ones are trusted.
    """
    spark = docs.sparkSession
    ship(spark)
    order = F.xxhash64(F.col(id_col), F.lit(17))
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").alias("q"), order.alias("o")).filter("id IS NOT NULL").distinct()
    pairs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    if tuning_rows is None:
        return _fit_all(pairs, known, bits, smooth, most_ids)
    first = lambda q, n: [r.id for r in known.filter(F.col("q") == q).orderBy("o", "id").limit(n).collect()]
    tuning, bad = first(1, 3 * tuning_rows)[::3], first(0, tuning_rows)
    chosen = spark.createDataFrame([(x,) for x in tuning + bad], "id long").distinct()  # at most 2 * tuning_rows
    held = spark.createDataFrame([(x,) for x in tuning], "id long")
    good = known.filter("q = 1").select("id").distinct().join(F.broadcast(held), "id", "left_anti")
    good = F.broadcast(good) if good.count() <= most_ids else good.hint("merge")
    ratio = log_ratio(_counted(pairs.select("t"), bits), _counted(pairs.join(good, "id", "left_semi").select("t"), bits), smooth)
    if not tuning and not bad:
        return Model(ratio, 0.0)
    told = spark.sparkContext.broadcast(ratio)

    def rate(batches):
        for b in batches:
            for a, words in _blocks(b.column(1)):
                at = np.flatnonzero(words.counts >= LEAST_WORDS)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(a + at)), pa.array(scores(words, told.value)[at])], names=["id", "score"])

    some = pairs.join(F.broadcast(chosen), "id", "left_semi").mapInArrow(rate, "id long, score double")
    some = some.groupBy("id").agg(F.min("score").alias("score")).toPandas()  # a row for each chosen id
    s, ids = some.score.to_numpy(), some.id.to_numpy()
    return Model(ratio, choose_threshold(s[np.isin(ids, tuning)], s[np.isin(ids, bad)]))


def decide(words: Words, model: Model):
    """Base counts, whether the base rule fails, the score and the verdict of each row."""
    f, score = base_features(words), scores(words, model.ratio)
    failed = (f["n_words"] < LEAST_WORDS) | (f["n_repeat_words"] > MOST_REPEATED * f["n_words"])
    return f, failed, score, ~failed & (score >= model.threshold)


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all their columns, that the rules keep.

    Null and empty texts go (they have no words), very long ones are read whole, repeated rows
    and null ids are judged by their texts alone; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches):
        for b in batches:
            verdicts = [decide(words, held.value)[3] for _, words in _blocks(b.column(b.schema.get_field_index(text_col)))]
            yield b.filter(pa.array(np.concatenate([*verdicts, np.zeros(0, bool)])))

    return docs.mapInArrow(keep, docs.schema)


def apply(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, the base counts, ``base_failed, score, kept``.

    Counts are exact: words, lines and windows are compared whole.  A null or empty text has no
    words and fails the base rule; a very long one is read whole; a score equal to the threshold
    is kept.  Ids may be null or repeat; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)

    def rate(batches):
        m = held.value
        for b in batches:
            for a, words in _blocks(b.column(1)):
                f, failed, score, kept = decide(words, m)
                columns = [b.column(0).slice(a, words.n_rows), *(pa.array(x.astype(np.int64)) for x in f.values())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(score), pa.array(kept)], names=["doc_id", *f, "base_failed", "score", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return docs.select(id_col, text_col).mapInArrow(rate, f"doc_id {kind}, {counts}, base_failed boolean, score double, kept boolean")
