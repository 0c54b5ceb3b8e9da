"""Token counts by a map-side two-tier lookup; no pre-token is ever shuffled.

Tier one is a compact table of the lengths of frequent pre-tokens, broadcast to the workers;
its size is bounded by ``entries``.  Tier two is a cache in each worker that keeps what the
tokenizer library said about the rest.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import flat
from .pretokens import Encoder, spans
from .runtime import ship

#: The added token of the vocabulary, which the library takes out of texts before it splits them.
SPECIAL = "<|endoftext|>"


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def encoder(path: str, counts_only: bool) -> Encoder:
    """The worker's encoder for a byte-level tokenizer file; its cache lives as long as the worker."""
    t = tokenizer(path)
    return Encoder(lambda xs: [e.ids for e in t.encode_batch_fast(xs, add_special_tokens=False)], counts_only=counts_only)


def around_special(texts: pa.Array) -> tuple[pa.Array, np.ndarray | None]:
    """Texts cut at the added token, and the row of each segment (None where none is cut)."""
    data, _ = flat(texts)
    if SPECIAL.encode() not in data.tobytes():
        return texts, None
    parts, rows = [], []
    for i, x in enumerate(texts.to_pylist()):
        own = (x or "").split(SPECIAL)
        parts += own
        rows += [i] * len(own)
    return pa.array(parts, pa.large_string()), np.array(rows)


def count_column(texts: pa.Array, enc: Encoder) -> np.ndarray:
    """Token counts of a column."""
    segments, rows = around_special(texts)
    n = enc.counts(*flat(segments))
    if rows is None:
        return n
    sums = np.bincount(rows, n, len(texts)).astype(np.int64)
    return sums + np.bincount(rows, minlength=len(texts)) - 1  # and the token at each cut


def frequent_lengths(docs: DataFrame, path: str, text_col: str, entries: int, sample_rows: int, sample_chars: int) -> tuple[list[bytes], np.ndarray]:
    """Frequent pre-tokens and their token counts, from passages of the rows that come first.

    Only the speed of the counts depends on the sample, which is at most ``sample_rows``
    passages of ``sample_chars`` characters; neither are the rows counted for it nor is more
    read than the first partitions that hold so many.
    """
    room = F.greatest(F.length(text_col) - sample_chars, F.lit(0)) + 1
    passage = F.substring(F.col(text_col), (F.pmod(F.xxhash64(text_col), room) + 1).cast("int"), F.lit(sample_chars))
    seen: Counter[str] = Counter()
    for row in docs.select(passage.alias("t")).take(sample_rows):
        text = " ".join((row.t or "").split(SPECIAL))
        cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        starts, ends = spans(cp, np.array([0, len(cp)]))
        seen.update([text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    words = [w for w, _ in seen.most_common(entries)]
    counts = [len(e.ids) for e in tokenizer(path).encode_batch_fast(words, add_special_tokens=False)] if words else []
    return [w.encode() for w in words], np.array(counts, np.int64)


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
    entries: int = 1 << 16,
    sample_rows: int = 1000,
    sample_chars: int = 2000,
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    Whole texts, as the library counts them without begin, end or added tokens; its added
    token inside a text counts as one.  A null text is empty (0 bytes, 0 tokens); very long ones
    are read whole; ids may be null or repeat and pass through; other columns are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer_path, text_col, entries, sample_rows, sample_chars))

    def count(batches):
        enc = encoder(tokenizer_path, True)
        enc.preload(*table.value)
        for b in batches:
            texts = b.column(1)
            n = count_column(texts, enc)
            size = np.diff(flat(texts)[1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    )
    return docs.select(id_col, text_col).mapInArrow(count, schema)
