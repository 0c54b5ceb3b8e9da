"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own bytes say so, in any script, so equal texts give equal chunks, and
texts that share a passage share its chunks.  Chunks are
deduplicated to verified identifiers; two texts are then equal exactly when their ordered
identifier lists are.  Long texts move once, chunk by chunk, after a map-side distinct; what
is grouped and joined afterwards is the short list of identifiers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import settle

#: Chunk sizes in UTF-8 bytes; a cut falls after the first context past the least size.
LEAST, MOST = 256, 4096


def _some(start: int, stop: int, step: int) -> str:
    return "[" + "".join(f"\\x{b:02x}" for b in range(start, stop, step)) + "]"


#: Contexts: three ASCII bytes, each of a quarter of them; or the last bytes of two other characters, of an eighth and a quarter.
CUT = _some(1, 0x80, 4) + _some(2, 0x80, 4) + _some(0, 0x80, 4) + "|" + _some(0x81, 0xC0, 8) + "[\\xc0-\\xff][\\x80-\\xbf]{0,2}" + _some(0x82, 0xC0, 4)


def chunks_of(text: Column, least: int = LEAST, most: int = MOST, cut: str = CUT) -> Column:
    """Array of consecutive chunks of the UTF-8 bytes of ``text``, each byte as the character of its value; empty for an empty text.

    Chunks are equal when their bytes are, and together they are the text's bytes.
    """
    rest = f"(?s).{{{least},{most - 5}}}?(?:{cut}|\\z)|.{{1,{most}}}"
    return F.regexp_extract_all(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), F.lit(rest), F.lit(0))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; of equal texts the row with the largest id stays.  A null
    text counts as the empty text.  A null id never beats another id; where every id of a
    group is null, ``keep_id`` is null and ``kept`` is false for all of it but true where the
    group has one row.  Rows that repeat an id and its text are all reported, with the same
    answer.  Very long texts are read whole.  Other columns are ignored whatever their names; an
    empty table gives no rows.

    ``chunk_hash`` names a chunk.  A name is trusted only after every chunk that bears it has
    been compared in full; the chunks behind a shared name get variant numbers, and the texts
    that hold them are compared by (name, variant).
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    cut = base.select("doc_id", "t", chunks_of(F.col("t")).alias("c"))
    slim = settle(
        cut.select("doc_id", F.sha2("t", 256).alias("text_sha256"), F.transform("c", lambda x: chunk_hash(x)).alias("recipe")),
        "recipes",
    )
    named = base.select(F.explode(chunks_of(F.col("t"))).alias("c")).select(chunk_hash(F.col("c")).alias("h"), "c")
    shared = (
        named.groupBy("h", "c").agg(F.lit(1).alias("one"))
        .groupBy("h").agg(F.count("one").alias("n")).filter("n > 1").select("h")
    )
    shared = settle(shared, "shared-names")
    if not shared.isEmpty():
        slim = settle(_by_variant(base, slim, named, shared, chunk_hash), "variant-recipes")
    else:
        slim = slim.withColumn("variants", F.array().cast("array<int>"))
    groups = slim.groupBy("recipe", "variants").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    # recipe and variants are never null, so plain equality is enough and AQE may split a hot group
    left, right = slim.alias("l"), groups.alias("r")
    joined = left.join(right, (F.col("l.recipe") == F.col("r.recipe")) & (F.col("l.variants") == F.col("r.variants")))
    return joined.select(
        F.col("l.doc_id").alias("doc_id"),
        F.col("r.keep_id").alias("keep_id"),
        F.col("r.group_size").alias("group_size"),
        F.coalesce(F.col("l.doc_id") == F.col("r.keep_id"), F.col("r.group_size") == 1).alias("kept"),
        F.col("l.text_sha256").alias("text_sha256"),
    )


def _by_variant(base: DataFrame, slim: DataFrame, named: DataFrame, shared: DataFrame, chunk_hash) -> DataFrame:
    """Recipes told apart where different chunks share a name: beside each such name, in order, its variant."""
    texts = named.join(shared, "h", "left_semi").distinct()
    # the variant is the number of smaller distinct chunks of that name: names are shared by a handful of chunks
    a, b = texts.alias("a"), texts.alias("b")
    variant = (
        a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("b.c") <= F.col("a.c")))
        .groupBy(F.col("a.h").alias("h"), F.col("a.c").alias("c")).agg(F.count(F.lit(1)).cast("int").alias("v"))
    )
    sha = base.select(F.sha2("t", 256).alias("s"), F.posexplode(chunks_of(F.col("t"))).alias("pos", "c"), F.crc32("t").alias("k"))
    held = sha.withColumn("h", chunk_hash(F.col("c"))).join(variant, ["h", "c"]).select("s", "k", "pos", "v").distinct()
    lists = held.groupBy("s", "k").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("pv"))
    lists = lists.select(F.col("s").alias("text_sha256"), F.col("pv.v").alias("variants"))
    none = F.array().cast("array<int>")
    return slim.join(lists, "text_sha256", "left").select("doc_id", "text_sha256", "recipe", F.coalesce("variants", none).alias("variants"))
