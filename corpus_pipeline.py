"""A corpus pipeline over ``documents``: language, quality, exact and near copies, packing.

Each stage works on all that the one before it kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chunk_dedup, langid, minhash_join, packing, quality
from millrace.llm.queries import table, tokenizer_file
from millrace.llm.runtime import settle


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; those without text or letters, or of no clear language, go."""
    return langid.accepted(docs, langid.fit(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels"), tuning_rows=None))


def _those(docs: DataFrame, verdicts: DataFrame, mark: Column | None = None) -> DataFrame:
    """The rows of ``docs`` whose id is kept, rows that repeat an id and its text once; rows without an id stay.

    With ``mark`` (a digest of the text, which ``verdicts`` has as ``mark``) rows that share an
    id but not a text are told apart; without it they are one document.
    """
    told = settle(verdicts, "verdicts")
    kept = docs.join(told.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_semi")
    repeated = settle(told.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():  # only these rows' texts are compared
        again = kept.join(repeated, "doc_id", "left_semi")
        if mark is not None:
            own = told.filter("kept").select("doc_id", "mark").distinct()
            again = again.withColumn("mark", mark).join(own, ["doc_id", "mark"], "left_semi").select(*docs.columns)
        kept = kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(again.dropDuplicates(["doc_id", "text"]).select(*docs.columns))
    return kept.select(*docs.columns).union(docs.filter(F.col("doc_id").isNull()))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    verdicts = chunk_dedup.exact_dedup(docs).select("doc_id", "kept", F.col("text_sha256").alias("mark"))
    return _those(docs, verdicts, F.sha2(F.coalesce("text", F.lit("")), 256))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id."""
    return _those(docs, minhash_join.near_duplicates(docs, n=5, percent=80).select("doc_id", "kept"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"), limit=1024, end_id=2)


STAGES = [
    ("language ID", language),
    ("quality rules", good),
    ("exact dedup", exact),
    ("MinHash near-dedup", near),
    ("best-fit packing", packed),
]

#: SQL can express neither the recurrent network nor the packing; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after the other, over ``documents``.

    Ids that repeat: rows that repeat an id and its text are one from the exact stage on; rows
    that share an id but not a text are judged one by one up to there, and near copies of either
    are near copies of both.  Rows without an id are judged by language and quality alone and
    then stay.  Null, empty and wordless texts go in the first stage; very long ones are read
    whole; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
