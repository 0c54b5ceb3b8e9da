"""The pipeline against a brute-force version of its decisions."""
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, quality
from millrace.llm.columns import flat
from millrace.llm.words import Words

from .test_minhash_join import brute

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_run_is_the_brute_version(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    net = langid.fit(docs)
    first = {d for d, t in rows.items() if langid.decide(net, pa.array([t]))[0][0] != "und" and langid.decide(net, pa.array([t]))[1][0] >= 0.35}
    left = docs.filter(F.col("doc_id").isin(sorted(first)))
    model = quality.fit(left, spark.read.parquet(f"{SF}/labels.parquet"))
    second = {d for d in first if quality.decide(Words(*flat(pa.array([rows[d]]))), model)[3][0]}
    latest = {}
    for d in sorted(second):
        latest[rows[d]] = d
    third = set(latest.values())
    fourth = {d for d, (_, _, kept) in brute([(d, rows[d]) for d in third], 5, 80).items() if kept}
    got = pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == fourth and 0 < len(fourth) < len(rows)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {d: len(t.encode(rows[d], add_special_tokens=False).ids) + 1 for d in fourth}
    held, per = defaultdict(list), Counter()
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
        per[r.doc_id] += r.length
    assert dict(per) == want
    for own in held.values():
        own.sort()
        assert own[0][0] == 0 and sum(n for _, n in own) <= 1024 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))


def test_quality_stage_sets_the_threshold_on_all_labels(spark, tmp_path):
    """Of 3,000 labels of either kind, of mixed quality, all count; a sample of 2,000 keeps other documents."""
    rng = np.random.default_rng(7)
    ids = np.arange(6_000)
    texts = [" ".join(np.where(rng.random(60) < rng.normal(0.4 + 0.2 * (i % 2), 0.15), "g", "b") + rng.integers(0, 300, 60).astype(str).astype(object)) for i in ids]
    docs = spark.createDataFrame([(int(i), t) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string")
    labels = spark.createDataFrame([(int(i), int(i % 2)) for i in ids], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in pipeline.good(spark, docs, str(tmp_path)).collect()}
    words, good = Words(*flat(pa.array(texts))), ids % 2 == 1
    bucket, rows = (np.concatenate(x) for x in zip(*quality.buckets(words, 16), strict=True))
    raw, target = np.bincount(bucket, minlength=1 << 16), np.bincount(bucket[good[rows]], minlength=1 << 16)
    ratio = quality.log_ratio(raw, target, 0.5)
    cut = quality.choose_threshold(quality.left_out_scores(words, raw, target, 0.5)[good], quality.scores(words, ratio)[~good])
    assert kept == set(ids[quality.decide(words, quality.Model(ratio, cut))[3]].tolist())


def test_stages_on_odd_rows(spark, odd_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = odd_docs.select(*columns)
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, now, SF)
            assert out.columns == columns, name
            assert (out.count() == 0) == empty or name in ("quality rules",)
    exact = Counter(r.doc_id for r in pipeline.exact(spark, docs, SF).collect())
    assert exact[3] == 1 and exact[5] == 0 and exact[6] == 1
    near = Counter(r.doc_id for r in pipeline.near(spark, docs, SF).collect())
    assert near[5] == 1 and near[6] == 0
    assert pipeline.packed(spark, docs, SF).count() > 0
    assert pipeline.packed(spark, docs.limit(0), SF).count() == 0


def test_repeated_ids(spark):
    """Rows that share an id: one text once, different texts each by its own group; rows without an id stay."""
    rows = [(1, "a b"), (1, "c d"), (2, "a b"), (3, "e f"), (3, "e f"), (None, "a b"), (None, "a b"), (4, None), (5, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    exact = Counter((r.doc_id, r.text) for r in pipeline.exact(spark, docs, SF).collect())
    assert exact == Counter([(1, "c d"), (2, "a b"), (3, "e f"), (None, "a b"), (None, "a b"), (5, "")])
    near = Counter((r.doc_id, r.text) for r in pipeline.near(spark, docs, SF).collect())
    assert near == Counter([(1, "a b"), (1, "c d"), (3, "e f"), (None, "a b"), (None, "a b"), (4, None), (5, "")])
