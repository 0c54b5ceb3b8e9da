"""The recurrent network: gradients, held-out accuracy, odd rows."""
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import langid
from millrace.llm.columns import flat


def double(net):
    net.w, net.u = [w.astype(np.float64) for w in net.w], [u.astype(np.float64) for u in net.u]
    net.v, net.c = net.v.astype(np.float64), net.c.astype(np.float64)
    return net


def test_gradients_are_the_differences():
    rng = np.random.default_rng(0)
    net = double(langid.Network.start(["a", "b", "c"], 4, rng))
    x, y = rng.integers(0, 20, (6, 5)), rng.integers(0, 3, 5)
    x[4:, 2] = langid.PAD
    _, found = net.gradients(x, y)
    for p, g in zip(net.parameters, found):
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in p.shape)
            if p.shape[1] == 257:
                i = (i[0], int(x[rng.integers(0, 4), 0]))
            old = p[i]
            p[i] = old + 1e-4
            up = net.gradients(x, y)[0]
            p[i] = old - 1e-4
            down = net.gradients(x, y)[0]
            p[i] = old
            assert abs((up - down) / 2e-4 - g[i]) < 1e-6


def test_pooled_is_the_mean_of_whole_texts():
    net = langid.Network.start(["a", "b"], 5, np.random.default_rng(1))
    texts = ["", "x", "y" * 64, "z" * 65, "é" * 3000, None]
    data, offsets = flat(pa.array(texts))
    got = langid.pooled(net, data, offsets, block=3)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        ps = []
        for lo in range(0, len(raw), 64):
            own = np.full((64, 1), langid.PAD)
            own[: len(raw[lo : lo + 64]), 0] = list(raw[lo : lo + 64])
            ps.append(net.probabilities(own)[: len(raw[lo : lo + 64]), :, 0])
        want = np.concatenate(ps).mean(0) if ps else np.zeros(2)
        assert np.allclose(got[i], want, atol=1e-5)
    assert len(langid.label_positions(net, "né")) == 3


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.fit(docs)
    rows = langid.predict(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_training_never_sees_held_out_rows(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("some text here").alias("text"), F.when(langid.held_out("id"), "never").when(F.col("id") % 2 == 0, "a").otherwise("b").alias("lang"))
    assert langid.fit(docs, epochs=1).languages == ["a", "b"]


def test_every_language_and_segment_is_learned(spark, monkeypatch):
    docs = spark.range(1400).selectExpr("id AS doc_id", "repeat('x', 640) AS text", "concat('l', id % 70) AS lang")
    seen = []
    gradients = langid.Network.gradients
    monkeypatch.setattr(langid.Network, "gradients", lambda net, x, y: seen.append(len(y)) or gradients(net, x, y))
    net = langid.fit(docs, epochs=1, size=2)
    kept = docs.filter(~langid.held_out()).count()
    assert len(net.languages) == 70 and sum(seen) == kept * 10  # 600 characters are ten segments of 64 bytes


def test_odd_rows(spark, odd_docs):
    net = langid.fit(odd_docs, epochs=1)
    rows = langid.predict(odd_docs, net).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.doc_id in (1, 2, 8):
            assert r.lang_pred == "und" and r.score == 0
        else:
            assert r.lang_pred in ("de", "en", "fr")
    empty = odd_docs.limit(0)
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd_docs, langid.fit(empty)).collect()} == {"und"}
