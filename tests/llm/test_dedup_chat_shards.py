"""Chunk recipes, chat formatting and sharding on small odd fixtures against brute force."""
import hashlib
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from millrace.llm import chat, chunk_dedup, sharding


def brute_dedup(docs):
    groups = defaultdict(list)
    for r in docs:
        groups[r.text or ""].append(r.doc_id)
    out = []
    for r in docs:
        ids = groups[r.text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        kept = len(ids) == 1 if keep is None or r.doc_id is None and len(ids) == 1 else r.doc_id == keep if r.doc_id is not None else False
        out.append((r.doc_id, keep, len(ids), kept, hashlib.sha256((r.text or "").encode()).hexdigest()))
    return Counter(out)


def test_dedup(spark, odd_docs):
    want = brute_dedup(odd_docs.collect())
    assert Counter(map(tuple, chunk_dedup.exact_dedup(odd_docs).collect())) == want
    assert chunk_dedup.exact_dedup(odd_docs.limit(0)).count() == 0


def test_dedup_survives_shared_chunk_names(spark, odd_docs):
    """With names that collide all the time the answer is the same."""
    poor = lambda c: F.pmod(F.xxhash64(c), F.lit(3))
    assert Counter(map(tuple, chunk_dedup.exact_dedup(odd_docs, chunk_hash=poor).collect())) == brute_dedup(odd_docs.collect())


def test_chunks_lose_nothing(spark, odd_docs):
    whole = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    bad = odd_docs.filter("text is not null").filter(F.array_join(chunk_dedup.chunks_of(F.col("text")), "") != whole)
    assert bad.count() == 0


def test_chunks_of_any_script_find_themselves_again(spark):
    """After an insertion in front nearly all chunks are the same, whatever the script."""
    import random

    random.seed(6)
    for low, high in ((0x61, 0x7A), (0x3B1, 0x3C9), (0x430, 0x44F), (0x621, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F600, 0x1F64F)):
        text = "".join(chr(random.randint(low, high)) for _ in range(40_000))
        df = spark.createDataFrame([(text,), (chr(low) + text,)], "text string")
        one, two = (r.c for r in df.select(chunk_dedup.chunks_of(F.col("text")).alias("c")).collect())
        assert len(one) > 40 and len(set(one) & set(two)) >= len(one) - 4


def test_chat_reads_back(spark):
    own = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (-1, 0, "user", own), (-1, 1, "assistant", own), (1, 1, "assistant", "b\\|\\\\<|<\\|"), (1, 0, "system", None), (1, 2, "user", "tail\n\n"), (2, 0, "user\nx\\n<|", "no reply"),
        (3, None, None, ""), (None, 0, "assistant", "x" * 100000), (None, 1, "assistant", "é🙂"), (4, 0, "assistant", ""), (4, 0, "assistant", ""),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("example", F.lit(1)).withColumn("formatted", F.lit("x"))
    ex = chat.expand(df)
    got = {r.conv_id: r for r in chat.conversation_digest(ex).collect()}
    per = defaultdict(list)
    for c, t, r, x in rows:
        per[c].append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(per)
    for c, ts in per.items():
        ts.sort()
        loss = "".join(x for _, r, x in ts if r == "assistant")
        assert got[c].n_turns == len(ts)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in ts).encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    # each reply is the target of one example, after all that precedes it
    own_rows = sorted((r for r in ex.collect() if r.conv_id == 1), key=lambda r: r.example)
    assert len(own_rows) == 2 and own_rows[0].formatted.endswith("<|im_end|>\n") and own_rows[1].loss_start == -1
    assert own_rows[1].formatted.startswith(own_rows[0].formatted)
    assert chat.conversation_digest(chat.expand(df.limit(0))).count() == 0


def check_shards(docs, got, shards):
    assert sorted(map(str, [(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs])) == sorted(
        map(str, [(r.doc_id, r["size"], r.text_crc32) for r in got])
    )
    slots, sizes = defaultdict(list), Counter()
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return sizes


def test_shards(spark, odd_docs):
    check_shards(odd_docs.collect(), sharding.assign_shards(odd_docs, 4).collect(), 4)
    assert sharding.assign_shards(odd_docs.limit(0), 4).count() == 0


def test_shards_are_even_with_a_hot_group(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text again")).otherwise(F.concat(F.lit("t"), F.col("id"), F.repeat(F.lit("y"), (F.col("id") % 50).cast("int")))).alias("text"))
    sizes = check_shards(docs.collect(), sharding.assign_shards(docs, 24).collect(), 24)
    mean = sum(sizes.values()) / 24
    assert max(abs(v - mean) for v in sizes.values()) < 0.03 * mean
    again = sharding.assign_shards(docs, 24)
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, sharding.assign_shards(docs.repartition(7), 24).collect()))


def test_groups_of_equal_texts_stay_together(spark):
    """Every group that fits a shard is in one, and the shards are still even."""
    import random

    random.seed(9)
    rows, i = [], 0
    for copies in [1] * 3000 + [2] * 200 + [40] * 8 + [150] * 2 + [1500]:
        text = "".join(random.choice("abcdef ") for _ in range(random.randint(5, 60)))
        rows += [(i + k, text) for k in range(copies)]
        i += copies
    docs = spark.createDataFrame(rows + [(i, None), (None, "x")], "doc_id long, text string")
    sizes = check_shards(docs.collect(), sharding.assign_shards(docs, 8).collect(), 8)
    mean, places, whole = sum(sizes.values()) / 8, defaultdict(set), Counter()
    assert max(abs(v - mean) for v in sizes.values()) < 0.03 * mean
    for r in sharding.assign_shards(docs, 8).collect():
        places[r.text_crc32].add(r.shard)
        whole[r.text_crc32] += r["size"]
    assert all(len(v) == 1 for k, v in places.items() if whole[k] <= mean) and any(len(v) > 1 for v in places.values())


def test_the_law_against_brute_force(spark):
    """Shards, sizes and slots of a small table, dealt anew from the keys as one task would."""
    import numpy as np

    rows = [(k, "word " * (k % 23) + str(k % 61)) for k in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = sharding.measure(docs)
    keys = {r.doc_id: (r.key, r["size"]) for r in held.collect()}
    total, ranges = sum(n for _, n in keys.values()), sharding.PER_SHARD * 4
    cuts = sharding.splitters(held, total, ranges)
    fair, per_range = total / ranges, defaultdict(list)
    for d, (k, n) in keys.items():
        per_range[int(np.searchsorted(cuts, k, "right"))].append((k, d, n))
    hashed = {r.k: r.h for r in spark.createDataFrame([(k,) for k, _ in keys.values()], "k long").distinct().selectExpr("k", "xxhash64(k, 5) AS h").collect()}
    parts = defaultdict(list)
    for r, own in per_range.items():
        size = sum(n for _, _, n in own)
        one = len({k for k, _, _ in own}) == 1
        n = 1 if size <= (total / 4 if one else fair) else -int(-size // fair)
        assert not one or n == 1
        for k, d, s in own:
            parts[r, hashed[k] % n].append((k, d, s))
    order = sorted(parts)
    shard_of = sharding.deal_out(np.array([sum(s for _, _, s in parts[p]) for p in order], float), 4, fair)
    want, taken = {}, Counter()
    for p, shard in zip(order, shard_of.tolist()):
        for k, d, s in sorted(parts[p], key=lambda x: (x[0], x[1])):
            want[d] = (shard, taken[shard])
            taken[shard] += 1
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.assign_shards(docs, 4).collect()} == want


def test_written_shards(spark, tmp_path):
    docs = spark.range(300).selectExpr("id AS doc_id", "repeat('x', CAST(id % 17 AS INT)) AS text", "id % 5 AS other")
    sharding.write_shards(docs, str(tmp_path / "out"), 3)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("doc_id", "text", "other").collect())) == sorted(map(tuple, docs.collect()))
    deal = {r.doc_id: r.shard for r in sharding.assign_shards(docs, 3).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == deal
