"""Quality rules and packing against brute force."""
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import packing, quality
from millrace.llm.columns import flat, mix
from millrace.llm.words import Words, digests

from .conftest import thue_morse

JSON = P.path("byte_bpe_50k.json")


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark, odd_docs):
    more = spark.createDataFrame([(20, "a b c a b c\n\na b\na b\n | #\r\n | #\r\n"), (21, "x\x0by\x0cz x y z é|é"), (22, "\n\n"), (23, "tail\n"), (24, "tail\ntail"), (25, "\n x\n x\n")], "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").union(more)
    got = quality.apply(docs, quality.Model(np.zeros(16), 0.0)).collect()
    want = Counter((r.doc_id, *brute_base(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and r.kept == (not r.base_failed)


def test_base_counts_of_hash_equal_words(spark):
    one, two = thue_morse()
    rows = [(1, f"{one}\n{two}\n{one} x\n{two} x"), (2, f"{one} {one} {one} {two} {two} {two}"), (3, f"{one} {two} {one} {two}")]
    for parts in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = quality.apply(docs, quality.Model(np.zeros(16), 0.0)).collect()
        assert {(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {(d, *brute_base(t)) for d, t in rows}


def test_verdicts_against_brute_force(spark):
    """Counts, ratio, threshold and verdicts of a small table, worked out word by word."""
    import random

    random.seed(4)
    rows = [(i, " ".join(random.choice("abcdefgh" if i % 3 else "efghijkl") + str(random.randint(0, 9)) for _ in range(random.randint(40, 90)))) for i in range(240)]
    rows += [(300, None), (301, ""), (None, "a1 b2"), (5, rows[5][1])]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 240, 2)] + [(4, 1), (None, 1), (7, None), (999, 1)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    for most in (0, 1 << 21):
        model = quality.fit(docs, known, bits=12, tuning_rows=20, most_ids=most)
        got = {(r.doc_id, r.kept) for r in quality.apply(docs, model).collect()}
        place = lambda g: int((mix(sum_of(g) + np.uint64(len(g))) & np.uint64((1 << 12) - 1))[0])
        grams = lambda t: [place(w[i : i + n]) for w in [(t or "").split()] for n in (1, 2) for i in range(len(w) - n + 1)]
        order = {r.doc_id: r.o for r in known.selectExpr("doc_id", "xxhash64(doc_id, 17) AS o").collect()}
        kind = lambda q: sorted({d for d, x in labels if x == q and d is not None}, key=lambda d: (order[d], d))
        tuning, bad = kind(1)[:60][::3], kind(0)[:20]
        raw, target = Counter(), Counter()
        for d, t in rows:
            raw.update(grams(t))
            target.update(grams(t) if d in set(kind(1)) - set(tuning) else [])
        ratio = lambda g: np.log((target[g] + 0.5) / (target.total() + 2048)) - np.log((raw[g] + 0.5) / (raw.total() + 2048))
        score = {d: np.mean([ratio(g) for g in grams(t)]) if grams(t) else 0.0 for d, t in rows}
        long = {d for d, t in rows if len((t or "").split()) >= 50}
        cut = quality.choose_threshold(np.array([score[d] for d in tuning if d in long]), np.array([score[d] for d in bad if d in long]))
        assert abs(cut - model.threshold) < 1e-9
        repeats = {d: brute_base(t)[4] for d, t in rows}
        want = {(d, d in long and repeats[d] * 100 <= 50 * len(t.split()) and bool(score[d] >= cut)) for d, t in rows}
        assert got == want


def sum_of(gram):
    h = np.zeros(1, np.uint64)
    for w in gram:
        h = mix(h + digests([w.encode()]))
    return h


def test_ratio_keeps_good_and_drops_bad(spark):
    import random

    random.seed(3)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        ws = [random.choice(["alpha", "beta", "gamma", "delta"]) + str(random.randint(0, 400)) for _ in range(80)]
        rows.append((i, " | ".join(ws) if bad else " ".join(ws)))
        if i % 2 == 0:
            labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = quality.apply(docs, quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))).collect()
    assert all(r.kept == (r.doc_id % 4 != 0) for r in kept)
    empty = docs.limit(0)
    assert quality.apply(empty, quality.fit(empty, spark.createDataFrame(labels[:0], "doc_id long, quality int"))).count() == 0


def test_target_counts_all_good_documents(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "log_ratio", lambda raw, target, smooth: seen.append((raw, target)) or np.zeros(len(raw)))
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('w', id % 7) AS text").union(spark.sql("SELECT CAST(NULL AS LONG), 'w0'"))
    labels = spark.range(29_000).selectExpr("id AS doc_id", "CASE WHEN id % 29 = 0 THEN 0 ELSE 1 END AS quality")
    quality.fit(docs, labels.union(labels.limit(5)))
    raw, target = seen[0]
    assert raw.sum() == 30_001 and target.sum() == 28_000 - 2_000


def test_threshold_and_counts_of_all_labels(spark):
    """Every good document is trusted and every labelled one sets the threshold, a trusted one without its own n-grams; worked out word by word."""
    import random

    random.seed(5)
    rows = [(i, " ".join(random.choice("abcdefgh" if i % 3 else "efghijkl") + str(random.randint(0, 9)) for _ in range(random.randint(40, 90)))) for i in range(240)]
    rows += [(300, None), (301, ""), (None, "a1 b2 " * 30), (5, rows[5][1]), (8, rows[10][1])]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 240, 2)] + [(4, 1), (5, 1), (6, 1), (None, 1), (7, None), (9, 3), (300, 0), (999, 1)]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    good, bad = ({d for d, x in labels if x == q and d is not None} for q in (1, 0))
    place = lambda g: int((mix(sum_of(g) + np.uint64(len(g))) & np.uint64((1 << 12) - 1))[0])
    grams = [[place(w[i : i + n]) for w in [(t or "").split()] for n in (1, 2) for i in range(len(w) - n + 1)] for _, t in rows]
    raw, target = Counter(itertools.chain.from_iterable(grams)), Counter()
    for (d, _), own in zip(rows, grams, strict=True):
        target.update(own if d in good else [])
    ratio = lambda g, t: np.log((t[g] + 0.5) / (t.total() + 2048)) - np.log((raw[g] + 0.5) / (raw.total() + 2048))
    least = {}
    for (d, t), own in zip(rows, grams, strict=True):
        if len((t or "").split()) >= 50:
            told = target - Counter(own) if d in good else target
            least[d] = min(least.get(d, np.inf), np.mean([ratio(g, told) for g in own]))
    cut = quality.choose_threshold(*(np.array([least[d] for d in some if d in least]) for some in (good, bad)))
    for most in (0, 1 << 21):
        model = quality.fit(docs, known, bits=12, tuning_rows=None, most_ids=most)
        assert abs(cut - model.threshold) < 1e-9
        assert np.allclose(model.ratio, [ratio(g, target) for g in range(1 << 12)])
    for some in (known.limit(0), known.filter("quality = 1"), known.filter("quality = 0")):
        left = quality.fit(docs, some, bits=12, tuning_rows=None)
        assert np.isfinite(left.threshold) and (some.filter("quality = 1").count() > 0 or left.threshold == 0)
    assert quality.fit(docs.limit(0), known, bits=12, tuning_rows=None).threshold == 0


def test_threshold_of_a_table_is_that_of_arrays(spark):
    rng = np.random.default_rng(6)
    for good, bad in [(rng.normal(1, 1, 900).round(2), rng.normal(0, 1, 500).round(2)), (rng.normal(1, 1, 700), rng.normal(-1, 1, 40)), ([1.0], [2.0]), ([3.0, 3.0], [3.0]), ([1.0, 2.0], []), ([], [1.0]), ([], [])]:
        rows = [(float(x), 1, 0) for x in good] + [(float(x), 0, 1) for x in bad]
        table = spark.createDataFrame(rows, "score double, good int, bad int")
        for ranges in (1, 7):
            assert quality.threshold_of_all(table, ranges) == quality.choose_threshold(np.array(good), np.array(bad))


def test_left_out_scores_of_a_row_alone():
    texts = ["a b a b c", "", "c c c c", "x"]
    raw, target = np.arange(16.0) + 9, np.arange(16.0) % 5 + 4
    words = lambda some: Words(*flat(pa.array(some)))
    together = quality.left_out_scores(words(texts), raw, target, 0.5)
    assert together.tolist() == [quality.left_out_scores(words([t]), raw, target, 0.5)[0] for t in texts]


def test_query_sets_the_threshold_on_all_labels(spark, tmp_path):
    """Of 3,000 labels of either kind, of mixed quality, all count; a sample of 2,000 gives other verdicts."""
    from millrace.llm.queries import op5_ngram_ratio_quality

    rng = np.random.default_rng(7)
    ids = np.arange(6_000)
    texts = [" ".join(np.where(rng.random(60) < rng.normal(0.4 + 0.2 * (i % 2), 0.15), "g", "b") + rng.integers(0, 300, 60).astype(str).astype(object)) for i in ids]
    docs = spark.createDataFrame([(int(i), t) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string")
    labels = spark.createDataFrame([(int(i), int(i % 2)) for i in ids], "doc_id long, quality int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in op5_ngram_ratio_quality(spark, str(tmp_path)).filter("kept").collect()}
    words, good = Words(*flat(pa.array(texts))), ids % 2 == 1
    places = [np.concatenate(x) for x in zip(*quality.buckets(words, 16), strict=True)]
    raw, target = np.bincount(places[0], minlength=1 << 16), np.bincount(places[0][good[places[1]]], minlength=1 << 16)
    ratio = quality.log_ratio(raw, target, 0.5)
    cut = quality.choose_threshold(quality.left_out_scores(words, raw, target, 0.5)[good], quality.scores(words, ratio)[~good])
    assert kept == set(ids[quality.decide(words, quality.Model(ratio, cut))[3]].tolist())
    assert kept != {r.doc_id for r in quality.apply(docs, quality.fit(docs, labels)).filter("kept").collect()}


def test_ratio_is_the_brute_ratio():
    raw, target = np.array([10.0, 0, 5]), np.array([2.0, 0, 3])
    want = [np.log((t + 0.5) / (5 + 1.5)) - np.log((r + 0.5) / (15 + 1.5)) for r, t in zip(raw, target)]
    assert np.allclose(quality.log_ratio(raw, target, 0.5), want)


@given(st.lists(st.integers(1, 100), max_size=300))
@settings(max_examples=60, deadline=None)
def test_plan_places_every_piece(sizes):
    counts = Counter(sizes)
    p = packing.plan(dict(counts), 100)
    fills, seen = defaultdict(list), Counter()
    for size, n in counts.items():
        own = [i for i in range(len(p["length"])) if p["length"][i] == size]
        for rank in range(n):
            i = max(j for j in own if p["rank"][j] <= rank)
            inside = rank - p["rank"][i]
            fills[p["sequence"][i] + inside // p["each"][i]].append((p["offset"][i] + inside % p["each"][i] * size, size))
            seen[size] += 1
    assert seen == counts
    for own in fills.values():
        own.sort()
        assert own[0][0] == 0 and sum(s for _, s in own) <= 100
        assert all(own[k][0] + own[k][1] == own[k + 1][0] for k in range(len(own) - 1))
    greedy, rooms = 0, []
    for s in sorted(sizes, reverse=True):
        fit = [r for r in rooms if r >= s]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - s)
        else:
            greedy += 1
            rooms.append(100 - s)
    assert len(fills) <= greedy


def test_search_empties_sequences():
    p = packing.Patterns(10)
    p.put((6,), 100)
    p.put((5,), 100)
    p.put((4, 3), 100)
    p.put((2,), 100)
    n = sum(p.held.values())
    packing.local_search(p)
    assert sum(p.held.values()) < n and sum(sum(c) * m for c, m in p.held.items()) == 2000


def exchanges(p):
    """The exchanges of up to three pieces that would still help."""
    some = lambda c, most: {x for k in range(most + 1) for x in itertools.combinations(c, k)}
    left = [c for c in p.held if sum(c) < p.limit]
    for donor, receiver in itertools.product(left, left):
        if sum(receiver) >= sum(donor) and (receiver != donor or p.held[donor] > 1):
            for give, back in itertools.product(some(donor, 2) - {()}, some(receiver, 2)):
                if len(give) + len(back) <= 3 and 0 < sum(give) - sum(back) <= p.limit - sum(receiver):
                    yield donor, receiver, give, back


def test_search_exchanges_pairs_of_sequences_with_many_pieces():
    p = packing.Patterns(100)
    p.put((5,) * 19 + (3,), 1)
    p.put((12,), 1)  # only for two fives
    packing.local_search(p)
    assert dict(p.held) == {(12,) + (5,) * 17 + (3,): 1, (5, 5): 1}


def test_search_walks_past_unusable_offers():
    p = packing.Patterns(100)
    for c in [(50,), (51, 48), (52, 47), (53, 46), (45, 45)]:  # 50 goes to the last alone, and the nearest offers would gain nothing
        p.put(c, 1)
    packing.local_search(p)
    assert not list(exchanges(p))


@given(st.lists(st.integers(1, 40), max_size=120))
@settings(max_examples=80, deadline=None, derandomize=True)
def test_search_leaves_no_exchange(sizes):
    p = packing.best_fit(dict(Counter(sizes)), 100)
    packing.local_search(p)
    assert Counter(x for c, n in p.held.items() for x in c * n) == Counter(sizes)
    assert not list(exchanges(p))


def test_packed_documents(spark, odd_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    got = packing.pack_documents(odd_docs, JSON, 64, 2, keep_ids=True)
    rows = got.collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.collect()}
    reps = Counter(r.doc_id for r in odd_docs.collect())
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert set(by) == set(texts)
    for d, own in by.items():
        ids = t.encode(texts[d], add_special_tokens=False).ids + [2]
        want = []
        lo, hi = 0, (len(ids) - 1) % 64 + 1
        while lo < len(ids):
            want.append((len(want), lo, hi - lo, zlib.crc32(np.array(ids[lo:hi], "<u4").tobytes())))
            lo, hi = hi, hi + 64
        assert Counter((r.piece, r.start, r.length, r.ids_crc32) for r in own) == Counter(want * reps[d])
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length, r.ids))
    for own in seqs.values():
        own.sort()
        assert own[0][0] == 0 and sum(x[1] for x in own) <= 64
        assert all(own[k][0] + own[k][1] == own[k + 1][0] for k in range(len(own) - 1))
    whole = {r.sequence_id: r.ids for r in packing.sequences(got).collect()}
    assert whole == {k: [i for x in v for i in x[2]] for k, v in seqs.items()}
    assert packing.pack_documents(odd_docs.limit(0), JSON).count() == 0
