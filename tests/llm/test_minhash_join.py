"""Near duplicates against all pairs."""
import random
import re

from pyspark.sql import functions as F

from millrace.llm import minhash_join

from .conftest import thue_morse


def brute(rows, n, percent):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids = sorted(d for d in sets if d is not None)
    parent = {d: d for d in ids}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d), d == root(d)) for d in ids}


def corpus(seed=5, families=25):
    random.seed(seed)
    word = lambda: random.choice("abcdefgh") + str(random.randint(0, 300))
    rows = []
    for _ in range(families):
        base = [word() for _ in range(random.choice([1, 2, 4, 30, 120, 400]))]
        chain = list(base)
        for k in range(random.choice([1, 3, 8])):
            rows.append(" ".join(chain))
            if k % 3 == 2:
                rows.append(" \t".join(x.upper() for x in chain))
            for _ in range(random.choice([1, 1, 2, 4])):
                chain[random.randrange(len(chain))] = word()
    shared = " ".join(word() for _ in range(60))
    rows += [shared + " " + " ".join(word() for _ in range(random.randint(3, 60))) for _ in range(60)]
    rows += ["", " \n", None]
    ids = random.sample(range(10_000), len(rows))
    return list(zip(ids, rows))


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"rep": F.lit("clash"), "key": F.lit(1), "label": F.lit(2)})
    got = minhash_join.near_duplicates(df, **more).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}, len(got)


def test_three_words_at_85(spark):
    rows = corpus()
    got, n = run(spark, rows, n=3, percent=85)
    assert n == len(rows) and got == brute(rows, 3, 85)


def test_only_exhaustive_in_small_blocks(spark):
    rows = corpus(6, 12)
    got, _ = run(spark, rows, n=3, percent=85, leaders=False, block=5)
    assert got == brute(rows, 3, 85)


def test_five_words_at_80(spark):
    rows = corpus(7, 12)
    got, _ = run(spark, rows, n=5, percent=80, block_shingles=600)
    assert got == brute(rows, 5, 80)


def test_copies_that_resemble_only_their_original(spark):
    """Links run through the original, which is not the smallest id; nothing else links the family."""
    random.seed(8)
    base = [f"w{i}" for i in range(200)]
    rows = [(500, " ".join(base))]
    for k in range(60):
        copy = list(base)
        for at in random.sample(range(0, 200, 4), 4):
            copy[at] = f"x{k}_{at}"
        rows.append((k, " ".join(copy)))
    rows += [(1000 + k, " ".join(base[:100] + [f"y{k}_{i}" for i in range(100)])) for k in range(30)]
    got, _ = run(spark, rows, n=3, percent=85)
    assert got == brute(rows, 3, 85) and got[500][1] == 0


def test_hash_equal_words(spark):
    """The Thue-Morse word and its complement, which polynomial hashes modulo 2**64 cannot tell apart."""
    one, two = thue_morse()
    filler = [f"w{i}" for i in range(6)]
    rows = [(1, one), (2, two), (3, " ".join([one] * 4)), (4, " ".join([two] * 4)), (5, " ".join(filler + [one])), (6, " ".join(filler + [two])), (7, f"{one} {two} {one}")]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash_join.near_duplicates(df, n=3, percent=85).collect()}
        assert got == brute(rows, 3, 85)


def test_odd_rows(spark, odd_docs):
    got = minhash_join.near_duplicates(odd_docs, n=3, percent=85)
    rows = got.collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == {6: 5}.get(r.doc_id, r.doc_id) and r.kept == (r.doc_id == r.component_id)
    assert minhash_join.near_duplicates(odd_docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = minhash_join.components(edges).collect()
    assert len(got) == 201 and all(r.label == 0 for r in got)
