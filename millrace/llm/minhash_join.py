"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document is its set of word shingles.  Documents with the same words in the same order are
one class from the start; a class is named by its smallest id.  A signature has 32 minima of
16 bits, packed into 8 chunks of 4.  Two signatures that differ in at most 15 places have, by
pigeonhole, a chunk with at most one difference, so with the keys "chunk without place p", for
every chunk and p, all such pairs meet in a bucket.  (At the threshold of 0.85 a pair differs
in 4.8 places on average, and fails to meet with a chance of 2e-8; at 0.8 of 1e-6.)

Pairs are never listed.  Of buckets with the same members one is kept.  First every class is
tried against the smallest of each of its buckets, all classes of one such leader in a task;
links are confirmed on the full sets of shingles, compared word by word, and components are
joined.  Buckets that still hold several components are then compared exhaustively, in blocks,
across components only: by signature first, which tells who has a partner there at all, and
then on the full sets.  A pair belongs to the first bucket it shares, so it is compared once,
and a task returns only the links that join components, fewer than its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import blocks, flat
from .runtime import release, settle, ship
from .words import Words

CHUNKS, PLACES = 8, 4
#: Pairs that meet in a bucket and differ in more places than this are not tried: the chance of more is 2e-8 at a similarity of 0.85, 7e-6 at 0.8.
MOST_APART = 17
#: Classes, and shingles, of a bucket that make a block; a task compares two blocks at a time.
BLOCK, BLOCK_SHINGLES = 2048, 400_000

_SEED = np.random.default_rng(20240229)
FLIP = _SEED.integers(0, 1 << 63, CHUNKS * PLACES, dtype=np.uint64) * np.uint64(2)
TIMES = _SEED.integers(0, 1 << 63, CHUNKS * PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_C = [f"c{i}" for i in range(CHUNKS)]


def sketches(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_shingles, words, d1, d2, c0..c7``: the sizes, a 128-bit digest of the sequence of words, and the signature."""
    ship(docs.sparkSession)

    def sketch(batches):
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for a, b in blocks(data, offsets):
                words = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower=True)
                rows, counts = words.n_rows, words.counts
                key, _, top = words.numbered_in_rows(n)
                size = np.bincount(np.unique(key) // top, minlength=rows)
                size[(counts > 0) & (counts < n)] = 1
                told = b"".join([hashlib.blake2b(b" ".join(w), digest_size=16).digest() for w in words.by_row])
                d = np.frombuffer(told, np.int64).reshape(rows, 2)
                h, at = words.windows(n)
                sig, full = np.zeros((CHUNKS, rows), np.uint64), np.flatnonzero(counts >= n)
                if len(full):
                    starts = np.searchsorted(words.rows[at], full)
                    for i in range(CHUNKS * PLACES):
                        low = np.minimum.reduceat((h ^ FLIP[i]) * TIMES[i], starts) >> np.uint64(7) & np.uint64(0xFFFF)
                        sig[i // PLACES, full] |= low << np.uint64(16 * (i % PLACES))
                cols = [batch.column(0).slice(a, rows), pa.array(size), pa.array(counts), pa.array(d[:, 0]), pa.array(d[:, 1]), *(pa.array(x.view(np.int64)) for x in sig)]
                yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", "n_shingles", "words", "d1", "d2", *_C)])
    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(sketch, schema)


def bucket_keys() -> Column:
    """The 32 keys of a signature: which chunk and place (from bit 48 on), and the chunk's other places."""
    keys = []
    for i in range(CHUNKS):
        c = F.col(f"c{i}")
        for p in range(PLACES):
            low = c.bitwiseAND(F.lit((1 << 16 * p) - 1))
            high = F.shiftleft(F.shiftrightunsigned(c, 16 * (p + 1)), 16 * p) if p < PLACES - 1 else F.lit(0)
            keys.append(low.bitwiseOR(high).bitwiseOR(F.lit((i * PLACES + p) << 48)))
    return F.array(*keys)


def places_apart(a: str, b: str) -> Column:
    """In how many places two signatures differ."""
    out = F.lit(0)
    for i in range(CHUNKS):
        x = F.col(f"{a}.c{i}").bitwiseXOR(F.col(f"{b}.c{i}"))
        for p in range(PLACES):
            out = out + (x.bitwiseAND(F.lit(((0xFFFF << 16 * p) + (1 << 63)) % (1 << 64) - (1 << 63))) != 0).cast("int")
    return out


def near_enough(x: Column, y: Column, percent: int) -> Column:
    """Whether the sizes allow the similarity."""
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


class Sets:
    """The shingle sets of some texts, with numbers for shingles; equal numbers are equal shingles."""

    def __init__(self, texts, n: int):
        data, offsets = flat(texts)
        words = Words(data, offsets, lower=True)
        key, _, top = words.numbered_in_rows(n)
        key = np.unique(key)
        self.ends = np.searchsorted(key // top, np.arange(words.n_rows + 1))
        some, self.numbers = np.unique(key % top, return_inverse=True)
        self.sizes = np.diff(self.ends)
        self._mark = np.zeros(len(some) + 1, bool)

    def similar(self, p: int, q: np.ndarray, percent: int) -> np.ndarray:
        """Which of the rows ``q`` are similar enough to row ``p``."""
        own, mark = self.numbers[self.ends[p] : self.ends[p + 1]], self._mark
        sizes = self.sizes[q]
        ends = np.cumsum(sizes)
        at = np.repeat(self.ends[q] - ends + sizes, sizes) + np.arange(ends[-1] if len(q) else 0)
        mark[own] = True
        hits = np.concatenate([[0], np.cumsum(mark[self.numbers[at]])])
        mark[own] = False
        both = hits[ends] - hits[ends - sizes]
        return (both > 0) & (100 * both >= percent * (len(own) + sizes - both))


def grouped(batches, keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` columns, over the ends of batches."""
    held, last = [], None
    for b in batches:
        if not len(b):
            continue
        own = np.stack([np.asarray(b.column(i)).astype(np.int64) for i in range(keys)])
        edges = np.flatnonzero((own[:, 1:] != own[:, :-1]).any(0)) + 1
        for lo, hi in pairwise([0, *edges.tolist(), len(b)]):
            key = own[:, lo].tolist()
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def links_to_leaders(tried: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ``tried`` (a, b, blocks) that are similar enough; all partners of an ``a`` in as many tasks as blocks."""
    led = tried.select(F.col("a").alias("g"), F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("x"), F.lit(False).alias("lead"), F.col("b").alias("rep"))
    leaders = led.select("g", "x").distinct().select("g", "x", F.lit(True).alias("lead"), F.col("g").alias("rep"))
    dealt = led.union(leaders).join(texts.hint("merge"), "rep").select("g", "x", "lead", "rep", "t").repartition("g", "x").sortWithinPartitions("g", "x")

    def confirm(batches):
        for group in grouped(batches, 2):
            sets, lead = Sets(group.column("t"), n), np.asarray(group.column("lead"))
            rep, rest = np.asarray(group.column("rep")), np.flatnonzero(~lead)
            good = np.zeros(len(rest), bool)
            for p in np.flatnonzero(lead).tolist():
                good |= sets.similar(p, rest, percent)
            b = np.unique(rep[rest[good]])
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b), rep[lead][0])), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(confirm, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for the nodes of ``edges`` (a, b): the smallest node each can reach.

    Alternates the large-star and small-star operations until nothing moves; every round is
    a few joins on the edges, of which there are never more than nodes and first edges.
    """
    now = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: every smaller neighbour, and the node, are tied to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        past, now = now, settle(small, "stars")
        release(past)
        told = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(told) == mark:
            break
        mark = tuple(told)
    out = settle(now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v").distinct().select("v", "v")), "components")
    release(now)
    return out


def near_duplicates(
    docs: DataFrame,
    n: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    leaders: bool = True,
    block: int = BLOCK,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when 100 * |intersection| >= ``percent`` * |union| of their sets of
    ``n``-word shingles (words lower-cased in A-Z; fewer than ``n`` words make one shingle).
    ``component_id`` is the smallest id reachable, ``kept`` whether that is the row's own.  A
    text that is null or has no words is linked with nothing; so is a row without an id, whose
    ``component_id`` is null and which is kept.  Repeated rows are reported as often as they
    come; rows that share an id but not a text are one document to the links.  Very long texts
    are read whole.  Ids are integers.  Extra columns are ignored; an empty table gives no rows.
    """
    held = settle(sketches(docs, n, id_col, text_col), "sketches")
    shared = held.filter("words > 0 AND doc_id IS NOT NULL")
    classes = settle(shared.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), *(F.min(c).alias(c) for c in ("n_shingles", "words", *_C))), "classes")
    # what has fewer than n words is linked with its own class only
    small = classes.filter(F.col("words") >= n).select("rep", "n_shingles", *_C)
    members = small.select("rep", "n_shingles", F.explode(bucket_keys()).alias("key"))
    sums = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"s{k}") for k in range(2)]
    buckets = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("leader"), F.sum("n_shingles").alias("w"), *sums).filter("n > 1")
    # of buckets with the same members the one with the smallest key stays
    buckets = buckets.groupBy("n", "s0", "s1").agg(F.min(F.struct("key", "leader", "w")).alias("b")).select("n", "b.*")
    cut = F.greatest(F.ceil(F.col("n") / F.lit(block)), F.ceil(F.col("w") / F.lit(block_shingles))).cast("int").alias("blocks")
    crowd = settle(members.select("key", "rep").join(buckets.select("key", "n", "leader", cut).hint("merge"), "key").select("key", "rep", "leader", "n", "blocks"), "buckets")
    wanted = crowd.select("rep").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("t")).join(wanted.hint("merge"), "rep", "left_semi")
    texts = settle(texts, "texts")
    links, labels = [], None
    if leaders:
        pairs = crowd.filter("rep <> leader").groupBy(F.col("leader").alias("a"), F.col("rep").alias("b")).agg(F.max("blocks").alias("blocks"))
        x = pairs.join(small.alias("x"), F.col("a") == F.col("x.rep")).join(small.alias("y"), F.col("b") == F.col("y.rep"))
        x = x.filter(near_enough(F.col("x.n_shingles"), F.col("y.n_shingles"), percent) & (places_apart("x", "y") <= MOST_APART))
        tried = settle(x.select("a", "b", "blocks").distinct(), "tried")
        links.append(settle(links_to_leaders(tried, texts, n, percent), "links"))
        labels = components(links[0])
        release(tried)
    # of a bucket of two the one pair has been tried by now
    left = _open(crowd.filter("n > 2") if leaders else crowd, labels)
    left = settle(_dealt(left, small).mapInArrow(lambda bs: _with_partners(bs, percent, leaders), _PARTNERS), "open")
    release(crowd)
    if not left.isEmpty():
        dealt = left.join(texts.hint("merge"), "rep").select("key", "x", "y", *[c for c in left.columns if c not in ("key", "x", "y")], "t")
        dealt = dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        links.append(settle(dealt.mapInArrow(lambda bs: _links_across(bs, n, percent, leaders), "a long, b long").distinct(), "links"))
        release(labels)
        labels = components(links[0].union(links[-1]) if len(links) > 1 else links[0])
    release(left, texts, *links)
    of_class = classes.select("d1", "d2", "rep")
    if labels is not None:
        of_class = of_class.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("label", "rep").alias("class_label"))
    else:
        of_class = of_class.withColumnRenamed("rep", "class_label")
    out = held.select("doc_id", "n_shingles", "words", "d1", "d2").alias("d").join(of_class.alias("k"), (F.col("d.d1") == F.col("k.d1")) & (F.col("d.d2") == F.col("k.d2")), "left")
    # texts without words share a digest but not a class
    component = F.when(F.col("d.doc_id").isNull(), F.lit(None)).when(F.col("d.words") == 0, F.col("d.doc_id")).otherwise(F.coalesce("k.class_label", "d.doc_id"))
    return out.select(F.col("d.doc_id").alias("doc_id"), F.col("d.n_shingles").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def _open(crowd: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members (key, rep, leader, blocks, label) of the buckets that hold several components."""
    if labels is None:
        return crowd.select("key", "rep", "leader", "blocks", F.col("rep").alias("label"))
    told = crowd.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "leader", "blocks", F.coalesce("label", "rep").alias("label"))
    several = told.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    # settled, so that a large bucket is a skewed side of a plain join, which can be split
    return told.join(settle(several, "open-keys").hint("merge"), "key", "left_semi")


_FIELDS = ["key", "x", "y", "own", "rep", "leader", "label", "n_shingles", *_C]
_PARTNERS = T.StructType([T.StructField(c, T.LongType()) for c in _FIELDS])


def _dealt(open_: DataFrame, small: DataFrame) -> DataFrame:
    """Members dealt to groups (key, x, y): a bucket is cut into blocks, and every two of them (and each with itself) are one group."""
    cut = open_.join(small, "rep").withColumn("own", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")).cast("long"))
    dealt = cut.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("other"))
    dealt = dealt.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")}).select(*_FIELDS)
    return dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


class _Members:
    """The numbers of a group, and which later rows are to be compared with a row."""

    def __init__(self, group: pa.Table, percent: int, leaders_tried: bool):
        cols = {c: np.asarray(group.column(c)) for c in _FIELDS}
        self.rep, self.label, self.size, self.own = cols["rep"], cols["label"].copy(), cols["n_shingles"], cols["own"]
        self.sig = np.stack([cols[c] for c in _C], 1).view(np.uint16)
        self.across = int(cols["x"][0]) != int(cols["y"][0])
        self.bucket, self.percent = int(cols["key"][0]) >> 48, percent
        self.led = leaders_tried & (self.rep == cols["leader"])

    def partners(self, p: int) -> np.ndarray:
        """Later rows of another component that may be similar to row ``p`` and share no earlier bucket with it."""
        if self.led[p]:
            return np.zeros(0, np.int64)
        least, most = self.size[p] * self.percent, self.size[p] * 100
        good = (self.label[p + 1 :] != self.label[p]) & ~self.led[p + 1 :] & (self.size[p + 1 :] * 100 >= least) & (self.size[p + 1 :] * self.percent <= most)
        if self.across:
            good &= self.own[p + 1 :] != self.own[p]
        q = np.flatnonzero(good) + p + 1
        same = self.sig[q] == self.sig[p]
        near = same.sum(1) >= CHUNKS * PLACES - MOST_APART
        q, same = q[near], same[near].reshape(-1, CHUNKS, PLACES)
        if not len(q):
            return q
        met = same.sum(2)
        chunk = (met >= PLACES - 1).argmax(1)
        place = same[np.arange(len(q)), chunk].argmin(1)  # where they differ, or the first
        return q[chunk * PLACES + place == self.bucket]


def _with_partners(batches, percent: int, leaders_tried: bool):
    """The rows of each group that have a partner there."""
    for group in grouped(batches, 3):
        own = _Members(group, percent, leaders_tried)
        has = np.zeros(len(group), bool)
        for p in range(len(group) - 1):
            q = own.partners(p)
            if len(q):
                has[p] = True
                has[q] = True
        if has.any():
            yield from group.filter(pa.array(has)).cast(pa.schema([(c, pa.int64()) for c in _FIELDS])).to_batches()


def _links_across(batches, n: int, percent: int, leaders_tried: bool):
    """Links (a, b) that join the components of each group, no more than it takes."""
    for group in grouped(batches, 3):
        own, sets = _Members(group, percent, leaders_tried), Sets(group.column("t"), n)
        a, b = [], []
        for p in range(len(group) - 1):
            q = own.partners(p)
            q = q[sets.similar(p, q, percent)] if len(q) else q
            for k in q.tolist():
                if own.label[k] != own.label[p]:
                    own.label[own.label == own.label[k]] = own.label[p]
                    a.append(int(own.rep[p]))
                    b.append(int(own.rep[k]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
