"""Packing token pieces into sequences: best fit, then a swap-based local search.

Pieces of one length are interchangeable, so all the choices are made on the histogram of
lengths, which has at most ``limit`` entries however many documents there are.  Sequences
with the same contents are one *pattern* with a multiplicity; best fit decreasing makes the
patterns, and the local search exchanges pieces between underfull patterns (one for one, two
for one, or a plain move), each step raising the sum of squared fills, until sequences empty
or nothing helps.  Every piece then finds its place by its rank among the pieces of its
length: no text and no token is shuffled.
"""

from __future__ import annotations

import itertools
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .columns import flat
from .runtime import settle, ship
from .token_counts import SPECIAL, around_special, encoder, tokenizer

#: Pieces of one length are ranked in buckets of about so many rows or fewer.
BUCKET_ROWS = 4096


def token_pieces(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, with ``keep_ids``, ``ids``.

    A document's ids are those of its whole text and ``end_id``.  Up to ``limit`` ids are one
    piece; more are cut into pieces of exactly ``limit`` ids, but for a shorter first one.
    """
    ship(docs.sparkSession)

    def cut(batches):
        enc = encoder(tokenizer_path, False)
        special = tokenizer(tokenizer_path).token_to_id(SPECIAL)
        for b in batches:
            segments, rows = around_special(b.column(1))
            for first, ids, ends in _documents(enc.ids(*flat(segments)), rows, special, len(b)):
                at, piece, start, length, crc, lists = [], [], [], [], [], []
                for k in range(len(ends) - 1):
                    own = np.append(ids[ends[k] : ends[k + 1]], np.uint32(end_id)).astype("<u4")
                    lo, hi, n = 0, (len(own) - 1) % limit + 1, 0
                    while lo < len(own):
                        at.append(first + k)
                        piece.append(n)
                        start.append(lo)
                        length.append(hi - lo)
                        crc.append(zlib.crc32(own[lo:hi]))
                        if keep_ids:
                            lists.append(own[lo:hi].astype(np.int32))
                        lo, hi, n = hi, hi + limit, n + 1
                cols = [b.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:
                    cols.append(pa.array(lists, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType())]
    fields += [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids)
    return docs.select(id_col, text_col).mapInArrow(cut, schema)


def _documents(found, rows: np.ndarray | None, special: int, total: int):
    """Blocks of whole documents from blocks of segments, the added token back at each cut."""
    if rows is None:
        yield from found
        return
    held: list[list[np.ndarray]] = [[] for _ in range(total)]
    for first, ids, ends in found:
        for k in range(len(ends) - 1):
            own = held[rows[first + k]]
            if own:
                own.append(np.array([special], np.uint32))
            own.append(ids[ends[k] : ends[k + 1]])
    whole = [np.concatenate(x) if x else np.zeros(0, np.uint32) for x in held]
    yield 0, np.concatenate([*whole, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in whole])]).astype(np.int64)


class Patterns:
    """Sequences by their contents: ``held[contents] = multiplicity``; contents is a descending tuple of lengths."""

    def __init__(self, limit: int):
        self.limit = limit
        self.held: dict[tuple[int, ...], int] = defaultdict(int)

    def put(self, contents, n: int) -> None:
        if n and contents:
            self.held[tuple(sorted(contents, reverse=True))] += n

    def take(self, contents: tuple[int, ...], n: int) -> None:
        self.held[contents] -= n
        if not self.held[contents]:
            del self.held[contents]


def best_fit(counts: dict[int, int], limit: int) -> Patterns:
    """Best fit decreasing on a histogram of lengths: whole groups of like sequences at a time."""
    by_room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    rooms: list[int] = []

    def put(contents: tuple[int, ...], room: int, n: int) -> None:
        if not n:
            return
        if room not in by_room:
            insort(rooms, room)
        by_room[room][contents] += n

    for size in sorted((s for s in counts if counts[s] > 0), reverse=True):
        left = counts[size]
        i = bisect_left(rooms, size)
        while left and i < len(rooms):
            room = rooms.pop(i)
            fit, kept = room // size, {}
            for contents, n in by_room.pop(room).items():
                full = min(n, left // fit)
                put(contents + (size,) * fit, room - size * fit, full)
                left -= full * fit
                if full < n and left:  # fewer than fit of them: one more sequence takes them all
                    put(contents + (size,) * left, room - size * left, 1)
                    left, full = 0, full + 1
                if full < n:
                    kept[contents] = n - full
            for contents, n in kept.items():
                put(contents, room, n)
            i = bisect_left(rooms, size) if not kept else bisect_left(rooms, room) + 1
            # rooms that now hold less than size are behind i; what was just filled is no candidate
        fit = limit // size
        put((size,) * fit, limit - size * fit, left // fit)
        if left % fit:
            put((size,) * (left % fit), limit - size * (left % fit), 1)
    out = Patterns(limit)
    for own in by_room.values():
        for contents, n in own.items():
            out.put(contents, n)
    return out


def local_search(patterns: Patterns, passes: int | None = 40, steps: int | None = 60_000) -> int:
    """Exchange pieces between underfull sequences while squared fill rises; returns the steps made.

    A donor, emptiest first, gives a piece to a receiver that is at least as full: as a plain
    move into its room, for one smaller piece of the receiver, for two, or two pieces for one
    of the receiver's.  The exchange that leaves the receiver least room is taken, and is made
    for as many like pairs of sequences as there are.  ``passes`` and ``steps`` bound the
    driver's time; they bound how far the packing is improved, never what is packed, and with
    None for both the search goes on until no exchange helps.
    """
    limit, made = patterns.limit, 0
    steps = float("inf") if steps is None else steps
    for _ in itertools.count() if passes is None else range(passes):
        under = sorted((c for c in patterns.held if sum(c) < limit), key=sum)
        # offers[k][s]: receivers that can take s more for what they give back, one piece at most (k = 0) or two (k = 1), by their room
        offers: tuple[dict, dict] = (defaultdict(list), defaultdict(list))
        for c in under:
            room = limit - sum(c)
            for back in ((), *((a,) for a in dict.fromkeys(c)), *_pairs(c)):
                offers[len(back) > 1][room + sum(back)].append((room, c, back))
        for own in offers:
            for some in own.values():
                some.sort()
        keys = [sorted(own) for own in offers]
        before = made
        for donor in under:
            while patterns.held.get(donor, 0) and made < steps:
                best = _best_exchange(patterns, donor, offers, keys)
                if best is None:
                    break
                give, receiver, back = best
                n = patterns.held[receiver] // 2 if receiver == donor else min(patterns.held[receiver], patterns.held[donor])
                patterns.take(receiver, n)
                patterns.take(donor, n)
                patterns.put(_without(receiver, back) + give, n)
                patterns.put(_without(donor, give) + back, n)
                made += 1
        if made == before or made >= steps:
            break
    return made


def _best_exchange(patterns: Patterns, donor: tuple[int, ...], offers, keys):
    """The pieces to give, the receiver and what it gives back that leave the receiver least room, then gain most; None if nothing helps."""
    room, best, rank = patterns.limit - sum(donor), None, (patterns.limit, 0)
    for give in (*((x,) for x in dict.fromkeys(donor)), *_pairs(donor)):
        size = sum(give)
        for k in range(3 - len(give)):  # three pieces change places at most
            for at in range(bisect_left(keys[k], size), len(keys[k])):
                left = keys[k][at] - size  # the receiver's room afterwards
                if left >= room or left > rank[0]:  # a receiver has no more room than the donor, and must lose some
                    break
                some = offers[k][keys[k][at]]
                i = bisect_left(some, (room + 1,))
                while i and some[i - 1][0] > left:
                    i -= 1
                    own, receiver, back = some[i]
                    n = patterns.held.get(receiver, 0)
                    if not n:
                        del some[i]
                        continue
                    if receiver == donor and n < 2:
                        continue
                    if (left, left - own) < rank:
                        best, rank = (give, receiver, back), (left, left - own)
                    break
    return best


def _pairs(contents: tuple[int, ...]) -> list[tuple[int, int]]:
    """The different pairs of pieces of a descending tuple of lengths; the lengths tell pieces apart, not their places."""
    kinds = list(dict.fromkeys(contents))
    return [(a, b) for i, a in enumerate(kinds) for b in kinds[i:] if a != b or contents.count(a) > 1]


def _without(contents: tuple[int, ...], some: tuple[int, ...]) -> tuple[int, ...]:
    left = list(contents)
    for x in some:
        left.remove(x)
    return tuple(left)


def plan(counts: dict[int, int], limit: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: runs of ranks, by length, as arrays.

    A run starts at rank ``rank`` of its length; of its sequences, numbered from ``sequence``,
    each takes ``each`` pieces of that length, the first at ``offset``.
    """
    patterns = best_fit(counts, limit)
    local_search(patterns)
    runs, used, sequence = [], defaultdict(int), 0
    for contents, n in sorted(patterns.held.items(), reverse=True):
        offset = 0
        for size in dict.fromkeys(contents):
            each = contents.count(size)
            runs.append((size, used[size], each, sequence, offset))
            used[size] += n * each
            offset += each * size
        sequence += n
    assert used == {s: n for s, n in counts.items() if n}
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return {k: table[:, i] for i, k in enumerate(("length", "rank", "each", "sequence", "offset"))} | {"sequences": sequence}


def pack(pieces: DataFrame, limit: int = 1024) -> DataFrame:
    """``pieces`` (a settled table) with ``sequence_id`` and ``offset``.

    Every row gets a place, repeated rows too; an empty table gives no rows.
    """
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``limit`` rows
    held = spark.sparkContext.broadcast(plan(counts, limit))
    buckets = max(1, -(-sum(counts.values()) // BUCKET_ROWS))
    keyed = pieces.withColumn("b", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    base = keyed.groupBy("length", "b").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = base.select("length", "b", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "b").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = keyed.withColumn("at", rank).join(base, ["length", "b"]).withColumn("rank", F.col("before") + F.col("at") - 1)
    ranked = ranked.select(*pieces.columns, "rank")

    def place(batches):
        p = held.value
        key = p["length"] << 44 | p["rank"]
        for b in batches:
            length, rank = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("length", "rank"))
            i = np.searchsorted(key, length << 44 | rank, "right") - 1
            inside = rank - p["rank"][i]
            sequence = p["sequence"][i] + inside // p["each"][i]
            offset = p["offset"][i] + inside % p["each"][i] * length
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sequence), pa.array(offset)], names=schema.fieldNames())

    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, limit: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places, one row per piece.

    A null text is empty (one piece with ``end_id`` alone); very long texts are cut, never
    shortened; ids may be null or repeat; other columns are ignored; an empty table gives no rows.
    """
    return pack(settle(token_pieces(docs, tokenizer_path, limit, end_id, id_col, text_col, keep_ids), "pieces"), limit)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, ids`` from packed pieces that kept their ids: the training sequences themselves."""
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return held.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))
