"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in segments of ``SEGMENT``, forwards and backwards; both states
at a byte give the probabilities of that position's language, and the mean over all positions
of the whole text is the document's.  It is trained here, in numpy, by backpropagation through
time on a bounded sample of labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import blocks, flat
from .pretokens import LETTER, classes
from .runtime import ship

SEGMENT, PAD, UNKNOWN = 64, 256, "und"
#: Segments that a training sees, counting repeats.
SEEN = 30_000


def _gates(x, h, u, size):
    """One step: the next state, and what the backward pass needs.  States are (size, batch)."""
    g = u @ h
    zr = np.tanh(x[: 2 * size] + g[: 2 * size])
    zr *= np.float32(0.5)
    zr += np.float32(0.5)
    z, r = zr[:size], zr[size:]
    n = np.tanh(x[2 * size :] + r * g[2 * size :])
    return n + z * (h - n), z, r, n, g[2 * size :]


@dataclass
class Network:
    """Weights: for each direction ``w`` (3 * size, 257) and ``u`` (3 * size, size), then ``v`` and ``c`` to the languages.

    Rows of ``w`` and ``u`` are the update gate, the reset gate and the candidate; the gates'
    rows are halved, so that tanh gives the logistic function.
    """

    languages: list[str]
    size: int = 10
    w: list[np.ndarray] = field(default_factory=list)
    u: list[np.ndarray] = field(default_factory=list)
    v: np.ndarray | None = None
    c: np.ndarray | None = None

    @classmethod
    def start(cls, languages: list[str], size: int, rng: np.random.Generator) -> Network:
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        return cls(languages, size, [draw(3 * size, 257) for _ in range(2)], [draw(3 * size, size) for _ in range(2)], draw(len(languages), 2 * size), np.zeros((len(languages), 1), np.float32))

    def states(self, x: np.ndarray) -> np.ndarray:
        """States (time, 2 * size, batch) for bytes (time, batch), in reused buffers."""
        t, b = x.shape
        k = self.size
        out = np.empty((t, 2 * k, b), np.float32)
        a, g = np.empty((3 * k, b), np.float32), np.empty((3 * k, b), np.float32)
        for d in range(2):
            h = np.zeros((k, b), np.float32)
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                np.take(self.w[d], x[i], axis=1, out=a, mode="clip")
                np.matmul(self.u[d], h, out=g)
                gates, n, old = a[: 2 * k], a[2 * k :], g[2 * k :]
                gates += g[: 2 * k]
                np.tanh(gates, out=gates)
                gates *= np.float32(0.5)
                gates += np.float32(0.5)
                old *= gates[k:]
                n += old
                np.tanh(n, out=n)
                new = out[i, d * k : (d + 1) * k]
                np.subtract(h, n, out=new)
                new *= gates[:k]
                new += n
                h = new
        return out

    def remembered(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """The states, and for each direction what every step needs to go back."""
        t, b = x.shape
        out, keep = np.empty((t, 2 * self.size, b), self.v.dtype), []
        for d in range(2):
            h, steps = np.zeros((self.size, b), self.v.dtype), []
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                old = h
                h, *held = _gates(self.w[d].take(x[i], axis=1), h, self.u[d], self.size)
                out[i, d * self.size : (d + 1) * self.size] = h
                steps.append((i, old, *held))
            keep.append(steps)
        return out, keep

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities (time, languages, batch) of every position."""
        s = np.matmul(self.v, self.states(x)) + self.c
        s -= s.max(1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(1, keepdims=True)
        return s

    def gradients(self, x: np.ndarray, y: np.ndarray):
        """Mean cross entropy over the positions that are no padding, and its gradients."""
        states, keep = self.remembered(x)
        s = np.matmul(self.v, states) + self.c
        s -= s.max(1, keepdims=True)
        p = np.exp(s)
        p /= p.sum(1, keepdims=True)
        mask = (x != PAD).astype(np.float32)[:, None, :] / max(1, int((x != PAD).sum()))
        right = np.arange(len(self.languages))[:, None] == y
        loss = -(np.log(np.maximum(p, 1e-9)) * right * mask).sum()
        ds = (p - right) * mask
        dv = np.einsum("tlb,thb->lh", ds, states, optimize=True)
        dstate = np.matmul(self.v.T, ds)
        k, dws, dus = self.size, [], []
        for d in range(2):
            dw, du = np.zeros_like(self.w[d]), np.zeros_like(self.u[d])
            carry = np.zeros((k, x.shape[1]), np.float32)
            for i, old, z, r, n, gn in reversed(keep[d]):
                dh = carry + dstate[i, d * k : (d + 1) * k]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (old - n) * z * (1 - z) * 2  # the gates' inputs are halved
                dr = dn * gn * r * (1 - r) * 2
                da = np.concatenate([dz, dr, dn])
                dg = np.concatenate([dz, dr, dn * r])
                carry = dh * z + self.u[d].T @ dg
                du += dg @ old.T
                np.add.at(dw.T, x[i], da.T)
            dws.append(dw)
            dus.append(du)
        return loss, [*dws, *dus, dv, ds.sum((0, 2))[:, None]]

    @property
    def parameters(self) -> list[np.ndarray]:
        return [*self.w, *self.u, self.v, self.c]


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows cut into segments (SEGMENT, n), padded at the end of a row, and the row of each."""
    sizes = np.diff(offsets)
    n = -(-sizes // SEGMENT)
    rows = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
    starts = offsets[rows] + k * SEGMENT
    at = starts + np.arange(SEGMENT)[:, None]
    real = at < offsets[rows + 1]
    x = np.full(at.shape, PAD, np.int64)
    x[real] = data[at[real]]
    return x, rows


def train(texts: list[str], languages: list[str], size: int = 10, epochs: int | None = None, batch: int = 128, rate: float = 0.01, seed: int = 7) -> Network:
    """A network for the given labelled texts: Adam over all their segments.

    Unless told, they are gone through as often as makes about SEEN segments, 2 to 6 times.
    """
    rng = np.random.default_rng(seed)
    names = sorted(set(languages))
    net = Network.start(names, size, rng)
    if len(names) < 2:
        return net
    data, offsets = flat(pa.array(texts, pa.large_string()))
    x, rows = segments(data, offsets)
    y = np.array([names.index(s) for s in languages])[rows]
    if not len(y):
        return net
    first, second = ([np.zeros_like(p) for p in net.parameters] for _ in range(2))
    epochs = min(6, max(2, -(-SEEN // len(y)))) if epochs is None else epochs
    step, total = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            own = order[lo : lo + batch]
            _, gs = net.gradients(x[:, own], y[own])
            norm = np.sqrt(sum(float((g * g).sum()) for g in gs))
            step += 1
            now = rate * min(1.0, 2.0 * (1 - step / (total + 1)))
            for p, g, a, b in zip(net.parameters, gs, first, second, strict=True):
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray, block: int = 1024) -> np.ndarray:
    """Mean position probabilities (rows, languages); zeros for an empty row."""
    n, k = len(offsets) - 1, len(net.languages)
    total = np.zeros((n, k))
    most = block * SEGMENT * 16  # bytes of text at a time
    for a, b, part, cut in _pieces(data, offsets, most):
        x, rows = segments(part, cut)
        for lo in range(0, x.shape[1], block):
            own = np.ascontiguousarray(x[:, lo : lo + block])
            p = net.probabilities(own)
            p *= (own != PAD)[:, None, :]
            sums = p.sum(0)
            for j in range(k):
                total[a:b, j] += np.bincount(rows[lo : lo + block], sums[j], b - a)
    return total / np.maximum(np.diff(offsets), 1)[:, None]


def _pieces(data: np.ndarray, offsets: np.ndarray, most: int):
    """Blocks of rows of bounded size; a longer row comes in several parts, cut between segments."""
    for a, b in blocks(data, offsets, most):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b - a > 1 or hi - lo <= most:
            yield a, b, data[lo:hi], offsets[a : b + 1] - lo
        else:
            for at in range(lo, hi, most):
                end = min(hi, at + most)
                yield a, b, data[at:end], np.array([0, end - at])


def label_positions(net: Network, text: str) -> list[str]:
    """The language of every byte of a text."""
    data, offsets = flat(pa.array([text], pa.large_string()))
    x, _ = segments(data, offsets)
    best = net.probabilities(x).argmax(1).T.ravel()[: len(data)] if len(data) else []
    return [net.languages[i] for i in best]


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from the training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, sample_chars: int = 600, **more) -> Network:
    """Train on a bounded sample of the labelled documents that are not held out.

    For every language about ``per_language`` documents are drawn by a hash of their id, and of
    each one passage of ``sample_chars`` characters, all of which is learned, so the driver holds
    a bounded amount of text for each language.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).filter(~held_out("id") & F.col("id").isNotNull() & F.col("l").isNotNull())
    counts = known.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy("l").collect()  # a row a language
    u = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(1 << 30))
    chances = [F.lit(x) for r in counts for x in (r.l, min(1.0, per_language / r.n) * (1 << 30))]
    chance = F.element_at(F.create_map(*chances), F.col("l")) if chances else F.lit(None).cast("double")
    room = F.greatest(F.length("t") - sample_chars, F.lit(0)) + 1
    passage = F.substring("t", (F.pmod(F.xxhash64("id", F.lit(29)), room) + 1).cast("int"), F.lit(sample_chars))
    # the limit only guards the driver: about per_language documents a language pass the filter
    rows = known.filter(u < chance).select("id", passage.alias("t"), "l").filter("t <> ''").limit(2 * per_language * max(1, len(counts))).collect()
    rows.sort(key=lambda r: (r.l, r.id, r.t))
    return train([r.t for r in rows], [r.l for r in rows], **more)


def predict(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``.

    The whole text, however long, is read and nothing but the text.  Of languages with equal
    probabilities the first by name is given.  Without text or letters, or where no language
    was learned, ``lang_pred`` is ``und`` and the score 0.  Ids may be null (not held
    out) or repeat; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(net)

    def label(batches):
        for b in batches:
            names, score = decide(held.value, b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("t")).mapInArrow(label, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def decide(net: Network, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The language and the score of each text of a column."""
    data, offsets = flat(texts)
    known = has_letters(data, offsets) & bool(net.languages)
    if not known.any():
        return np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
    p = pooled(net, data, offsets)
    names = np.where(known, np.array(net.languages, object)[p.argmax(1)], UNKNOWN)
    return names, np.where(known, np.clip(p.max(1), 0.0, 1.0), 0.0)


def accepted(docs: DataFrame, net: Network, text_col: str = "text", min_score: float = 0.35) -> DataFrame:
    """The rows of ``docs``, all their columns, whose text has a language with at least ``min_score``.

    Null and empty texts and texts without letters go; very long ones are read whole; repeated
    rows and null ids are judged by their texts alone; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(net)

    def keep(batches):
        for b in batches:
            names, score = decide(held.value, b.column(b.schema.get_field_index(text_col)))
            yield b.filter(pa.array((names != UNKNOWN) & (score >= min_score)))

    return docs.mapInArrow(keep, docs.schema)


def has_letters(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each row has a letter."""
    cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)[classes()[cp] == LETTER]
    return np.diff(np.searchsorted(at, offsets)) > 0
