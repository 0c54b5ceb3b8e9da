"""Byte-level BPE through a sentencepiece model that is written straight from the vocabulary.

The model is a serialised ``ModelProto``: one piece for each token, its bytes mapped to
printable characters, its score the negative rank, so the library merges by lowest rank; the
normaliser is the identity, with no dummy prefix, no space escaping and no space removal.
Nothing is trained.  Pre-tokens are encoded one by one, and ids go back to bytes by the
inverse of the piece mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .columns import flat
from .pretokens import Encoder
from .runtime import ship


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in the order of their ranks, which must be gapless from 0."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}
    return [found[i] for i in range(len(found))]


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised BPE model whose ids are the ranks; the unknown piece comes after them."""
    chars = byte_characters()
    pieces = [_field(1, "".join([chars[b] for b in t]).encode()) + _field(2, -float(rank)) + _field(3, 1) for rank, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    # trainer: model_type BPE, vocab_size, no byte fallback, ids of unk, bos, eos, pad
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(35, 0) + _field(40, len(tokens)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([_field(1, p) for p in pieces]) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes by the vocabulary of a rank file."""

    def __init__(self, path: str):
        import sentencepiece

        tokens = read_ranks(path)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model_proto(tokens))
        self.whole = {t: i for i, t in enumerate(tokens)}
        self.to_char = dict(enumerate(byte_characters()))
        back = {c: b for b, c in self.to_char.items()}
        self.bytes_of = [bytes([back[c] for c in self.sp.id_to_piece(i)]) for i in range(len(tokens))]
        self.sizes = np.fromiter(map(len, self.bytes_of), np.int64, len(self.bytes_of))
        self.encoder = Encoder(self.encode_pretokens)

    def encode_pretokens(self, pretokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token; one that is a token itself is that token."""
        raw = [p.encode() for p in pretokens]
        out: list = [self.whole.get(r) for r in raw]
        left = [i for i, x in enumerate(out) if x is None]
        mapped = [raw[i].decode("latin-1").translate(self.to_char) for i in left]
        for i, ids in zip(left, self.sp.encode(mapped, num_threads=1) if mapped else [], strict=True):
            out[i] = ids
        return [[x] if isinstance(x, int) else x for x in out]

    def decode(self, ids) -> bytes:
        """The bytes of ids, by the inverse mapping."""
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, with ``keep_ids``, ``ids``.

    ``decoded_sha256`` is the digest of the bytes that decoding the ids gives, so it equals the
    digest of the text's bytes.  A null text is empty; very long ones are read whole; ids may be
    null or repeat; other columns are ignored; an empty table gives no rows.
    """
    ship(docs.sparkSession)

    def encode(batches):
        c = codec(ranks_path)
        for b in batches:
            for first, ids, ends in c.encoder.ids(*flat(b.column(1))):
                n = len(ends) - 1
                shas, back, lists = [], [], []
                whole = c.decode(ids.tolist())
                sizes = c.sizes[ids]
                at = np.concatenate([[0], np.cumsum(sizes)])[ends]
                raw = memoryview(ids.astype("<u4").tobytes())
                for k in range(n):
                    shas.append(hashlib.sha256(raw[4 * ends[k] : 4 * ends[k + 1]]).hexdigest())
                    back.append(hashlib.sha256(memoryview(whole)[at[k] : at[k + 1]]).hexdigest())
                cols = [b.column(0).slice(first, n), pa.array(np.diff(ends)), pa.array(shas, pa.string()), pa.array(back, pa.string())]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names=schema.fieldNames())

    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * keep_ids)
    return docs.select(id_col, text_col).mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from lists of ids; a null list gives a null text, ill-formed bytes become U+FFFD."""
    ship(encoded.sparkSession)

    def decode(batches):
        c = codec(ranks_path)
        for b in batches:
            texts = [None if x is None else c.decode(x).decode(errors="replace") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    schema = T.StructType([T.StructField("doc_id", encoded.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return encoded.select(id_col, ids_col).mapInArrow(decode, schema)
