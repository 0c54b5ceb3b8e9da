"""Token operators against the libraries themselves."""
import base64
import hashlib
import random
import zlib

import public_tokenizers as P
import pyarrow as pa
import pytest
import regex

from millrace.llm import bpe_codec, packing, token_counts
from millrace.llm.columns import SpanMap, eights, flat, span_keys
from millrace.llm.pretokens import split

from .conftest import thue_morse

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")


def test_split_is_the_pattern():
    import numpy as np

    random.seed(1)
    alphabet = "ab'sstrevmldl  \n\t1²é日.!' 　́\x1c\x85"
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 30))) for _ in range(20000)] + ["", "we'll they're 'sx ''s 's"]
    data, offsets = flat(pa.array(texts))
    text = data.tobytes().decode()
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    rows = points[offsets]
    starts = split(cp, rows)
    ends = np.append(starts[1:], len(cp))
    at = np.searchsorted(starts, rows)
    pattern = regex.compile(P.PATTERN)
    for i, t in enumerate(texts):
        assert [text[a:b] for a, b in zip(starts[at[i] : at[i + 1]], ends[at[i] : at[i + 1]])] == pattern.findall(t), t


def test_counts_are_the_librarys(spark, odd_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    got = token_counts.token_counts(odd_docs, JSON, limit=20).collect()
    want = [(r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect()]
    assert sorted(map(str, [(r.doc_id, r.n_bytes, r.n_tokens) for r in got])) == sorted(map(str, want))
    assert all(r.over_limit == (r.n_tokens > 20) for r in got)
    assert token_counts.token_counts(odd_docs.limit(0), JSON).count() == 0


def test_codec_is_tiktoken_and_goes_back(spark, odd_docs):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    enc = bpe_codec.encode_documents(odd_docs, RANKS)
    by = {}
    for s in odd_docs.collect():
        by.setdefault(s.doc_id, s.text or "")
    for r in enc.collect():
        ids = e.encode_ordinary(by[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(by[r.doc_id].encode()).hexdigest()
    back = bpe_codec.decode_documents(enc, RANKS)
    assert all(r.text == by[r.doc_id] for r in back.collect())
    assert bpe_codec.encode_documents(odd_docs.limit(0), RANKS).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_codec_on_random_bytes(seed):
    import tiktoken

    random.seed(seed)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe_codec.codec(RANKS)
    words = ["".join(chr(random.choice([random.randrange(32, 127), random.randrange(160, 0x500), random.randrange(0x4E00, 0x4F00)])) for _ in range(random.randint(1, 12))) for _ in range(3000)]
    for w, ids in zip(words, c.encode_pretokens(words)):
        assert ids == e._encode_single_piece(w), w
    assert zlib.crc32(c.decode(ids)) == zlib.crc32(words[-1].encode())


def test_caches_compare_pretokens(spark):
    """Pre-tokens that polynomial hashes take for one, in one partition and in two, in either order."""
    import tiktoken
    from tokenizers import Tokenizer

    one, two = thue_morse()
    rows = [(1, one), (2, two), (3, f"{two} {one}"), (4, one[:8] + " " + two[:8])]
    library = Tokenizer.from_file(JSON)
    ids = {d: library.encode(t, add_special_tokens=False).ids for d, t in rows}
    ranks = {base64.b64decode(k): int(v) for k, v in (x.split() for x in open(RANKS, "rb") if x.strip())}
    bpe = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for order, parts in ((1, 1), (-1, 1), (1, 2)):
        docs = spark.createDataFrame(rows[::order], "doc_id long, text string").repartition(parts, "doc_id")
        assert {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, JSON).collect()} == {d: len(x) for d, x in ids.items()}
        for r in bpe_codec.encode_documents(docs, RANKS).collect():
            text = dict(rows)[r.doc_id]
            assert r.ids == bpe.encode_ordinary(text) and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        packed = {r.doc_id: r.ids_crc32 for r in packing.pack_documents(docs, JSON, 4096, 2).collect()}
        assert packed == {d: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*x, 2])) for d, x in ids.items()}


def test_span_map_never_answers_for_another_span():
    import numpy as np

    random.seed(2)
    spans = list({random.randbytes(random.choice([1, 2, 7, 8, 9, 15, 16, 17, 40, 1024, 1025])) for _ in range(3000)})
    ends = np.cumsum([len(x) for x in spans])
    starts = ends - [len(x) for x in spans]
    words = eights(np.frombuffer(b"".join(spans), np.uint8))
    keys = span_keys(words, starts, ends)
    long = np.array([len(x) > 7 for x in spans])
    for same in (False, True):  # the second time all hashed keys are one
        k = np.where(long & same, np.uint64(2**64 - 5), keys)
        m = SpanMap(13)
        m.add(k[:2000], np.arange(2000), spans[:2000])
        got = m.find(k, words, starts, ends)
        assert all(g in (-1, i) for i, g in enumerate(got.tolist())) and (got[:2000][~long[:2000]] >= 0).all() and (got[2000:] == -1).all()
        assert same or (got[:2000] >= 0)[np.array([len(x) <= 1024 for x in spans[:2000]])].all()
