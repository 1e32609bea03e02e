"""Encoding, packing and the token store against the tokenizers library itself."""

import random
import struct
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quarry.llm import packing, tokenstore
from quarry.llm._bpe import Encoder, default_path

from .conftest import EDGES, THUE


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_encoder_equals_the_library(library):
    r = random.Random(1)
    bits = ["don't", " 's", "''s", "'re", "'s'x", "\n\n", "  ", "\t", " \n ", "x", "é", "Ünï", "12", *THUE, "the <|endoftext|>", "<|endoftext|> ", "!!", "a×b", " ", "日本", "'ve'll", "'", "<|endoftext|>", "²", " 'tis", "\x1c", "\r\n", "ñ1", ""]
    texts = ["".join(r.choices(bits, k=r.randint(0, 12))) for _ in range(3000)] + [None, ""] + [t for _, t in EDGES]
    for slots in (1 << 20, 64):  # with 64 slots most pieces are pushed out again
        ids, at = Encoder(default_path(), slots=slots).encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == ids_of(library, t), repr(t)


def test_pack_places_every_id_once(spark, edges, library):
    rows = packing.pack_texts(edges).collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(library, t)) + 1 for _, t in EDGES)
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
    for s in by_seq.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at == 1024 or at & (at - 1) == 0
    texts = {(i, len(ids_of(library, t)) + 1): ids_of(library, t) + [0] for i, t in EDGES}
    for k, pieces in by_doc.items():
        for start, n, c in pieces:
            assert c == crc(texts[k][start : start + n])
    one = texts[(6, len(texts[6, max(n for i, n in texts if i == 6)]))]
    assert sorted(by_doc[6, len(one)])[-1][0] + sorted(by_doc[6, len(one)])[-1][1] == len(one)


def test_pack_of_nothing(nothing):
    assert packing.pack_texts(nothing).count() == 0


@pytest.mark.parametrize("hist", [{600: 1000}, {512: 7}, {1: 5}, {1023: 50, 1: 49, 300: 40, 400: 41, 324: 39}, {k: k % 13 for k in range(1, 1024)}, {}])
def test_plan_fills_windows(hist):
    h = np.zeros(1025, np.int64)
    for k, v in hist.items():
        h[k] = v
    plan = packing.make_plan(h, 1024)
    length = np.repeat(np.arange(1025), h)
    rank = np.concatenate([np.arange(v) for v in h]) if len(length) else np.zeros(0, np.int64)
    which, start, n, seq, offset = packing.place(plan, length, rank)
    assert n.sum() == length.sum()
    assert (np.bincount(which, n, len(length)) == length).all() if len(length) else True
    total = np.bincount(seq, n) if len(seq) else np.zeros(0)
    for s in range(len(total)):
        if total[s]:
            own = np.argsort(offset[seq == s])
            o, k = offset[seq == s][own], n[seq == s][own]
            assert (o == np.cumsum(k) - k).all() and (k.sum() == 1024 or k.sum() & (k.sum() - 1) == 0)


def test_least_squares_finds_an_exact_solution():
    h = np.zeros(1025, np.int64)
    h[[700, 324, 512]] = 1000, 1000, 400
    combos = packing.combinations(1024, np.flatnonzero(h))
    repeats, left = packing.round_down(combos, packing.nonnegative_least_squares(combos, h.astype(float)), h)
    assert left.sum() == 0 and repeats.sum() == 1200


def test_fill_gives_the_sequences(spark, library):
    docs = [(i, " ".join(["token"] * (300 * i))) for i in range(1, 6)]
    ids = {i: ids_of(library, t) + [0] for i, t in docs}
    pieces = packing.pack_texts(spark.createDataFrame(docs, "doc_id long, text string"))
    tokens = spark.createDataFrame(list(ids.items()), "id long, ids array<int>")
    rows = packing.fill(pieces.withColumnRenamed("doc_id", "id"), tokens).collect()
    assert sorted(x for r in rows for x in r.ids) == sorted(x for v in ids.values() for x in v)


@pytest.mark.parametrize("ids", [[], [0], [255, 256], [2**32 - 1, 0, 65536] * 700, list(range(0, 60_000, 7))])
def test_shard_round_trip_and_random_access(ids):
    a = np.array(ids, np.uint32)
    s = tokenstore.Shard(tokenstore.pack_shard(a, np.array([0, len(a)])))
    assert s.ids().tolist() == ids and [s.token(i) for i in range(0, len(ids), 13)] == ids[::13]
    with pytest.raises(IndexError):
        s.token(len(ids))


def test_store_round_trip(spark, edges, library):
    store = tokenstore.write(edges, shard_tokens=5000)
    rows = sorted(tokenstore.read(store).collect(), key=lambda r: r.start)
    want = sorted(((i, len(ids_of(library, t)) + 1, crc(ids_of(library, t) + [2])) for i, t in EDGES), key=str)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=str) == want
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    names = [r.doc_id for r in rows]
    assert names == sorted(names, key=lambda x: (x is not None, x))
    flat = {}
    for r in tokenstore.read(store, digest=False).collect():
        flat |= {r.start + k: v for k, v in enumerate(r.ids)}
    got = tokenstore.tokens_at(store, spark.range(0, at + 9, 101).withColumnRenamed("id", "position")).collect()
    assert {r.position: r.token for r in got} == {p: flat[p] for p in range(0, at, 101)}


def test_store_of_nothing(nothing):
    assert tokenstore.read(tokenstore.write(nothing)).count() == 0
