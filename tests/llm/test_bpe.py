"""Byte-level BPE against the tokenizer library, and decoding as an exact round trip."""

import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from mailglass.llm import bpe
from mailglass.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def engine():
    with open(RANKS, "rb") as file:
        return bpe.Engine(file.read(), public_tokenizers.PATTERN)


def encoded(engine, texts):
    out = [[] for _ in texts]
    for row, ids in engine.encode(pa.array(texts, pa.string())):
        out[row] += ids.tolist()
    return out


def test_random_words_like_the_library(engine, library):
    draw = random.Random(3)
    texts = ["".join(draw.choice("abcdeilnorst") for _ in range(draw.randint(1, 60))) for _ in range(1500)]
    texts += ["".join(chr(draw.choice([97, 98, 0xE9, 0x4E2D, 0x1F600, 48, 49, 32, 10, 39])) for _ in range(draw.randint(1, 60))) for _ in range(1500)]
    assert encoded(engine, texts) == [library.encode_ordinary(t) for t in texts]


def test_long_pieces_and_long_blanks(engine, library):
    texts = ["x" * 100_000, " " * 5_000 + "a", "ab" * 10_000, "nana" * 3_000 + "batman", "", "\n\n\n \t a", "<|endoftext|>"]
    assert encoded(engine, texts) == [library.encode_ordinary(t) for t in texts]


def test_recursion_resumed_and_memory_forgotten(engine, library, monkeypatch):
    monkeypatch.setattr(bpe, "ROW_COPIES", 1)
    monkeypatch.setattr(bpe, "REMEMBERED", 0)
    monkeypatch.setattr(bpe, "BLOCK_PIECES", 5)
    monkeypatch.setattr(bpe, "BLOCK_IDS", 7)
    texts = ["unquestionably zzyzx qwertyuiop", "floccinaucinihilipilification and so on and on, again and again", "antidisestablishmentarianism" * 4]
    got = encoded(engine, texts)
    assert got == [library.encode_ordinary(t) for t in texts]
    back = [b""] * len(texts)
    for row, data in engine.decode(np.concatenate(got).astype(np.int32), np.repeat(np.arange(len(got)), [len(g) for g in got])):
        back[row] += data
    assert back == [t.encode() for t in texts]


def test_together_only_where_order_cannot_matter(engine):
    """A token whose pairs may have a smaller rank than itself is contracted one at a time."""
    a = engine.con.execute("SELECT count(*) FROM merges m WHERE together AND EXISTS (SELECT 1 FROM merges n WHERE (n.a = m.made OR n.b = m.made) AND n.made < m.made)").fetchone()[0]
    assert a == 0 < engine.con.execute("SELECT count(*) FROM merges WHERE together").fetchone()[0]


def test_frames(spark, make, library):
    long = " ".join(f"w{i % 977}x" for i in range(60_000))
    rows = [(1, "Hello  world's end", "a"), (1, "Hello  world's end", "b"), (2, None, None), (None, "", "c"), (3, long, "d"), (4, "﻿Ü 字 \U0001f600\x00", "e")]
    docs = make(rows, "doc_id long, text string, ids string")
    words = bpe.Vocabulary(spark, RANKS, public_tokenizers.PATTERN)
    both = bpe.decode(bpe.encode(docs, words, ["doc_id", "ids"]), words).collect()
    want = {r[2]: library.encode_ordinary(r[1] or "") for r in rows}
    assert len(both) == len(rows)
    for r in both:
        assert r.token_ids == want[r.ids]
        assert bytes(r.decoded) == next((x[1] or "") for x in rows if x[2] == r.ids).encode()
    assert bpe.decode(bpe.encode(docs.limit(0), words, ["doc_id"]), words).columns == ["doc_id", "token_ids", "decoded"]
    assert bpe.decode(bpe.encode(docs.limit(0), words, ["doc_id"]), words).isEmpty()


def test_strange_ids(spark, make):
    words = bpe.Vocabulary(spark, RANKS, public_tokenizers.PATTERN)
    assert [bytes(r.decoded) for r in bpe.decode(make([(None,), ([],)], "token_ids array<int>"), words).collect()] == [b"", b""]
    with pytest.raises(Exception, match="is no token"):
        bpe.decode(make([([1, 60_000],)], "token_ids array<int>"), words).collect()


def test_query_against_the_library(spark, small, library):
    import hashlib

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op11_bpe"](spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
