"""Chunk-reuse encoding and decoding against the tokenizer itself."""

import hashlib
import random

import numpy as np
import pytest

from shelfwise.llm import bpe, tokens
from shelfwise.llm.common import table
from shelfwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PARTS = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "1", "23", "!!", "<|endoftext|>", "<|endof", "text|>", " ", "日本", "🙂", " word",
         "\r\n", "|", "\x1c", "\x85", "don't", "　", "​", " \n ", "...", "x" * 30]


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.load_tokenizer(tokens.tokenizer_path())


@pytest.fixture
def small_chunks(monkeypatch):
    """Cuts everywhere, so that joints fall inside words, runs of spaces, special strings."""
    real = bpe.cuts
    monkeypatch.setattr(bpe, "cuts", lambda data, gear: real(data, gear, bits=3, shortest=4, longest=40))


def test_chunked_ids_equal_the_tokenizer(tokenizer, small_chunks):
    rng = random.Random(5)
    encoder = bpe.ChunkEncoder(tokens.tokenizer_path(), 500)
    passages = ["".join(rng.choice(PARTS) for _ in range(30)) for _ in range(20)] + ["plain words of a shared passage, again and again. "] * 5
    for _ in range(1500):
        text = "".join(rng.choice(passages) if rng.random() < 0.2 else rng.choice(PARTS) for _ in range(rng.randint(1, 25)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text).tolist() == ids, repr(text)
    assert encoder.reused > 1000 and encoder.whole == 0


def test_decoding_equals_the_tokenizer(tokenizer):
    rng = random.Random(6)
    decoder = bpe.Decoder(tokens.tokenizer_path())
    for _ in range(500):  # random ids are no UTF-8 in many places
        ids = [rng.randrange(50_257) if rng.random() < 0.7 else rng.randrange(188, 256) for _ in range(rng.randint(0, 30))]
        assert decoder.text(ids) == tokenizer.decode(ids, skip_special_tokens=False)


def test_cuts_follow_the_content():
    rng = random.Random(7)
    gear = bpe.gear_table()
    shared = "".join(rng.choice("abcdefgh éü日 ") for _ in range(20_000)).encode()
    cut = lambda raw: [0, *bpe.cuts(np.frombuffer(raw, np.uint8), gear)]
    one, other = b"x" * 1234 + shared, "Ein anderer Anfang ".encode() * 50 + shared
    chunks = [{raw[a:b] for a, b in zip(c, c[1:])} for raw, c in ((one, cut(one)), (other, cut(other)))]
    assert sum(map(len, chunks[0] & chunks[1])) > 0.8 * len(shared)
    for raw in (one, other, b"a" * 100_000, "日".encode() * 9000):
        c = cut(raw)
        assert c[-1] == len(raw) and all(0 < b - a <= bpe.MAX_CHUNK + 3 for a, b in zip(c, c[1:]))
        assert b"".join(raw[a:b].decode().encode() for a, b in zip(c, c[1:])) == raw


def test_rolling_hash_is_the_recurrence():
    gear = bpe.gear_table()
    data = np.frombuffer(random.Random(1).randbytes(500), np.uint8)
    got = bpe.rolling_hash(data, gear)
    for i in range(500):
        h = 0
        for b in data[max(0, i - 31):i + 1].tolist():
            h = (2 * h + int(gear[b])) % (1 << 32)
        assert got[i] == h


def test_texts_without_a_settled_place(tokenizer):
    encoder = bpe.ChunkEncoder(tokens.tokenizer_path())
    for text in ("日本語" * 5000, "a" * 20_000, " " * 20_000, "　é\n" * 4000, "é " * 5000):
        assert encoder.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_query_equals_the_tokenizer(spark, tokenizer):
    got = {r.doc_id: r for r in QUERIES["op13_chunk_reuse_bpe"](spark, SF).collect()}
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        g = got[r.doc_id]
        assert g.n_tokens == len(ids)
        assert g.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edge_cases(spark, tokenizer):
    docs = spark.createDataFrame([(1, None, [1], "x"), (2, "", None, "x"), (None, "hi there", None, None), (3, "hi", None, "x"), (3, "hi", None, "x"),
                                  (4, "w " * 100_000, None, "x")], "doc_id bigint, text string, ids array<int>, decoded string")
    got = sorted((str(r.doc_id), len(r.ids), r.decoded) for r in bpe.decode(bpe.encode(docs)).collect())
    n = len(tokenizer.encode("w " * 100_000, add_special_tokens=False).ids)
    assert got == sorted([("1", 0, ""), ("2", 0, ""), ("None", 2, "hi there"), ("3", 1, "hi"), ("3", 1, "hi"), ("4", n, "w " * 100_000)])
    assert bpe.decode(bpe.encode(docs.where("false"))).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [17, 999_999, -1, 50256])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.decoded for r in bpe.decode(odd).collect()} == {1: "", 2: tokenizer.decode([17]) + "<|endoftext|>"}
