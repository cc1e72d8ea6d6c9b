"""Token counts and packing against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest

from shelfwise.llm import packing, tokens
from shelfwise.llm.common import table
from shelfwise.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PARTS = ["a", "the", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "1", "23", "!!", "<|endoftext|>", " ", "日本", "🙂", " word",
         "\r\n", "|", "\x1c", "\x85", "don't", "　", "​"]
DOCS = "doc_id bigint, text string, n_tokens string, length int"


@pytest.fixture(scope="module")
def tokenizer():
    return tokens.load_tokenizer(tokens.tokenizer_path())


def test_pieces_encode_like_the_tokenizer(tokenizer):
    rng = random.Random(3)
    counter, encoder = tokens.PieceCounter(tokens.tokenizer_path(), 50), tokens.PieceEncoder(tokens.tokenizer_path(), 50)
    for _ in range(3000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(1, 14)))
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert counter.count(text) == len(ids), repr(text)
        assert np.frombuffer(encoder.ids(text), "<u4").tolist() == ids, repr(text)


def test_whole_tokens_are_proven(tokenizer):
    whole = tokens.whole_tokens(tokenizer)
    assert len(whole) > 40_000
    for text in random.Random(1).sample(sorted(whole), 300):
        assert tokenizer.encode(text, add_special_tokens=False).ids == [whole[text]]


def test_counts_of_the_table(spark, tokenizer):
    got = {r.doc_id: r for r in QUERIES["op2_whole_token_counts"](spark, SF).collect()}
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (n, n > 512)
        assert got[r.doc_id].n_bytes == len((r.text or "").encode())


def test_count_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "x", 1), (2, "", "x", 1), (None, "hi there", None, None), (3, "hi", "x", 1), (3, "hi", "x", 1), (4, "w " * 30_000, "x", 2)], DOCS)
    got = [tuple(r) for r in tokens.token_counts(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 0, False), (2, 0, 0, False), (None, 8, 2, False), (3, 2, 1, False), (3, 2, 1, False),
                                           (4, 60_000, 30_001, True)], key=str)
    assert tokens.token_counts(docs.where("false")).count() == 0


def check_packing(pieces, ids_by_doc, limits):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(ids_by_doc)
    for doc_id, ids in ids_by_doc.items():
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for seq in by_sequence.values():
        at = 0
        for k, p in enumerate(sorted(seq, key=lambda p: p.offset)):
            assert p.offset == at and p.segment == k
            at += p.length
        assert at <= limits.tokens and len(seq) <= limits.segments and sum(p.loss_tokens for p in seq) <= limits.loss
    return by_sequence


def test_packing_round_trip(spark, tokenizer):
    pieces = QUERIES["op10_vector_packing"](spark, SF).collect()
    rows = table(spark, SF, "documents").select("doc_id", "text").collect()
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0] for r in rows}
    sequences = check_packing(pieces, ids, packing.Limits())
    total = sum(map(len, ids.values()))
    assert len(sequences) * 1024 <= total * 1.02 + 1024


def test_packing_edge_cases_and_limits(spark, tokenizer):
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, "hello world " * 900, "x", 3), (4, "a b c d e f", "x", 0), (5, "one two", None, None)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    limits = packing.Limits(tokens=64, segments=3, loss=40)
    pieces = packing.pack_documents(docs, limits, loss_from="length").collect()
    ids = {r[0]: tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in rows}
    check_packing(pieces, ids, limits)
    begins = {r[0]: r[3] or 0 for r in rows}
    for p in pieces:
        assert p.loss_tokens == max(0, p.start + p.length - max(p.start, begins[p.doc_id]))
    assert packing.pack_documents(docs.where("false")).count() == 0


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(7, "same text", "", 0)] * 3 + [(None, "x", "", 0)], DOCS).coalesce(1)
    pieces = packing.pack_documents(docs).collect()
    assert sorted((p.doc_id is None, p.length) for p in pieces) == [(False, 3), (False, 3), (False, 3), (True, 2)]
    assert sum(p.length for p in pieces) == 11 and len({p.sequence_id for p in pieces}) == 1
