"""Token counts and token ids of whole texts under a public byte-level BPE tokenizer.

Method (whole-token shortcut). A vocabulary string that the tokenizer, given the
string alone, returns as exactly one token is *whole*. ``whole_tokens`` proves this
string by string with the tokenizer itself, once per worker. A pre-token that is
whole counts as one token without any merging; only the other pre-tokens are merged,
each distinct one once while the worker's memo holds it.

Texts are first cut at every single space that stands between two non-space
characters. The pre-token pattern lets a space only lead a pre-token, and no
pre-token holds a non-space character followed by a space, so these cuts are always
pre-token borders: the pieces can be encoded apart and their ids joined. A piece of
letters with its leading space is one pre-token; other pieces are split by the
pattern. A text with runs of white space is cut with a slower pattern at the same
borders, and special strings never hold a space, so none is cut in two.

Nulls, empty texts and repeated rows: a null or empty text has 0 tokens; every row
gives one row, repeats included. Only ``doc_id`` and ``text`` are read, so further
columns and their names do not matter. Work is row-local: no shuffle, one Arrow batch
and a bounded memo in memory.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import sliced

BYTE_BPE = "byte_bpe_50k.json"
CONTEXT_TOKENS = 512
MEMO_PIECES = 200_000
#: Fixed values of the tokenizer: the pattern that makes its pre-tokens.
PRETOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BORDER = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 32]


def tokenizer_path(name: str = BYTE_BPE) -> str:
    """Place of an installed tokenizer file on this machine (looked up where the task runs)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _unicode_of_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others for 256 onwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


def whole_tokens(tokenizer) -> dict[str, int]:
    """Vocabulary strings proven to encode alone as one token, with its id."""
    alphabet = _unicode_of_bytes()
    texts, ids = [], []
    for written, token in tokenizer.get_vocab(with_added_tokens=False).items():
        if any(c not in alphabet for c in written):
            continue
        try:
            texts.append(bytes(alphabet[c] for c in written).decode("utf-8"))
        except UnicodeDecodeError:
            continue
        ids.append(token)
    proven = {}
    for start in range(0, len(texts), 4096):
        part = texts[start:start + 4096]
        for text, token, enc in zip(part, ids[start:start + 4096], tokenizer.encode_batch_fast(part, add_special_tokens=False)):
            if enc.ids == [token]:
                proven[text] = token
    return proven


def rank_encoding(path: str):
    """The file's merges as a rank table, after proving that merge number n makes the token with the n-th id."""
    import json

    import tiktoken

    model = json.load(open(path, encoding="utf-8"))["model"]
    alphabet, vocab = _unicode_of_bytes(), model["vocab"]
    made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    first = min(vocab[t] for t in made)
    if [vocab[t] for t in made] != list(range(first, first + len(made))):
        raise ValueError("merges are not in the order of their ids")
    ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if all(c in alphabet for c in t) and i < first + len(made)}
    encoding = tiktoken.Encoding("ranks", pat_str=PRETOKEN_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding, {i: len(t) for t, i in ranks.items()}


def split_pieces(text: str) -> list[str]:
    """Cut ``text`` at the spaces that are surely pre-token borders; every piece but the first has lost its space."""
    # a space at an end or next to other white space does not stand between two non-space characters
    doubtful = "  " in text or text[0] == " " or text[-1] == " "
    return _BORDER.split(text) if doubtful or any(
        c in text and (c + " " in text or " " + c in text) for c in _OTHER_SPACES) else text.split(" ")


class _Memo:
    """Two generations: the full young one becomes the old one; entries still in use are carried over."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def put(self, key: str, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def get(self, key: str):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def get_all(self, keys: list[str]) -> list:
        found = list(map(self.young.get, keys))
        if None in found:
            found = [self.get(k) if v is None else v for k, v in zip(keys, found)]
        return found


class PieceCounter:
    """Counts tokens: whole pre-tokens directly, the other distinct pre-tokens by the tokenizer's merges."""

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES):
        import regex

        self.tokenizer = load_tokenizer(path)
        self.whole = whole_tokens(self.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pretokens = regex.compile(PRETOKEN_PATTERN)
        self.written = {b: c for c, b in _unicode_of_bytes().items()}
        self.memos = self.pieces, self.merged = _Memo(memo_pieces), _Memo(memo_pieces)

    def _merge(self, pretoken: str) -> int:
        n = self.merged.get(pretoken)
        if n is None:
            n = len(self.tokenizer.model.tokenize(pretoken.encode().decode("latin-1").translate(self.written)))
            self.merged.put(pretoken, n)
        return n

    def count_piece(self, piece: str) -> int:
        if any(s in piece for s in self.special):
            return len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        whole = self.whole
        if piece in whole:
            return 1
        return sum(1 if p in whole else self._merge(p) for p in self.pretokens.findall(piece))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        first, *pieces = split_pieces(text)
        total, counts = self.count_piece(first), self.pieces.get_all(pieces)
        if None in counts:
            put, known = self.pieces.put, {}
            for i, n in enumerate(counts):
                if n is None:
                    piece = pieces[i]
                    if (n := known.get(piece)) is None:
                        n = known[piece] = self.count_piece(" " + piece)
                        put(piece, n)
                    counts[i] = n
        return total + sum(counts)


class PieceEncoder:
    """Token ids as bytes, with a memo of pieces; new pieces of a text are encoded in one call."""

    def __init__(self, path: str, memo_pieces: int = MEMO_PIECES):
        self.tokenizer = load_tokenizer(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks, sizes = rank_encoding(path)
        self.token_bytes = np.zeros(max(sizes) + 1, np.int64)
        for token, size in sizes.items():
            self.token_bytes[token] = size
        self.pieces = _Memo(memo_pieces)
        self.memos = (self.pieces,)

    def _encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.ranks.encode_ordinary(text), "<u4").tobytes()

    def _encode_new(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of several pieces, encoded as one text and cut where the pieces' bytes end."""
        known = {p: self._encode(" " + p) for p in pieces if any(s in p for s in self.special)}
        plain = [p for p in pieces if p not in known] if known else pieces
        if plain:
            ids = np.array(self.ranks.encode_ordinary(" " + " ".join(plain)), "<u4")
            ends = np.cumsum([len(p.encode()) + 1 for p in plain])
            at = (np.searchsorted(np.cumsum(self.token_bytes[ids]), ends) + 1) * 4
            raw, start = ids.tobytes(), 0
            for p, end in zip(plain, at.tolist()):
                known[p] = raw[start:end]
                start = end
        return known

    def ids(self, text: str | None) -> bytes:
        """Token ids of the text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        first, *pieces = split_pieces(text)
        found = self.pieces.get_all(pieces)
        if None in found:
            new = self._encode_new(list(dict.fromkeys(p for p, v in zip(pieces, found) if v is None)))
            for p, value in new.items():
                self.pieces.put(p, value)
            found = [new[p] if v is None else v for p, v in zip(pieces, found)]
        return self._encode(first) + b"".join(found)


_PER_WORKER: dict[tuple, object] = {}


def per_worker(kind, path: str, memo_pieces: int):
    """One encoder per Python worker, so that later tasks find the memo warm; of the memos only the young generation stays."""
    key = (kind, path, memo_pieces)
    if key not in _PER_WORKER:
        _PER_WORKER[key] = kind(path, memo_pieces)
    encoder = _PER_WORKER[key]
    for memo in encoder.memos:
        memo.old = {}
    return encoder


COUNT_SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def token_counts(docs: DataFrame, tokenizer: str = BYTE_BPE, context_tokens: int = CONTEXT_TOKENS,
                 memo_pieces: int = MEMO_PIECES) -> DataFrame:
    """Per row: UTF-8 bytes, tokens of the whole text, and whether they exceed ``context_tokens``.

    ``tokenizer`` names an installed file; it is opened by the worker. Null and
    empty texts: 0 bytes, 0 tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(PieceCounter, tokenizer_path(tokenizer), memo_pieces)
        for batch in sliced(batches):
            counts = [encoder.count(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(counts, pa.int64()),
                                   pa.array([c > context_tokens for c in counts], pa.bool_())],
                                  names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"),
                       F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    return read.mapInArrow(run, COUNT_SCHEMA)
