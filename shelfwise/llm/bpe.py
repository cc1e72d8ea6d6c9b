"""BPE encoding and decoding of whole texts by content-defined chunk reuse.

Encoding. A rolling hash over the last 32 bytes cuts a text wherever its low bits are
zero, so equal passages of different documents are cut alike whatever stands around them.
Cuts fall anywhere, so ids next to a joint of two chunks are doubtful. Each chunk has a
*core* between its first and its last *settled* place; a place is settled if white space (a
space or a line feed) follows a printable ASCII character: the pre-token pattern has no
alternative that crosses such a place and looks at nothing before it, and special strings hold
no white space, so the ids on both sides do not depend on each other. A core's ids are made once while the
worker's memo holds its chunk and reused for every later occurrence. Every joint is repaired: the window from the
last settled place before it to the first one after it is encoded again, growing over whole chunks until
both its ends are settled; there it agrees with the cores exactly, and ids are joined. A text without a settled place is one window,
so the result is exact for any text. All that a document needs encoded (its windows and new cores) goes in one call, since all those
pieces end at settled places.

The agreement is checked, not assumed: every piece must end where an id ends, and the ids' bytes must add up to the pieces';
a text that fails is encoded whole by the tokenizer.

Decoding maps ids back to bytes; bytes that are no UTF-8 become U+FFFD as the library does it.

Ids are made with the ranks of the tokenizer's own file (proven equal in ``tokens.rank_encoding``);
what holds a special string goes to the tokenizer itself.

Defined cases: a null or empty text has no ids and decodes to the empty text. Repeated rows give a row each.
A null ``doc_id`` stays null. Ids that the vocabulary lacks decode to nothing; null ids to the empty text. Texts of any length are cut and joined; a
chunk is cut at ``MAX_CHUNK`` bytes at the latest. An empty table gives no rows. Only ``doc_id`` and ``text`` are read. Work is row-local: no
shuffle, and a task that runs again gives the same rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import sliced
from shelfwise.llm.tokens import BYTE_BPE, _Memo, load_tokenizer, per_worker, rank_encoding, tokenizer_path
from shelfwise.llm.tokens import _unicode_of_bytes as unicode_of_bytes

#: a cut where this many low bits of the hash are zero: chunks of 512 bytes on average
CUT_BITS = 9
MIN_CHUNK, MAX_CHUNK = 64, 4096
MEMO_CHUNKS = 40_000
GEAR_SEED = 20_011
SLICE_ROWS = 128

ENCODED_SCHEMA = "doc_id bigint, ids array<int>"
DECODED_SCHEMA = "doc_id bigint, ids array<int>, decoded string"


def gear_table() -> np.ndarray:
    """A random 32-bit number per byte value, from a fixed seed."""
    return np.random.default_rng(GEAR_SEED).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


def rolling_hash(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """Hash of the last 32 bytes at every place: ``h[i] = 2 * h[i - 1] + gear[data[i]]`` modulo 2**32, by doubling the window."""
    h = gear[data]
    for span in (1, 2, 4, 8, 16):
        if len(h) > span:
            h[span:] = h[span:] + (h[:-span] << np.uint32(span))
    return h


def cuts(data: np.ndarray, gear: np.ndarray, bits: int = CUT_BITS, shortest: int = MIN_CHUNK, longest: int = MAX_CHUNK) -> list[int]:
    """Ends of the chunks of a UTF-8 text: content-defined places moved to the next character, the text's end last."""
    n = len(data)
    # the hash's high bits have seen all 32 bytes, the low ones only the last few
    places = np.flatnonzero(rolling_hash(data, gear) >> np.uint32(32 - bits) == 0) + 1
    out, start = [], 0

    def cut(end: int) -> int:
        while end < n and data[end] & 0xC0 == 0x80:
            end += 1
        if end < n:
            out.append(end)
        return end

    for place in places.tolist():
        while place - start > longest:
            start = cut(start + longest)
        if place - start >= shortest:
            start = cut(place)
    while n - start > longest:
        start = cut(start + longest)
    out.append(n)
    return out


def settled(raw: bytes) -> np.ndarray:
    """Places of ``raw`` where white space follows a printable ASCII character."""
    data = np.frombuffer(raw, np.uint8)
    before, at = data[:-1], data[1:]
    return np.flatnonzero(((at == 0x20) | (at == 0x0A)) & (before > 0x20) & (before < 0x7F)) + 1


class ChunkEncoder:
    """Token ids of texts by chunk reuse."""

    def __init__(self, path: str, memo_chunks: int = MEMO_CHUNKS):
        self.tokenizer = load_tokenizer(path)
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = list(added.values())
        self.ranks, sizes = rank_encoding(path)
        sizes = sizes | {i: len(raw) for i, raw in added.items()}
        self.token_bytes = np.zeros(max(sizes) + 1, np.int64)
        self.token_bytes[list(sizes)] = list(sizes.values())
        self.gear = gear_table()
        self.cores = _Memo(memo_chunks)
        self.memos = (self.cores,)
        self.encoded = self.reused = self.whole = 0

    def direct(self, raw: bytes) -> np.ndarray:
        """Ids of a text encoded as a whole."""
        text = raw.decode()
        if any(s in raw for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        return np.array(self.ranks.encode_ordinary(text), np.int32)

    def _apart(self, pieces: list[bytes]) -> list[np.ndarray] | None:
        """Ids of the pieces, encoded in one call and cut where the pieces end; None if an end is no border of ids."""
        ids = self.direct(b"".join(pieces))
        ends = np.cumsum(self.token_bytes[ids])
        asked = np.cumsum([len(p) for p in pieces])
        at = np.searchsorted(ends, asked)
        if len(ids) == 0 or ends[-1] != asked[-1] or not np.array_equal(ends[at], asked):
            return None
        at = (at + 1).tolist()
        return [ids[low:high] for low, high in zip([0, *at], at)]

    def ids(self, text: str | None) -> np.ndarray:
        """Token ids of a whole text."""
        if not text:
            return np.empty(0, np.int32)
        raw = text.encode()
        places = settled(raw).tolist()
        pieces: list[bytes] = []  # windows and new cores, in their order
        parts: list = []  # known ids, or the number of a piece
        made: dict[bytes, int] = {}  # chunk of a new core -> its piece
        start = done = at = 0
        for end in cuts(np.frombuffer(raw, np.uint8), self.gear):
            low = bisect_right(places, start, at)
            at = bisect_left(places, end, low)
            if at - low >= 2:  # the chunk has a core: what lies between its first and its last settled place
                chunk, first, last = raw[start:end], places[low], places[at - 1]
                parts.append(len(pieces))
                pieces.append(raw[done:first])
                core = self.cores.get(chunk)
                if core is None:
                    core = made.get(chunk)
                if core is None:
                    core = made[chunk] = len(pieces)
                    pieces.append(raw[first:last])
                    self.encoded += 1
                else:
                    self.reused += 1
                parts.append(core)
                done = last
            start = end
        parts.append(len(pieces))
        pieces.append(raw[done:])
        new = self._apart(pieces)
        if new is None:
            self.whole += 1
            return self.direct(raw)
        for chunk, piece in made.items():
            self.cores.put(chunk, new[piece].copy())
        return np.concatenate([new[p] if isinstance(p, int) else p for p in parts])


class Decoder:
    """Texts of token ids."""

    def __init__(self, path: str, memo_chunks: int = 0):
        tokenizer = load_tokenizer(path)
        alphabet = unicode_of_bytes()
        written = tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in written.items()}
        self.memos = ()

    def text(self, ids: list[int | None]) -> str:
        try:
            raw = b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError:
            raw = b"".join([self.bytes_of.get(i, b"") for i in ids])
        return raw.decode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer: str = BYTE_BPE, memo_chunks: int = MEMO_CHUNKS) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text. ``tokenizer`` names an installed file, opened by the worker."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(ChunkEncoder, tokenizer_path(tokenizer), memo_chunks)
        for batch in sliced(batches, SLICE_ROWS):
            found = [encoder.ids(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, np.int32), pa.int32()))
            yield pa.record_batch([batch.column(0), lists], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ENCODED_SCHEMA)


def decode(encoded: DataFrame, tokenizer: str = BYTE_BPE) -> DataFrame:
    """(doc_id, ids, decoded): the text of every row's ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = per_worker(Decoder, tokenizer_path(tokenizer), 0)
        for batch in sliced(batches, SLICE_ROWS):
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).tolist() if lists.values.null_count == 0 else lists.flatten().to_pylist()
            ends = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy()).tolist()
            texts = [decoder.text(flat[low:high]) for low, high in zip([0, *ends], ends)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, DECODED_SCHEMA)
