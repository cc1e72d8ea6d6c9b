"""Vector bin packing of token ids into fixed-length training sequences.

Every document becomes its token ids followed by the end id. Ids are cut into pieces
and the pieces are placed into sequences under three limits that hold together: ids,
segments (pieces) and loss-bearing ids. The dot-product heuristic fills one sequence
at a time: of all pieces that still fit, it takes the one whose demand vector has the
largest dot product with the room left (each dimension scaled to its limit). When no
whole piece fits, the piece with the best product of what can be taken is cut to the
room that is left, so a sequence ends short only when the segment or the loss limit
binds, or when its block has no pieces left.

Documents are packed in blocks inside the tasks that tokenise them, so ids are never
shuffled; a block holds a bounded number of ids and only its last sequence can be
short for want of pieces. A full run of ``max_tokens`` ids of a long document is a
sequence by itself and leaves the block at once.

Defined cases: a null or empty text packs its end id alone; repeated rows are packed
once per row; a null ``doc_id`` stays null; further columns are not read. Loss-bearing
ids of a document are those from position ``loss_from`` on (a column, for instruction
data whose prompt bears no loss; null: all ids). A text of any length is cut as it is
met. An empty table gives no rows. Ties go to the earliest piece of the block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import sliced
from shelfwise.llm.tokens import BYTE_BPE, MEMO_PIECES, PieceEncoder, per_worker, tokenizer_path

MAX_TOKENS = 1024
MAX_SEGMENTS = 32
MAX_LOSS = 1024
END_ID = 0
BLOCK_PIECES = 1024

PIECE_SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
                "sequence_id bigint, offset bigint, segment int, loss_tokens bigint")


class Limits:
    """Largest number of ids, segments and loss-bearing ids of a sequence."""

    def __init__(self, tokens: int = MAX_TOKENS, segments: int = MAX_SEGMENTS, loss: int = MAX_LOSS):
        if min(tokens, segments, loss) < 1:
            raise ValueError("limits must be positive")
        self.tokens, self.segments, self.loss = tokens, segments, loss


def _loss(start, length, loss_from):
    """Loss-bearing ids among ``length`` ids from ``start`` on."""
    return np.maximum(0, start + length - np.maximum(start, loss_from))


def _taken(start, length, loss_from, tokens_left: int, loss_left: int):
    """Longest prefix of each piece that fits into the ids and the loss that are left."""
    free = np.maximum(0, loss_from - start)  # ids before the loss begins
    return np.minimum(np.minimum(length, tokens_left), free + loss_left)


def pack_block(lengths: np.ndarray, starts: np.ndarray, loss_from: np.ndarray, limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Place pieces into sequences; returns per sequence its (piece, start, length) triples in order.

    A piece that is cut keeps its number: its first ids are placed, the rest stays in the block.
    """
    length, start = lengths.astype(np.int64).copy(), starts.astype(np.int64).copy()
    loss_from = loss_from.astype(np.int64)
    alive = np.flatnonzero(length > 0)
    out: list[list[tuple[int, int, int]]] = []
    while alive.size:
        room_tokens, room_segments, room_loss = limits.tokens, limits.segments, limits.loss
        placed: list[tuple[int, int, int]] = []
        while room_tokens and room_segments and alive.size:
            n, s = length[alive], start[alive]
            take = _taken(s, n, loss_from[alive], room_tokens, room_loss)
            whole = take == n
            able = whole if whole.any() else take > 0
            if not able.any():
                break
            bears = _loss(s, take, loss_from[alive])
            product = (take / limits.tokens * (room_tokens / limits.tokens) + (1 / limits.segments) * (room_segments / limits.segments)
                       + bears / limits.loss * (room_loss / limits.loss))
            best = int(np.argmax(np.where(able, product, -1.0)))
            i, t = int(alive[best]), int(take[best])
            placed.append((i, int(start[i]), t))
            room_tokens -= t
            room_segments -= 1
            room_loss -= int(bears[best])
            start[i] += t
            length[i] -= t
            if not length[i]:
                alive = np.delete(alive, best)
        out.append(placed)
    return out


def pack_documents(docs: DataFrame, limits: Limits | None = None, tokenizer: str = BYTE_BPE, end_id: int = END_ID,
                   block_pieces: int = BLOCK_PIECES, loss_from: str | None = None, memo_pieces: int = MEMO_PIECES) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    ``ids_crc32`` is the crc32 of the piece's ids as little-endian unsigned 32-bit
    integers. ``sequence_id`` holds the partition number in its upper bits, so a
    task that is run again on another executor gives the same rows.
    """
    limits = limits or Limits()
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")]
    columns.append((F.col(loss_from).cast("bigint") if loss_from else F.lit(0).cast("bigint")).alias("loss_from"))
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_worker(PieceEncoder, tokenizer_path(tokenizer), memo_pieces)
        sequence = TaskContext.get().partitionId() << 36
        block: list[tuple] = []  # doc_id, ids of the rest, their start, ids of the document, where its loss begins
        rows: list[tuple] = []

        def place(sequence_pieces) -> None:
            nonlocal sequence
            offset = 0
            for k, (doc_id, raw, start, total, begins) in enumerate(sequence_pieces):
                n = len(raw) // 4
                rows.append((doc_id, start, n, zlib.crc32(raw), total, sequence, offset, k, int(_loss(start, n, begins))))
                offset += n
            sequence += 1

        def flush() -> None:
            lengths = np.array([len(b[1]) // 4 for b in block])
            starts = np.array([b[2] for b in block])
            begins = np.array([b[4] for b in block])
            for placed in pack_block(lengths, starts, begins, limits):
                place([(block[i][0], block[i][1][(s - block[i][2]) * 4:(s - block[i][2] + n) * 4], s, block[i][3], block[i][4])
                       for i, s, n in placed])
            block.clear()

        def emit() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
            columns = list(zip(*rows)) or [[] for _ in kinds]
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=[
                "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segment", "loss_tokens"])
            rows.clear()
            return batch

        full = limits.tokens * 4
        for batch in sliced(batches):
            for doc_id, text, begins in zip(*(c.to_pylist() for c in batch.columns)):
                raw = encoder.ids(text) + end
                total, begins = len(raw) // 4, max(0, begins or 0)
                at = 0
                while len(raw) - at >= full and _loss(at // 4, limits.tokens, begins) <= limits.loss:
                    place([(doc_id, raw[at:at + full], at // 4, total, begins)])
                    at += full
                if at < len(raw):
                    block.append((doc_id, raw[at:], at // 4, total, begins))
                if len(block) >= block_pieces:
                    flush()
                if len(rows) >= 20_000:
                    yield emit()
        flush()
        yield emit()

    return docs.select(*columns).mapInArrow(run, PIECE_SCHEMA)
