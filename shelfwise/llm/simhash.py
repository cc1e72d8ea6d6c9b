"""SimHash near-duplicates with pigeonring filtering.

A document's fingerprint has bit i set when more than half of its shingle hashes
(XXH64 with a fixed seed) have it set. Fingerprints with at most ``MAX_BITS`` differing
bits are linked; documents connected by links form a component.

Pigeonring. The 64 bits lie on a ring of m = MAX_BITS + 1 segments. If two fingerprints
differ in at most t bits, some segment starts a chain in which the differences
summed over its first l segments are at most l * t / m, for every l from 1 to m. With
m = t + 1 that means: first segment equal, at most 1 bit over the first two, at most 2
over three, and so on. The candidates' key is therefore the first two segments of the chain
(25 or 26 bits): every fingerprint is filed under its own key and looks up that key
and each key with one bit of the second segment turned over. Candidates then pass
the budgets of the longer chains, and only survivors take the full Hamming check.

Scale. Equal fingerprints are one entry (a group of exact copies of any size is one
row). Keys are shuffled and sorted; a task streams its sorted keys, so memory holds one
key's entries. Links inside a key are reduced to a spanning star before they leave the
task, never all pairs; nothing is capped. Links are joined into components by contraction
(``components``).

Defined cases: a null or empty text, or one without words, has fingerprint zero and is
linked like any other; fewer words than a shingle form one shingle; repeated rows and
equal ids are rows of their own; a null doc_id never becomes a component id unless
the whole component has none (then null); further columns are not read; empty table:
no rows. Whole texts are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.skew import join_split
from shelfwise.llm.common import materialize, release_memory, sliced
from shelfwise.llm.components import LINK_SCHEMA, components, spanning_stars

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
SMALL_KEY = 64


def fingerprints_of(texts: list[bytes | None], words_per_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """Fingerprints (unsigned 64-bit) of UTF-8 texts."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    hashes: list[np.ndarray] = []
    owners, counts = [], []
    for i, text in enumerate(texts):
        # bytes.lower changes A-Z only, bytes.split cuts at space and 0x09-0x0D only
        words = text.lower().split() if text else []
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= words_per_shingle:
            h = [xxh64_intdigest(joined, seed)]
        else:
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(sizes + 1) - 1
            starts = (ends - sizes)[:len(words) - words_per_shingle + 1].tolist()
            h = [xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts, ends[words_per_shingle - 1:].tolist())]
        hashes.append(np.array(h, np.uint64))
        owners.append(i)
        counts.append(len(h))
        if sum(map(len, hashes)) > 1 << 20:
            _vote(out, hashes, owners, counts)
    _vote(out, hashes, owners, counts)
    return out


def _vote(out: np.ndarray, hashes: list[np.ndarray], owners: list[int], counts: list[int]) -> None:
    """Set the owners' majority bits and empty the lists.

    Every byte of a 64-bit word counts one bit position over runs of at most 255 hashes.
    """
    if not hashes:
        return
    h = np.concatenate(hashes)
    n = np.array(counts)
    first = np.cumsum(n) - n
    runs = -(-n // 255)
    run_first = np.cumsum(runs) - runs
    starts = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(run_first, runs))
    ones = np.uint64(0x0101010101010101)
    value = np.zeros(len(n), np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & ones, starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        votes = np.add.reduceat(lanes, run_first, axis=0)
        for byte in range(8):
            value |= (votes[:, byte] * 2 > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    out[owners] = value
    hashes.clear(), owners.clear(), counts.clear()


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, fp) of every row; ``fp`` is the fingerprint as a signed 64-bit integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            fp = fingerprints_of(part.column(1).to_pylist(), words_per_shingle, seed)
            yield pa.record_batch([part.column(0), part.column(2), pa.array(fp.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                       F.xxhash64("text").alias("text_hash"))
    return read.mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


def ring(max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """(shift, width) of the max_bits + 1 segments of the 64 bits, the wider ones first."""
    m = max_bits + 1
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    shifts = np.cumsum([0, *widths[:-1]])
    return [(int(s), w) for s, w in zip(shifts, widths)]


def chain_keys(fp: np.ndarray, segments: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, fingerprints): for every start the own key and those with one bit of the second segment turned over."""
    m = len(segments)
    for i, (shift, width) in enumerate(segments):
        next_shift, next_width = segments[(i + 1) % m]
        head = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        tail = (fp >> np.uint64(next_shift)) & np.uint64((1 << next_width) - 1)
        base = (np.uint64(i) << np.uint64(56)) | (head << np.uint64(28))
        yield base | tail, fp
        for bit in range(next_width):
            yield base | (tail ^ np.uint64(1 << bit)), fp


def own_keys(keys: np.ndarray, fp: np.ndarray, segments: list[tuple[int, int]]) -> np.ndarray:
    """Whether each entry is filed under the key (not only looking it up)."""
    start = (keys >> np.uint64(56)).astype(np.int64)
    shift = np.array([segments[(i + 1) % len(segments)][0] for i in range(len(segments))], np.uint64)[start]
    mask = np.array([(1 << segments[(i + 1) % len(segments)][1]) - 1 for i in range(len(segments))], np.uint64)[start]
    return ((fp >> shift) & mask) == (keys & np.uint64((1 << 28) - 1))


def within(x: np.ndarray, start: int | np.ndarray, segments: list[tuple[int, int]], max_bits: int) -> np.ndarray:
    """Which differences ``x`` pass the chain budgets from ``start`` and then the full Hamming check."""
    m = len(segments)
    masks = np.array([((1 << w) - 1) << s for s, w in segments], np.uint64)
    alive = np.ones(len(x), bool)
    total = np.zeros(len(x), np.int64)
    for length in range(1, m + 1):
        total += np.bitwise_count(x & masks[(start + length - 1) % m])
        alive &= total * m <= length * max_bits
    return alive & (np.bitwise_count(x) <= max_bits)


def _links_of_key(filed: np.ndarray, entries: np.ndarray, start: int, segments, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one large key: each filed entry is only compared with entries not yet joined to it."""
    label = np.arange(len(entries))
    place = {int(v): k for k, v in enumerate(entries.tolist())}
    a, b = [], []
    for value in filed.tolist():
        mine = label[place[value]]
        other = np.flatnonzero(label != mine)
        if not other.size:
            break
        near = other[within(entries[other] ^ np.uint64(value), start, segments, max_bits)]
        if near.size:
            joined, first = np.unique(label[near], return_index=True)
            a.append(np.full(len(first), value, np.uint64))
            b.append(entries[near[first]])
            label[np.isin(label, joined)] = mine
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64),) * 2


def links_of_sorted(keys: np.ndarray, fp: np.ndarray, segments, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among entries sorted by key; whole keys only."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(edge, len(keys)))
    out_a, out_b = [], []
    for k in np.flatnonzero(size > SMALL_KEY).tolist():
        s, e = edge[k], edge[k] + size[k]
        own = own_keys(keys[s:e], fp[s:e], segments)
        a, b = _links_of_key(fp[s:e][own], fp[s:e], int(keys[s] >> np.uint64(56)), segments, max_bits)
        out_a.append(a), out_b.append(b)
    # small keys: all of them at once, one distance between the sorted entries at a time
    small = np.repeat((size > 1) & (size <= SMALL_KEY), size)
    keys, fp = keys[small], fp[small]
    if len(keys):
        own = own_keys(keys, fp, segments)
        start = (keys >> np.uint64(56)).astype(np.int64)
        for gap in range(1, SMALL_KEY):
            if gap >= len(keys):
                break
            same = np.flatnonzero((keys[gap:] == keys[:-gap]) & (own[gap:] | own[:-gap]))
            if not (keys[gap:] == keys[:-gap]).any():
                break
            good = same[within(fp[same] ^ fp[same + gap], start[same], segments, max_bits)]
            out_a.append(fp[good]), out_b.append(fp[good + gap])
    if not out_a:
        return (np.zeros(0, np.uint64),) * 2
    return np.concatenate(out_a), np.concatenate(out_b)


def fingerprint_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) that join all fingerprints of ``distinct`` (fp) at most ``max_bits`` bits apart."""
    segments = ring(max_bits)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for keys, values in chain_keys(fp, segments):
                yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(values.view(np.int64))], names=["key", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        held: list[pa.RecordBatch] = []

        def found(keys, fps):
            a, b = links_of_sorted(keys, fps, segments, max_bits)
            if len(a):
                a, b = spanning_stars(a.view(np.int64), b.view(np.int64))
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if held[0].column(0)[0].as_py() == batch.column(0)[-1].as_py() and len(keys) == 0:
                continue  # one key fills all that is held
            keys = np.concatenate([keys, *[h.column(0).to_numpy().view(np.uint64) for h in held]])
            fps = np.concatenate([fps, *[h.column(1).to_numpy().view(np.uint64) for h in held]])
            held = []
            last = int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1]))  # the last key may go on
            yield from found(keys[:last], fps[:last])
            keys, fps = keys[last:], fps[last:]
        keys = np.concatenate([keys, *[h.column(0).to_numpy().view(np.uint64) for h in held]])
        fps = np.concatenate([fps, *[h.column(1).to_numpy().view(np.uint64) for h in held]])
        if len(keys):
            yield from found(keys, fps)
        release_memory()

    filed = distinct.select("fp").mapInArrow(file, "key bigint, fp bigint")
    return filed.repartition("key").sortWithinPartitions("key").mapInArrow(search, LINK_SCHEMA)


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, words_per_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, text_hash, fp, component_id (smallest doc_id that links reach, its own included).

    ``member`` is the fingerprint that stands for the component, also where no document of it has an id.
    """
    prints = materialize(fingerprints(docs, words_per_shingle, seed), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "distinct")
    labels = components(fingerprint_links(distinct, max_bits))
    labels = labels.withColumnRenamed("node", "fp").withColumnRenamed("label", "member")
    linked = materialize(distinct.join(labels, "fp"), "linked")
    smallest = materialize(linked.groupBy("member").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members")), "smallest")
    # a component, or a group of copies, may hold any share of all rows: both joins split such keys
    joined = join_split(linked.select("fp", "copies", "member"), smallest, "member", "members").select("fp", "copies", "member", "component_id")
    alone = distinct.join(labels, "fp", "left_anti").select("fp", "copies", F.col("fp").alias("member"), F.col("first_id").alias("component_id"))
    ids = materialize(joined.unionByName(alone), "component-ids")
    return join_split(prints, ids, "fp", "copies").select("doc_id", "text_hash", "fp", "component_id", "member")


def keep_one_each(docs: DataFrame, max_bits: int = MAX_BITS, words_per_shingle: int = SHINGLE_WORDS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row, that with the smallest doc_id.

    Rows that agree in id and text count as one. Where different texts of a component
    share the smallest id, or none has an id, the smallest text hash decides.
    """
    rows = near_duplicates(docs, max_bits, words_per_shingle, seed)
    kept = (rows.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("member")
            .agg(F.min("component_id").alias("__llm_id"), F.min("text_hash").alias("__llm_hash_kept")))
    hashed = docs.withColumn("__llm_hash", F.xxhash64("text"))
    same = hashed["doc_id"].eqNullSafe(kept["__llm_id"]) & (hashed["__llm_hash"] == kept["__llm_hash_kept"])
    out = hashed.join(kept.select("__llm_id", "__llm_hash_kept"), same, "left_semi").dropDuplicates(["doc_id", "__llm_hash"])
    return out.select(*[hashed[c] for c in docs.columns])
