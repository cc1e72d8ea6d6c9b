"""Benchmark decontamination by greedy string tiling.

A document is contaminated by a test item when non-overlapping common passages, wherever and in
whatever order they stand, cover at least ``COVERAGE`` of the item's words.

1. Seeds: every run of ``MIN_MATCH`` words has a Karp-Rabin hash, rolled along the text. Equal seeds of the
   items form a class; document runs are looked up by hash and verified word by word.
2. A text's seeds are collapsed to their distinct classes, and items that these cannot cover far enough, all
   overlaps allowed, are dropped: tiles can never cover more.
3. For the pairs left, maximal matches are made from their two ends alone (a seed whose words before it, or
   after it, differ), never from the seeds inside, so a text of one repeated word costs a match a word.
4. Greedy string tiling: the longest match whose words are all unmarked becomes a tile and its words are
   marked in both texts; a match that meets marked words shrinks to its unmarked stretches. Until no stretch
   of ``MIN_MATCH`` words is left.

Memory: a text's words take four bytes each; ends are made for ``ENDS_AT_ONCE`` at a time, and of matches with equal
item place and length only the first are kept that tiles could ever spoil in the document (``spoilable``),
which changes no tile. So what a pair holds follows from the item, not from the length of the document.

Documents never move: the items travel to them. Items are sent in chunks of at most ``CHUNK_BYTES`` of
text, each with its own pass over the documents; the driver fetches one chunk after the other.

Defined cases: words are runs between white space and ASCII punctuation, lower-cased; null and empty texts
hold no words and are clean; items with fewer than ``MIN_MATCH`` words cannot be matched and are left out;
repeated items (same id and text) count once, repeated documents are rows of their own; equal-length
matches are taken in document order; further columns are not read; empty tables: no pairs, all rows clean.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import sliced

MIN_MATCH = 5
COVERAGE = 0.6
CHUNK_BYTES = 16 << 20
FILTER_BITS = 20
#: bytes of a text, or words of several, that are looked up at once
PIECE = 1 << 20
#: ends of matches that are held at once
ENDS_AT_ONCE = 1 << 18
SLICE = 256

#: ASCII bytes that are no letters or digits separate words
SEPARATORS = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
PAIR_SCHEMA = "doc_id bigint, item_id bigint, coverage double, covered_words int, item_words int, tiles int, longest_tile int"


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(SEPARATORS).split() if text else []


#: the base of the runs' hashes; odd, so that it has an inverse modulo 2**64
HASH_BASE = 0xD6E8FEB86659FD93


def rolling(ids: np.ndarray, width: int, base: int = HASH_BASE) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all runs of ``width`` ids, each from its neighbour by differences of one running sum."""
    if len(ids) < width:
        return np.zeros(0, np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    x *= np.uint64(0x9E3779B97F4A7C15)  # small ids become wide values
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC2B2AE3D27D4EB4F)
    powers = [np.full(len(x), b, np.uint64) for b in (base, pow(base, -1, 1 << 64))]
    for power in powers:
        power[0] = 1
        np.cumprod(power, out=power)
    # the inverse power of its place goes into each word and the run's place comes out again: equal runs agree wherever they stand
    x *= powers[1]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    return (sums[width:] - sums[:-width]) * powers[0][:len(sums) - width]


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers first[k], first[k] + 1, ... (n[k] of them) for every k, one after the other."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


def spoilable(length: np.ndarray, item_words: int, min_match: int) -> np.ndarray:
    """How many matches of one item place and length tiles can meet in the document, at most.

    Tiles are disjoint in the item: at most ``item_words // min_match``, of ``item_words`` words in all. A tile of m words meets
    fewer than m + length of such matches. One more than all these is untouched and goes before every later one.
    """
    return (item_words // min_match) * length + item_words + 1


def first_matches(matches: np.ndarray, item_words: int, min_match: int) -> np.ndarray:
    """Of the (document place, item place, words) columns, the earliest that can matter per item place and length."""
    s, t, n = matches
    order = np.lexsort((s, t, n))
    s, t, n = s[order], t[order], n[order]
    new = np.concatenate([[True], (np.diff(t) != 0) | (np.diff(n) != 0)]) if len(s) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0)) if len(s) else np.zeros(0, np.int64)
    keep = np.arange(len(s)) - first < spoilable(n, item_words, min_match)
    return np.stack([s[keep], t[keep], n[keep]])


def greedy_tiles(matches: np.ndarray, item_words: int, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (document place, item place, words) of greedy string tiling from maximal matches."""
    heap = [(-n, s, t) for s, t, n in matches.T.tolist()]
    heapq.heapify(heap)
    in_doc: set[int] = set()
    in_item = bytearray(item_words)
    tiles = []
    while heap:
        n, s, t = heapq.heappop(heap)
        n = -n
        free = [s + k not in in_doc and not in_item[t + k] for k in range(n)]
        if all(free):
            tiles.append((s, t, n))
            in_doc.update(range(s, s + n))
            in_item[t:t + n] = b"\x01" * n
            if all(in_item):
                break
            continue
        k = 0
        while k < n:
            if not free[k]:
                k += 1
                continue
            e = k
            while e < n and free[e]:
                e += 1
            if e - k >= min_match:
                heapq.heappush(heap, (-(e - k), s + k, t + k))
            k = e
    return tiles


class SeedTable:
    """Seeds of one chunk of items, in classes of equal words."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_match: int = MIN_MATCH):
        self.min_match = min_match
        self.vocabulary: dict[bytes, int] = {}
        self.ids, self.items = [], []
        for item_id, text in items:
            words = words_of(text)
            if len(words) >= min_match:
                self.ids.append(item_id)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int32))
        sizes = np.array([len(i) for i in self.items], np.int64)
        self.sizes, self.base = sizes, np.cumsum(sizes) - sizes
        self.flat = np.concatenate(self.items) if self.items else np.zeros(0, np.int32)
        seeds = np.maximum(sizes - min_match + 1, 0)
        owner = np.repeat(np.arange(len(sizes)), seeds)
        place = spread(np.zeros(len(sizes), np.int64), seeds)
        run = np.arange(min_match)
        self.multiplier = HASH_BASE
        while True:
            h = rolling(self.flat, min_match, self.multiplier)[self.base[owner] + place]
            self.hashes, some, cls = np.unique(h, return_index=True, return_inverse=True)
            self.sample = (self.base[owner] + place)[some]
            step = 1 << 20
            if all((self.flat[(self.base[owner] + place)[k:k + step, None] + run] == self.flat[self.sample[cls[k:k + step], None] + run]).all()
                   for k in range(0, len(cls), step)):
                break
            self.multiplier += 0x1000000000000042  # different words met in one hash: another base (still odd)
            self.multiplier = self.multiplier & (2**64 - 1) | 1
        self.class_of = cls  # per seed, items one after the other
        self.first_seed = np.cumsum(seeds) - seeds
        order = np.argsort(cls, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.ends = np.searchsorted(cls[order], np.arange(len(self.hashes) + 1))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def words(self, text: str | None) -> Iterator[np.ndarray]:
        """The text's words as ids (0: no item holds it), piece by piece."""
        data = text.lower().encode().translate(SEPARATORS) if text else b""
        at = 0
        while at < len(data):
            end = data.find(b" ", at + PIECE)
            end = len(data) if end < 0 else end
            found = data[at:end].split()
            yield np.fromiter((self.vocabulary.get(w, 0) for w in found), np.int32, len(found))
            at = end

    def classes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``ids``, class) of all verified seeds."""
        at, cls = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for start in range(0, len(ids) if len(self.hashes) else 0, PIECE):
            part = ids[start:start + PIECE + self.min_match - 1]
            h = rolling(part, self.min_match, self.multiplier)
            maybe = np.flatnonzero(self.filter[h >> np.uint64(64 - FILTER_BITS)])
            c = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
            same = self.hashes[c] == h[maybe]
            maybe, c = maybe[same], c[same]
            same = np.ones(len(maybe), bool)
            for k in range(self.min_match):
                same &= part[maybe + k] == self.flat[self.sample[c] + k]
            at.append(maybe[same] + start), cls.append(c[same].astype(np.int32))
        return np.concatenate(at), np.concatenate(cls)

    def coverable(self, classes: np.ndarray, coverage: float) -> np.ndarray:
        """Items of which the seeds of the (distinct) classes cover at least the share, overlaps allowed."""
        n = self.ends[classes + 1] - self.ends[classes]
        seed = spread(self.ends[classes], n)
        owner, place = self.owner[seed], self.place[seed]
        order = np.lexsort((place, owner))
        owner, place = owner[order], place[order]
        reach = np.full(len(place), self.min_match, np.int64)
        near = np.diff(owner) == 0
        reach[:-1][near] = np.minimum(np.diff(place)[near], self.min_match)
        items, first = np.unique(owner, return_index=True)
        return items[np.add.reduceat(reach, first) >= coverage * self.sizes[items]] if len(items) else items

    def matches(self, ids: np.ndarray, at: np.ndarray, cls: np.ndarray, item: int) -> np.ndarray:
        """Maximal matches, as columns (place in ``ids``, item place, words), of one item with a text's seeds in document order."""
        words, width = self.items[item], self.min_match
        size = len(words)
        of = self.class_of[self.first_seed[item]:self.first_seed[item] + size - width + 1]
        kinds, kind = np.unique(of, return_inverse=True)
        scale = len(self.vocabulary) + 2
        # per side: the item's seeds by the word next to them (the item's edge: -1)
        by_side = []
        for beside in (np.concatenate([[-1], words])[:size - width + 1], np.concatenate([words, [-1]])[width:]):
            key = kind * scale + beside + 1
            order = np.argsort(key, kind="stable")
            by_side.append((order, key[order]))
        found, waiting, held = [np.zeros((3, 0), np.int64)], np.zeros((2, 0), np.int64), 0
        for block in range(0, len(at), ENDS_AT_ONCE):
            places = at[block:block + ENDS_AT_ONCE]
            mine = np.minimum(np.searchsorted(kinds, cls[block:block + ENDS_AT_ONCE]), len(kinds) - 1)
            same = kinds[mine] == cls[block:block + ENDS_AT_ONCE]
            places, mine = places[same], mine[same]
            # the word next to a seed in the document (its edge, or a word of no item: 0, which no item's seed has beside it)
            before = np.where(places > 0, ids[places - 1], 0)
            after = np.where(places + width < len(ids), ids[np.minimum(places + width, len(ids) - 1)], 0)
            sides = []
            for (order, key), beside in zip(by_side, (before, after)):
                low, high = np.searchsorted(key, mine * scale), np.searchsorted(key, (mine + 1) * scale)
                wanted = mine * scale + beside + 1
                left, right = np.searchsorted(key, wanted), np.searchsorted(key, wanted, "right")
                sides.append((order, low, left - low, right, high - right))
            made = np.cumsum(sum(n + m for _, _, n, _, m in sides))
            start = 0
            while start < len(places):
                stop = max(start + 1, int(np.searchsorted(made, (made[start - 1] if start else 0) + ENDS_AT_ONCE, "right")))
                i, j, is_end = [waiting[0]], [waiting[1]], [np.zeros(waiting.shape[1], bool)]
                for last, (order, low, n, right, m) in zip((False, True), sides):
                    for first, count in ((low, n), (right, m)):
                        count = count[start:stop]
                        i.append(np.repeat(places[start:stop], count))
                        j.append(order[spread(first[start:stop], count)])
                        is_end.append(np.full(len(i[-1]), last))
                i, j, is_end = np.concatenate(i), np.concatenate(j), np.concatenate(is_end)
                # along a diagonal starts and ends take turns; a start without an end waits for the next places
                order = np.lexsort((is_end, i, j - i))
                i, j, is_end = i[order], j[order], is_end[order]
                closing = np.flatnonzero(is_end)
                found.append(np.stack([i[closing - 1], j[closing - 1], i[closing] - i[closing - 1] + width]))
                held += len(closing)
                unclosed = ~is_end
                unclosed[closing - 1] = False
                waiting = np.stack([i[unclosed], j[unclosed]])
                if held > ENDS_AT_ONCE:
                    found, held = [first_matches(np.concatenate(found, axis=1), size, width)], 0
                start = stop
        return first_matches(np.concatenate(found, axis=1), size, width)

    def contaminations(self, texts: Iterable[str | None], coverage: float = COVERAGE) -> Iterator[tuple]:
        """(text number, item id, coverage, covered, item words, tiles, longest) of every contaminated pair."""
        if not self.items:
            return
        pieces, ends, words, first = [], [], 0, 0
        for number, text in enumerate(texts):
            for piece in self.words(text):
                pieces.append(piece)
                words += len(piece)
            # a zero after each text belongs to no item, so no run crosses from one text into the next
            pieces.append(np.zeros(1, np.int32))
            words += 1
            ends.append(words)
            if words >= PIECE:
                yield from self._pairs(np.concatenate(pieces), np.array(ends), first, coverage)
                pieces, ends, words, first = [], [], 0, number + 1
        if pieces:
            yield from self._pairs(np.concatenate(pieces), np.array(ends), first, coverage)

    def _pairs(self, ids: np.ndarray, ends: np.ndarray, first: int, coverage: float) -> Iterator[tuple]:
        at, cls = self.classes(ids)
        cuts = np.searchsorted(at, ends)
        for k, (low, high) in enumerate(zip(np.concatenate([[0], cuts[:-1]]).tolist(), cuts.tolist())):
            if low == high:
                continue
            begin, end = (int(ends[k - 1]) if k else 0), int(ends[k])
            for item in self.coverable(np.unique(cls[low:high]), coverage).tolist():
                size = int(self.sizes[item])
                tiles = greedy_tiles(self.matches(ids[begin:end], at[low:high] - begin, cls[low:high], item), size, self.min_match)
                covered = sum(n for _, _, n in tiles)
                if covered >= coverage * size:
                    yield first + k, self.ids[item], covered / size, covered, size, len(tiles), max(n for _, _, n in tiles)


def benchmark_chunks(benchmark: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> Iterator[list[tuple]]:
    """The distinct items in chunks whose text is about ``chunk_bytes`` at most; a chunk is fetched when it is asked for."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where(F.col("text").isNotNull()).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // chunk_bytes))
    chunk = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for c in range(n):
        yield sorted(((r[0], r[1]) for r in items.where(chunk == c).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH,
                       chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per contaminated (document, item): how much of the item tiles cover, and their number and greatest length."""
    def pass_over(items: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = SeedTable(items, min_match)
            for part in sliced(batches, SLICE):
                found = list(table.contaminations(part.column(1).to_pylist(), coverage))
                if found:
                    doc_ids = part.column(0).to_pylist()
                    cols = list(zip(*[(doc_ids[f[0]], *f[1:]) for f in found]))
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=[
                        "doc_id", "item_id", "coverage", "covered_words", "item_words", "tiles", "longest_tile"])

        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, PAIR_SCHEMA)

    # one chunk after the other becomes a pass, so that the driver holds one at a time
    return reduce(DataFrame.unionByName, map(pass_over, benchmark_chunks(benchmark, chunk_bytes)))


def keep_clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, min_match: int = MIN_MATCH,
               chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, that no item contaminates."""
    at, schema = docs.columns.index("text"), docs.schema

    def pass_over(rows: DataFrame, items: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = SeedTable(items, min_match)
            for part in sliced(batches, SLICE):
                keep = np.ones(part.num_rows, bool)
                keep[[found[0] for found in table.contaminations(part.column(at).to_pylist(), coverage)]] = False
                yield part.filter(pa.array(keep))

        return rows.mapInArrow(run, schema)

    for items in benchmark_chunks(benchmark, chunk_bytes):
        docs = pass_over(docs, items)
    return docs
