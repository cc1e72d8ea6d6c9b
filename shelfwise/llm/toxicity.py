"""Toxicity by non-negative positive-unlabelled learning over hashed byte grams.

Confirmed toxic documents are the positives, any documents the unlabelled rows. Features are
the hashed byte grams (of 5 and of 8 bytes) of the lower-cased text with everything but letters read as a
space, by presence and by density: whether the gram is there, and whether it is at least the shares ``DENSITIES`` of the
text's grams (a long text holds by chance once what a toxic one repeats). Features that at least ``LEAST_DOCUMENTS`` positives hold and whose excess over
the unlabelled rows that are not among them is significant (``LEAST_Z`` standard errors) are kept, however small their share of all positives, so
the wording of a small language counts; ``FEATURES`` bounds their number. Each is valued by its contrast, and a linear classifier minimises the class-prior-corrected, non-negative risk (``pu``); the class prior of the
unlabelled rows is estimated by cross-fitting.

Only a text decides its score. Defined cases: a null or empty text has no gram and scores as the
intercept says; repeated rows get equal scores, one row each; without any confirmed example the
score is the prior for every row; further columns are not read; an empty table gives no rows.
Grams of a long text are hashed in pieces of ``PIECE`` bytes that overlap by a gram less one byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import pu
from shelfwise.llm.common import materialize, sliced
from shelfwise.llm.labelled import keep_rows, score_rows, training_texts

THRESHOLD = 0.5
TRAIN_POSITIVES = 2000
TRAIN_UNLABELLED = 6000
GRAMS = (5, 8)
HASH_BITS = 20
DENSITIES = (0.0004, 0.001)
MARKS = (1 + len(DENSITIES)) << HASH_BITS
FEATURES = 20000
LEAST_DOCUMENTS = 4
LEAST_Z = 4.0
STEPS = 300
RATE = 0.05
DECAY = 1e-4
PIECE = 1 << 20


def grams(text: str | None) -> Iterator[np.ndarray]:
    """Hash numbers of the text's byte grams, piece by piece, repeats included."""
    if not text:
        return
    data = np.frombuffer(b" " + text.lower().encode() + b" ", np.uint8)
    longest = max(GRAMS)
    for start in range(0, len(data), PIECE):
        part = data[start:start + PIECE + longest - 1]
        letters = ((part >= 97) & (part <= 122)) | (part >= 128)
        part = np.where(letters, part, 32).astype(np.uint32)
        for size in GRAMS:
            # a gram belongs to the piece in which it starts
            n = min(PIECE, len(part) - size + 1)
            if n < 1:
                continue
            h = np.full(n, size, np.uint32)
            for i in range(size):
                h *= np.uint32(0x01000193)
                h += part[i:n + i]
            h *= np.uint32(2654435761)
            yield h >> np.uint32(32 - HASH_BITS)


def marks(text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
    """Distinct marks of a text, ascending: its grams, then per density those that reach it; with ``wanted`` (per gram) of these grams only."""
    total, found = 0, [np.zeros(0, np.uint32)]
    for h in grams(text):
        total += len(h)
        found.append(h if wanted is None else h[wanted[h]])
    held, times = np.unique(np.concatenate(found), return_counts=True)
    return np.concatenate([held, *(held[times >= least * total] + np.uint32(k << HASH_BITS) for k, least in enumerate(DENSITIES, 1))])


class ToxicityModel:
    """Feature number per mark (-1: none), weights and intercept."""

    def __init__(self, number: np.ndarray, weights: np.ndarray, intercept: float):
        self.number, self.weights, self.intercept = number, weights, intercept
        self.wanted = (number.reshape(-1, 1 << HASH_BITS) >= 0).any(axis=0)

    def features(self, text: str | None) -> np.ndarray:
        found = self.number[marks(text, self.wanted)]
        return found[found >= 0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        return pu.sigmoid(np.array([self.weights[self.features(t)].sum() + self.intercept for t in texts], float))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, is_positive) to the text's marks and a hash of all of them."""
    for part in sliced(batches):
        x = [marks(t).astype("<u4") for t in part.column(0).to_pylist()]
        yield pa.record_batch([pa.array([v.tobytes() for v in x], pa.binary()), pa.array([blake2b(v.tobytes(), digest_size=16).digest() for v in x], pa.binary()),
                               part.column(1)], names=["x", "all_marks", "is_positive"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, all_marks, is_positive) to (mark, texts of either kind that hold it) of the task's rows."""
    held = np.zeros((2, MARKS), np.int32)
    for part in sliced(batches):
        for x, positive in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
            held[int(positive)][np.frombuffer(x, "<u4")] += 1
    found = np.flatnonzero(held.any(axis=0))
    yield pa.record_batch([pa.array(found, pa.int64()), pa.array(held[1][found], pa.int64()), pa.array(held[0][found], pa.int64())],
                          names=["mark", "in_p", "in_u"])


def fit(docs: DataFrame, labels: DataFrame, positives: int = TRAIN_POSITIVES, unlabelled: int = TRAIN_UNLABELLED) -> ToxicityModel:
    """Learn ``labels.toxic`` from about ``positives`` confirmed and ``unlabelled`` unlabelled documents.

    Marks are counted by Spark; the driver gets the significant ones, and then each sampled text's kept marks.
    """
    rows, prior = training_texts(docs, labels, "toxic", positives, unlabelled)
    # copies count once: texts of a kind that hold exactly the same marks
    sample = materialize(rows.mapInArrow(_hashed, "x binary, all_marks binary, is_positive boolean")
                         .dropDuplicates(["is_positive", "all_marks"]), "toxicity-sample")
    n_p, n_u = sample.agg(F.count_if("is_positive"), F.count_if(~F.col("is_positive"))).first()
    start = float(np.log(prior / (1 - prior)))
    untaught = ToxicityModel(np.full(MARKS, -1, np.int32), np.zeros(1), start)
    if not n_p or not n_u:
        return untaught
    # an unlabelled row that is itself a confirmed text says nothing about what else holds a gram
    confirmed = sample.where("is_positive").select("all_marks")
    counted = sample.where("is_positive").unionByName(sample.where(~F.col("is_positive")).join(F.broadcast(confirmed), "all_marks", "left_anti").select(sample.columns))
    n_u = counted.where(~F.col("is_positive")).count()
    if not n_u:
        return untaught
    counts = counted.mapInArrow(_counted, "mark bigint, in_p bigint, in_u bigint").groupBy("mark").agg(F.sum("in_p").alias("in_p"), F.sum("in_u").alias("in_u"))
    share = (F.col("in_p") + F.col("in_u")) / F.lit(n_p + n_u)
    contrast = (F.col("in_p") / n_p - F.col("in_u") / n_u) / F.sqrt(share * (1 - share) + 1e-9)
    # the contrast is the excess in standard errors of a gram that both kinds hold alike, over this scale
    least = LEAST_Z / float(np.sqrt(n_p * n_u / (n_p + n_u)))
    best = (counts.where(F.col("in_p") >= LEAST_DOCUMENTS).select("mark", contrast.alias("contrast"))
            .where(F.col("contrast") >= least).orderBy(F.desc("contrast"), F.asc("mark")).limit(FEATURES).collect())
    if not best:
        return untaught
    number = untaught.number.copy()
    number[[r[0] for r in best]] = np.arange(len(best))
    value = np.array([r[1] for r in best]) / best[0][1]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            found = [number[np.frombuffer(x, "<u4")] for x in part.column(0).to_pylist()]
            yield pa.record_batch([pa.array([f[f >= 0].astype("<u4").tobytes() for f in found], pa.binary()), part.column(2)], names=["x", "is_positive"])

    texts = sorted((bool(r[1]), bytes(r[0])) for r in sample.mapInArrow(kept, "x binary, is_positive boolean").collect())

    def sparse(which: bool) -> pu.Present:
        found = [np.frombuffer(x, "<u4") for t, x in texts if t == which]
        return pu.Present(np.concatenate(found), np.array([len(f) for f in found]), value)

    weights, intercept, _ = pu.fit_with_prior(sparse(True), sparse(False), prior, steps=STEPS, rate=RATE, decay=DECAY)
    return ToxicityModel(number, weights * value, intercept)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: more likely toxic), predicted (1 at or above ``threshold``)."""
    return score_rows(docs, model.score, threshold)


def keep_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` predicted toxic, all columns unchanged (for review)."""
    return keep_rows(docs, model.score, threshold)
