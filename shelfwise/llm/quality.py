"""Text quality by positive-unlabelled learning.

Trusted positives are documents marked good; unlabelled web text holds good and bad documents
in unknown rows; the class prior is estimated by cross-fitting (``pu``). The
classifier minimises the non-negative unbiased risk (``pu``) over features of form: how kinds of
characters follow one another, repeated neighbours, distinct words, line structure, lengths.

Only a text decides its score. Defined cases: a null or empty text is scored by its (zero)
features; ties and repeated rows get equal scores, one row each; without any trusted positive the
score is the prior for every row; further columns are not read; an empty table gives no rows.
Features are sums over the whole text, so a very long text is one pass over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from shelfwise.llm import pu
from shelfwise.llm.labelled import keep_rows, score_rows, training_texts

THRESHOLD = 0.3
TRAIN_POSITIVES = 3000
TRAIN_UNLABELLED = 6000
STEPS = 600
RATE = 0.1
DECAY = 1e-5


def _kinds() -> np.ndarray:
    """Kind of each byte: 0 space, 1 lower, 2 upper, 3 digit, 4 other white space, 5 prose punctuation, 6 other signs, 7 non-ASCII."""
    kind = np.full(256, 6, np.uint8)
    kind[ord("a"):ord("z") + 1], kind[ord("A"):ord("Z") + 1], kind[ord("0"):ord("9") + 1] = 1, 2, 3
    kind[32] = 0
    kind[[9, 10, 11, 12, 13]] = 4
    kind[[ord(c) for c in ".,;:'\"-()?"]] = 5
    kind[128:] = 7
    return kind


KINDS = _kinds()
FEATURES = 64 + 6


def features(text: str | None) -> np.ndarray:
    """Shares of the 64 pairs of byte kinds (square roots) and six word and line features."""
    text = text or ""
    kinds = KINDS[np.frombuffer(text.encode(), np.uint8)]
    n = max(1, len(kinds))
    pairs = np.bincount(kinds[:-1].astype(np.int64) * 8 + kinds[1:], minlength=64)
    words, lines = text.split(), text.split("\n")
    m = max(1, len(words))
    return np.concatenate([np.sqrt(pairs / n), [
        sum(map(eq, words, words[1:])) / m, len(set(words)) / m, np.log1p(m), n / m, len(set(lines)) / len(lines), len(lines) / m]])


class QualityModel:
    """Standardised features, weights and intercept."""

    def __init__(self, mean, spread, weights, intercept):
        self.mean, self.spread, self.weights, self.intercept = mean, spread, weights, intercept

    def standardise(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -5, 5)

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t) for t in texts]).reshape(len(texts), FEATURES)
        return pu.sigmoid(self.standardise(x) @ self.weights + self.intercept)


def fit(docs: DataFrame, labels: DataFrame, positives: int = TRAIN_POSITIVES, unlabelled: int = TRAIN_UNLABELLED) -> QualityModel:
    """Learn ``labels.quality`` from about ``positives`` trusted and ``unlabelled`` unlabelled documents (features leave the tasks, not texts)."""
    rows, prior = training_texts(docs, labels, "quality", positives, unlabelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(x, pa.binary()), batch.column(1)], names=["x", "is_positive"])

    sample = sorted((bool(r[1]), bytes(r[0])) for r in rows.mapInArrow(run, "x binary, is_positive boolean").collect())
    x = np.array([np.frombuffer(r[1]) for r in sample]).reshape(-1, FEATURES)
    trusted = np.array([r[0] for r in sample], bool)
    zero = QualityModel(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), float(np.log(prior / (1 - prior))))
    if not trusted.any() or trusted.all():
        return zero
    model = QualityModel(x[~trusted].mean(0), x[~trusted].std(0) + 1e-6, None, None)
    z = model.standardise(x)
    model.weights, model.intercept, _ = pu.fit_with_prior(pu.Dense(z[trusted]), pu.Dense(z[~trusted]), prior, steps=STEPS, rate=RATE, decay=DECAY)
    return model


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher is better), predicted (1 at or above ``threshold``)."""
    return score_rows(docs, model.score, threshold)


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` predicted good, all columns unchanged."""
    return keep_rows(docs, model.score, threshold)
