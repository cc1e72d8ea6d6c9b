"""What the two positive-unlabelled classifiers share: folds, bounded samples, scoring whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import HASH_BUCKETS, fold, sliced
from shelfwise.llm.pu import clipped_prior

HELD_OUT_MOD = 5
SCORE_SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def held_out(column: str = "doc_id") -> Column:
    """Whether labels of the row must not be learned (a null id: not held out, but it has no label either)."""
    return F.coalesce(fold(column, HELD_OUT_MOD) == 0, F.lit(False))


def _share(rows: int, total: int, seed: int) -> Column:
    """Whether a doc_id falls into a hash sample of about ``rows`` of ``total`` rows."""
    keep = HASH_BUCKETS if total <= rows else int(HASH_BUCKETS * rows / total)
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(HASH_BUCKETS)) < F.lit(keep)


def training_texts(docs: DataFrame, labels: DataFrame, label: str, positives: int, unlabelled: int, seed: int = 11) -> tuple[DataFrame, float]:
    """((text, is_positive) rows of a bounded sample, first guess of the class prior).

    Trusted positives are rows with ``label`` = 1 outside the held-out fold; unlabelled rows are
    any documents outside it, whatever their label, which is not looked at. The first guess is the
    share of positives among the labelled rows outside the fold.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
    n, positive = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col(label) == 1).cast("int")), F.lit(0))).first()
    # at most about `positives` ids, whatever the table's size: small enough to send to every task
    ids = known.where((F.col(label) == 1) & _share(positives, positive, seed)).select("doc_id").distinct()
    total = docs.count()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where(~held_out() & F.col("doc_id").isNotNull())
    trusted = texts.join(F.broadcast(ids), "doc_id", "left_semi").select("text", F.lit(True).alias("is_positive"))
    web = texts.where(_share(unlabelled, total, seed + 1)).select("text", F.lit(False).alias("is_positive"))
    return trusted.unionByName(web), clipped_prior(n, int(positive))


def score_rows(docs: DataFrame, score_texts: Callable[[list[str | None]], np.ndarray], threshold: float) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted (1 if the score reaches ``threshold``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            score = score_texts(part.column(2).to_pylist())
            yield pa.record_batch([part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                                  names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out().alias("held_out"), "text").mapInArrow(run, SCORE_SCHEMA)


def keep_rows(docs: DataFrame, score_texts: Callable[[list[str | None]], np.ndarray], threshold: float) -> DataFrame:
    """The rows of ``docs``, all columns unchanged, whose text scores at least ``threshold``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            yield part.filter(pa.array(score_texts(part.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)
