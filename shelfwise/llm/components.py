"""Connected components of a large link table by randomised contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import materialize

LINK_SCHEMA = "a bigint, b bigint"


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest links that join what the links (a, b) join: every node to the smallest of its component."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[:len(a)], index[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _thin(links: DataFrame) -> DataFrame:
    """Replace the links of each task's batches by spanning stars: as many rows as nodes at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = spanning_stars(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, LINK_SCHEMA)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of ``links`` (a, b): equal labels, and only those, are connected.

    Each round gives every node a random rank, lets it join its lowest-ranked
    neighbour if that ranks below itself, and contracts: links between labels that
    became equal vanish. A constant share of the nodes goes in every round whatever
    the graph's shape (a long chain included), so the rounds grow with the logarithm
    of the node count. Every round's tables are written to the shared folder.
    """
    edges = materialize(_thin(links.where(F.col("a") != F.col("b"))), "links")
    labels = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = labels.withColumn("label", F.col("node"))
    round_number = 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.lit(round_number), F.col(c)), F.col(c))
        lowest = both.groupBy("a").agg(F.min(rank("b")).alias("best"))
        joins = lowest.where(F.col("best") < rank("a")).select(F.col("a").alias("old"), F.col("best")["b"].alias("new"))
        joins = materialize(joins, "joins")
        labels = materialize(labels.join(joins, labels["label"] == joins["old"], "left")
                             .select("node", F.coalesce("new", "label").alias("label")), "labels")
        for end in ("a", "b"):
            edges = (edges.join(joins.withColumnRenamed("old", end), end, "left")
                     .withColumn(end, F.coalesce("new", end)).drop("new"))
        edges = materialize(_thin(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct()), "links")
        round_number += 1
    return labels
