"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JOIN_PIECES = 1000


def join_split(rows: DataFrame, side: DataFrame, key: str, weight: str, wanted: Column | None = None, pieces: int = JOIN_PIECES) -> DataFrame:
    """``rows`` joined on ``key`` with ``side``, which holds each key once, keys with many rows cut into pieces.

    ``weight`` (a column of ``side``, not returned) is the key's number of rows in ``rows``, so the hot keys are known
    exactly before a row of them moves. A key with more than one row in ``pieces`` is dealt out over as many pieces
    as it exceeds that, and its row of ``side`` is copied to each. Fewer than ``pieces`` keys can be so
    large, so their list, which is broadcast, is bounded whatever the data. Keys that are not ``wanted`` (a
    condition on ``side``) are left out; large ones among them are dealt out all the same.

    ``side`` is read three times: pass a written table. Null keys meet nothing, as in any join.
    """
    total = side.agg(F.sum(weight)).first()[0] or 1
    cut = side.withColumn("__pieces", F.greatest(F.lit(1), F.least(F.col(weight), F.ceil(F.col(weight) * F.lit(pieces / total)))).cast("int"))
    hot = cut.where(F.col("__pieces") > 1).select(key, "__pieces")
    piece = F.pmod(F.xxhash64(*rows.columns, F.monotonically_increasing_id()), F.coalesce("__pieces", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__piece", piece).drop("__pieces")
    kept = cut if wanted is None else cut.where(wanted)
    copies = kept.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1))).drop("__pieces", weight)
    return dealt.join(copies, [key, "__piece"]).drop("__piece")
