"""Row orders for files that are filtered on any of several columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 6


def _number(df: DataFrame, name: str) -> Column:
    """An ordered number of the column's value (text: of its first six bytes)."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        head = F.rpad(F.hex(F.substring(c.cast("binary"), 1, 6)), 12, "0")
        return F.conv(head, 16, 10).cast("double")
    return c.cast("double")


def _bucket(value: Column, cuts: list[float]) -> Column:
    """How many of the ascending cuts lie below the value, by halving; null: 0."""
    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(value > F.lit(cuts[mid]), among(mid + 1, high)).otherwise(among(low, mid))

    return among(0, len(cuts))


def interleaved_key(df: DataFrame, cols: list[str], bits: int = BITS) -> Column:
    """A whole number that orders rows by all of ``cols`` alike: the bits of their buckets, in turns.

    A column's buckets hold about equal numbers of rows: they are cut at ``2**bits - 1`` approximate percentiles, found for
    all columns in one aggregate (so many numbers a column are fetched, whatever the rows). A value with many rows takes
    one bucket, and the buckets it would have filled stay empty.
    """
    if not 0 < len(cols) * bits <= 62:
        raise ValueError(f"{len(cols)} columns of {bits} bits do not fit a key")
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    found = df.agg(*[F.percentile_approx(_number(df, c), shares, 10_000) for c in cols]).first()
    key = F.lit(0).cast("bigint")
    for at, (name, cuts) in enumerate(zip(cols, found)):
        bucket = _bucket(_number(df, name), sorted(set(cuts or []))).cast("bigint")
        for bit in range(bits):
            key = key + F.shiftleft(F.shiftright(bucket, bit) % 2, bit * len(cols) + len(cols) - 1 - at)
    return key
