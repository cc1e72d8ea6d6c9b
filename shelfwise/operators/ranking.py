"""Exact global percent_rank / row_number without a single-partition window.

``Window.orderBy(...)`` with no partitioning moves every row into one task. ``global_ranks`` ranks
the rows by several orders in one pass instead:

1. The input is written once to the shared folder, each row with a number. Every row is
   stacked once per order, as (order, sort keys, row number) and nothing else.
2. One range exchange by (order, sort keys, row number). The row number makes the key unique,
   so ranges are balanced even where a third of all rows tie.
3. A window ranks the rows of each order inside their range. The result is written, so range
   numbers are the same on every later read.
4. One table with a row per (range, order) carries the rows before the range and, where a
   group of ties runs on from the range before, the rank it has. It is as small as the number of ranges and broadcast.
5. One pivot by row number turns the ranks into columns, joined to the rows by that number.

``global_rank_table`` is the other form: distinct sort keys with their rank and multiplicity.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.session import checkpoint_dir


def _sort_cols(keys: list[tuple[str, bool]]) -> list[Column]:
    """(column, descending) -> sort expressions; descending sorts NULLs last, ascending first."""
    return [F.col(c).desc_nulls_last() if desc else F.col(c).asc_nulls_first() for c, desc in keys]


def global_rank_table(df: DataFrame, keys: list[tuple[str, bool]],
                      num_partitions: int | None = None) -> DataFrame:
    """Distinct key tuples with ``rank`` (1 + rows strictly before) and ``total`` rows.

    Exact, and equal to ``rank()`` over ``ORDER BY keys`` on the whole of ``df``.
    Without ``num_partitions`` the number of ranges follows the session's shuffle setting.
    """
    names = [c for c, _ in keys]
    distinct = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__m"))
    ranges = ([num_partitions] if num_partitions else []) + _sort_cols(keys)
    ranged = materialize(distinct.repartitionByRange(*ranges).withColumn("__pid", F.spark_partition_id()))
    local_w = (Window.partitionBy("__pid").orderBy(*_sort_cols(keys))
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = ranged.withColumn("__upto", F.sum("__m").over(local_w))
    per_part = ranged.groupBy("__pid").agg(F.sum("__m").alias("__pm"))
    # one row per partition: prefix offsets over n rows, then broadcast
    off_w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("__pid", F.coalesce(F.sum("__pm").over(off_w), F.lit(0)).alias("__off"),
                              F.sum("__pm").over(Window.partitionBy()).alias("total"))
    ranked = local.join(F.broadcast(offsets), "__pid")
    rank = F.col("__off") + F.col("__upto") - F.col("__m") + 1
    return ranked.select(*names, rank.alias("rank"), F.col("__m").alias("mult"), "total")


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared ``spark.checkpoint.dir``: cuts lineage so an
    input read by several rank passes is computed once and survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared scratch folder and read back: later reads prune columns and repeat nothing."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


Order = list[tuple[str, bool]]
ROW, SPEC = "__row", "__spec"
#: types whose values keep their order in a wider one, so that they share a key column
WIDER = {"float": "double", "tinyint": "bigint", "smallint": "bigint", "int": "bigint"}


def _stacked(rows: DataFrame, orders: list[Order]) -> tuple[DataFrame, list[str], list[Column]]:
    """(stacked rows, key columns, sort expressions). A key column holds one (place in the order, type, direction); other orders
    leave it null, so one sort over all key columns sorts every order by its own."""
    kind = {f.name: WIDER.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in rows.schema.fields}
    slots: dict[tuple[int, str, bool], str] = {}
    for order in orders:
        for place, (column, descending) in enumerate(order):
            slots.setdefault((place, kind[column], descending), f"__k{len(slots)}")
    slots = dict(sorted(slots.items(), key=lambda item: item[0][0]))

    def one(number: int, order: Order) -> Column:
        own = {slots[place, kind[c], d]: F.col(c) for place, (c, d) in enumerate(order)}
        keys = [own.get(name, F.lit(None)).cast(k).alias(name) for (_, k, _), name in slots.items()]
        return F.struct(F.lit(number).alias(SPEC), *keys)

    stacked = rows.select(ROW, F.explode(F.array(*[one(n, o) for n, o in enumerate(orders)])).alias("s")).select(ROW, "s.*")
    sort = [F.col(SPEC)] + [F.col(name).desc_nulls_last() if d else F.col(name).asc_nulls_first() for (_, _, d), name in slots.items()]
    return stacked, list(slots.values()), [*sort, F.col(ROW)]


def global_ranks(rows: DataFrame, orders: list[Order], num_partitions: int | None = None) -> DataFrame:
    """(row number, ``__rank0``, ``__rank1``, ...): for every order 1 + the rows strictly before, over all of ``rows``; ``__total`` rows.

    ``rows`` holds unique row numbers in ``__row`` and should be a written table.
    """
    stacked, keys, sort = _stacked(rows, orders)
    ranged = stacked.repartitionByRange(*([num_partitions] if num_partitions else []), *sort).withColumn("__pid", F.spark_partition_id())
    inside = F.rank().over(Window.partitionBy("__pid", SPEC).orderBy(*sort[1:-1])).cast("bigint")
    local = written(ranged.withColumn("__at", inside), "ranks")
    key = F.struct(*keys)
    ends = local.groupBy("__pid", SPEC).agg(F.count(F.lit(1)).alias("__n"), F.min_by(key, "__at").alias("__first"),
                                            F.max_by(key, "__at").alias("__last"), F.max("__at").alias("__begin"))
    # one row per range and order: these windows run over as many rows as there are ranges
    by_pid = Window.partitionBy(SPEC).orderBy("__pid")
    ahead = by_pid.rowsBetween(Window.unboundedPreceding, -1)
    offsets = ends.withColumn("__off", F.coalesce(F.sum("__n").over(ahead), F.lit(0)))
    # equal first and last keys of neighbours: a group of ties runs on
    runs_on = (F.col("__off") > 0) & F.col("__first").eqNullSafe(F.lag("__last").over(by_pid))
    offsets = offsets.withColumn("__on", F.coalesce(runs_on, F.lit(False)))
    # the rank of a range's last ties, unless they began in a range before
    begun = F.when((F.col("__begin") > 1) | ~F.col("__on"), F.col("__off") + F.col("__begin"))
    head = F.when(F.col("__on"), F.last(begun, ignorenulls=True).over(ahead))
    total = F.sum("__n").over(Window.partitionBy(SPEC)).alias("__pm")
    offsets = offsets.select("__pid", SPEC, "__off", head.alias("__head"), total)
    ranked = local.select(ROW, SPEC, "__pid", "__at").join(F.broadcast(offsets), ["__pid", SPEC])
    rank = F.when((F.col("__at") == 1) & F.col("__head").isNotNull(), F.col("__head")).otherwise(F.col("__off") + F.col("__at"))
    return ranked.groupBy(ROW).agg(*[F.max(F.when(F.col(SPEC) == n, rank)).alias(f"__rank{n}") for n in range(len(orders))],
                                   F.max("__pm").alias("__total"))


def _pr(rank: Column, total: Column) -> Column:
    return F.when(total <= 1, F.lit(0.0)).otherwise((rank - 1).cast("double") / (total - 1).cast("double"))


def with_row(df: DataFrame) -> DataFrame:
    """``df`` written once, each row with a number that stays."""
    return written(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def with_percent_ranks(df: DataFrame, specs: list[tuple[Order, str]], num_partitions: int | None = None) -> DataFrame:
    """``df`` plus one percent_rank column per (keys, out_col) spec, each over the whole frame; all in one pass."""
    rows = with_row(df)
    ranks = global_ranks(rows, [keys for keys, _ in specs], num_partitions)
    cols = [_pr(F.col(f"__rank{n}"), F.col("__total")).alias(out_col) for n, (_, out_col) in enumerate(specs)]
    return rows.join(ranks, ROW).select(*df.columns, *cols)


def with_percent_rank(df: DataFrame, keys: Order, out_col: str, num_partitions: int | None = None) -> DataFrame:
    """``df`` plus ``out_col`` = percent_rank() over ORDER BY keys (whole frame)."""
    return with_percent_ranks(df, [(keys, out_col)], num_partitions)


def with_row_number(df: DataFrame, keys: Order, out_col: str, count_col: str | None = None,
                    num_partitions: int | None = None) -> DataFrame:
    """``df`` plus ``out_col`` = row_number() over ORDER BY keys; keys must be unique."""
    rows = with_row(df)
    cols = [F.col("__rank0").alias(out_col)] + ([F.col("__total").alias(count_col)] if count_col else [])
    return rows.join(global_ranks(rows, [keys], num_partitions), ROW).select(*df.columns, *cols)
