"""Seasonal demand forecast per product (I5): piecewise trend, weekdays and yearly waves by ridge regression.

y(d), the units of day d, zero-filled from a product's first sale to the global last day, is fitted by

* an intercept and a trend that may bend at ``KNOTS`` days, spaced evenly over the calendar of all sales,
* an effect per weekday, and
* ``WAVES`` sine and cosine pairs of the year,

with a ridge penalty on all but the intercept. The basis depends on the calendar day alone, so the normal
equations part in two: the Gram matrix depends on the product's first day only and is read off suffix sums over
the calendar; the right side is a sum over the sparse sales rows, one partial (map-side) aggregate per product. No
product's rows meet in one task, and neither the dense grid nor its basis is shuffled. The systems, one row of
``size`` numbers per product, are solved in batches inside Arrow tasks.

Defined cases: rows without a product, date or quantity are left out; a product of one day is held by the penalty alone;
negative forecasts become 0; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.operators.forecast import HORIZON_DAYS

KNOTS = 4
WAVES = 3
YEAR = 365.25
PENALTY = 1.0


class Basis(NamedTuple):
    """The basis over the days ``first`` to ``last`` (days since 1970-01-01)."""

    first: int
    last: int
    knots: int = KNOTS
    waves: int = WAVES

    def bends(self) -> list[int]:
        return [(self.last - self.first) * k // (self.knots + 1) for k in range(1, self.knots + 1)]

    def size(self) -> int:
        return 2 + self.knots + 6 + 2 * self.waves

    def columns(self, day: Column) -> list[Column]:
        """The basis functions as Spark columns of a day number."""
        t = (day - F.lit(self.first)).cast("double")
        turns = [day * F.lit(2 * np.pi * m / YEAR) for m in range(1, self.waves + 1)]
        return [F.lit(1.0), t, *[F.greatest(t - F.lit(float(b)), F.lit(0.0)) for b in self.bends()],
                *[(F.pmod(day, F.lit(7)) == k).cast("double") for k in range(1, 7)],
                *[F.sin(x) for x in turns], *[F.cos(x) for x in turns]]

    def matrix(self, days: np.ndarray) -> np.ndarray:
        """The basis functions as rows of numbers, in the order of ``columns``."""
        t = (days - self.first).astype(float)
        turns = [days * (2 * np.pi * m / YEAR) for m in range(1, self.waves + 1)]
        return np.stack([np.ones(len(days)), t, *[np.maximum(t - b, 0) for b in self.bends()],
                         *[(days % 7 == k).astype(float) for k in range(1, 7)],
                         *[np.sin(x) for x in turns], *[np.cos(x) for x in turns]], axis=1)

    def scale(self) -> np.ndarray:
        """What the columns are divided by: the calendar's length for the trends, so that one penalty suits all."""
        out = np.ones(self.size())
        out[1:2 + self.knots] = max(1, self.last - self.first)
        return out


def sold(sales: DataFrame, date_col: str = "OrderDate", qty_col: str = "OrderQuantity") -> DataFrame:
    """(ProductKey, d, q): product, day number and units of the sales that take part."""
    return sales.select("ProductKey", F.unix_date(F.col(date_col).cast("date")).alias("d"), F.col(qty_col).cast("double").alias("q")).dropna()


def calendar(rows: DataFrame, knots: int = KNOTS, waves: int = WAVES) -> Basis:
    """The basis over the days of all ``sold`` rows (two numbers fetched); of one day without any."""
    first, last = rows.agg(F.min("d"), F.max("d")).first()
    return Basis(first or 0, last or 0, knots, waves)


def right_sides(rows: DataFrame, basis: Basis) -> DataFrame:
    """(ProductKey, d0, sums): first day and the sum of units times each basis function, one pass over the ``sold`` rows."""
    sums = [F.sum(F.col("q") * f) for f in basis.columns(F.col("d"))]
    return rows.groupBy("ProductKey").agg(F.min("d").alias("d0"), F.array(*sums).alias("sums"))


def gram_from(basis: Basis) -> np.ndarray:
    """Per day of the calendar the (scaled) Gram matrix of the days from it to the last."""
    x = basis.matrix(np.arange(basis.first, basis.last + 1)) / basis.scale()
    return np.cumsum((x[:, :, None] * x[:, None, :])[::-1], axis=0)[::-1]


def solve(basis: Basis, gram: np.ndarray, d0: np.ndarray, sums: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients of the scaled basis, fitted right sides) of many products."""
    ridge = penalty * np.diag([0.0] + [1.0] * (basis.size() - 1))
    left = gram[d0 - basis.first] + ridge
    beta = np.linalg.solve(left, (sums / basis.scale())[:, :, None])
    return beta[:, :, 0], (left @ beta)[:, :, 0] * basis.scale()


def _solved(rows: DataFrame, basis: Basis, penalty: float, name: str, made, kind: str) -> DataFrame:
    """``rows`` of ``right_sides`` with an array column that ``made(beta, fitted)`` computes per batch."""
    key = rows.schema["ProductKey"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram = gram_from(basis)
        for batch in batches:
            if len(batch):
                beta, fitted = solve(basis, gram, batch["d0"].to_numpy(), np.stack(batch["sums"].to_list()), penalty)
                yield pd.DataFrame({"ProductKey": batch["ProductKey"], "sums": batch["sums"], name: list(made(beta, fitted))})

    return rows.mapInPandas(run, f"ProductKey {key}, sums array<double>, {name} {kind}")


def seasonal_forecast(sales: DataFrame, horizon: int = HORIZON_DAYS, date_col: str = "OrderDate", qty_col: str = "OrderQuantity",
                      penalty: float = PENALTY, knots: int = KNOTS, waves: int = WAVES) -> DataFrame:
    """(ProductKey, ds, yhat) for the ``horizon`` days after the global last day; rounding and clipping as in ``forecast``."""
    rows = sold(sales, date_col, qty_col)
    basis = calendar(rows, knots, waves)
    ahead = basis.matrix(np.arange(basis.last + 1, basis.last + 1 + horizon)) / basis.scale()
    rows = _solved(right_sides(rows, basis), basis, penalty, "raw", lambda beta, _: beta @ ahead.T, "array<double>")
    days = rows.select("ProductKey", F.posexplode("raw").alias("h", "raw"))
    return days.select("ProductKey", F.date_from_unix_date(F.col("h") + F.lit(basis.last + 1)).alias("ds"),
                       F.bround(F.round(F.greatest("raw", F.lit(0.0)), 6), 0).alias("yhat"))


def seasonal_equations(sales: DataFrame, date_col: str = "OrderDate", qty_col: str = "OrderQuantity", penalty: float = PENALTY,
                       knots: int = KNOTS, waves: int = WAVES) -> DataFrame:
    """(ProductKey, feature, observed, fitted): both sides of every product's normal equations.

    They agree exactly where the coefficients minimise the penalised squared error, and nowhere else.
    """
    rows = sold(sales, date_col, qty_col)
    basis = calendar(rows, knots, waves)
    rows = _solved(right_sides(rows, basis), basis, penalty, "fitted", lambda _, fitted: fitted, "array<double>")
    pairs = rows.select("ProductKey", F.posexplode(F.arrays_zip(F.col("sums").alias("observed"), F.col("fitted").alias("fitted"))).alias("feature", "p"))
    # adding 0.0 turns a rounded negative zero into zero
    return pairs.select("ProductKey", "feature", *[(F.round(F.col("p")[c], 3) + F.lit(0.0)).alias(c) for c in ("observed", "fitted")])
