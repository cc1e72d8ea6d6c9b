"""Column-expression helpers. All are JVM-side built-ins (codegen friendly)."""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def col_(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: str | Column) -> Column:
    """Warehouse money type: fixed-point, so sums are exact and order-independent."""
    return col_(c).cast(MONEY)


def date_key(d: str | Column) -> Column:
    """yyyymmdd integer key of a date."""
    d = col_(d)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def fiscal_year(d: str | Column, start_month: int = 7) -> Column:
    """Fiscal year named after the calendar year it ends in."""
    d = col_(d)
    return (F.year(d) + F.when(F.month(d) >= start_month, 1).otherwise(0)).cast("int")


def as_of_date(as_of: str | _dt.date) -> Column:
    return F.lit(as_of if isinstance(as_of, _dt.date) else _dt.date.fromisoformat(as_of))


def age_floor_years(birth: str | Column, as_of: str | _dt.date) -> Column:
    """Whole years: floor(days / 365.25) (mining views)."""
    return F.floor(F.datediff(as_of_date(as_of), col_(birth)) / F.lit(365.25)).cast("int")


def age_fraction_years(birth: str | Column, as_of: str | _dt.date) -> Column:
    """Fractional years: days / 365 (propensity feature)."""
    return F.datediff(as_of_date(as_of), col_(birth)) / F.lit(365)


# Income band edges of the targeted-mailing segmentation.
INCOME_LOW_BELOW = 40000
INCOME_HIGH_ABOVE = 60000


def income_group(income: str | Column) -> Column:
    """'Low' below 40000, 'High' above 60000, else (including NULL) 'Moderate'."""
    i = col_(income)
    return (F.when(i < INCOME_LOW_BELOW, "Low")
            .when(i > INCOME_HIGH_ABOVE, "High")
            .otherwise("Moderate"))


def mapped(c: str | Column, mapping: dict, default: Column | None = None) -> Column:
    """CASE c WHEN k THEN v ... ELSE default END as a when-chain (stays in codegen)."""
    c = col_(c)
    items = list(mapping.items())
    if not items:
        return default if default is not None else c
    expr = reduce(lambda acc, kv: acc.when(c == kv[0], F.lit(kv[1])),
                  items[1:], F.when(c == items[0][0], F.lit(items[0][1])))
    return expr.otherwise(default) if default is not None else expr


def badge(spend_q: str | Column, purchase_q: str | Column) -> Column:
    """Gold if both quartiles are 1 or 2, Bronze if both 3 or 4, else Silver (NULL -> Silver)."""
    s, p = col_(spend_q), col_(purchase_q)
    gold = s.isin(1, 2) & p.isin(1, 2)
    bronze = s.isin(3, 4) & p.isin(3, 4)
    return (F.when(F.coalesce(gold, F.lit(False)), "Gold")
            .when(F.coalesce(bronze, F.lit(False)), "Bronze")
            .otherwise("Silver"))


def dot(a: str | Column, b: str | Column) -> Column:
    """Dot product of two numeric arrays, in double, folded left to right."""
    prod = F.zip_with(col_(a), col_(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prod, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """dot(a,b) / (|a| |b|); NULL for a zero or NULL vector (no division error under ANSI)."""
    den = norm(a) * norm(b)
    return F.try_divide(dot(a, b), F.when(den != 0, den))
