"""Tables as expressions over narrow base frames, so that a join can move the base and derive the columns after it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def column_by_column(value: Column) -> Column:
    """The same value, in a form that keeps its projection out of the stage's one generated method.

    A projection with a higher-order function is compiled as many small methods. Dozens of derived columns after a join make the stage's
    method larger than the JIT compiler takes, and all of the stage would be interpreted.
    """
    return F.transform(F.array(value), lambda x: x)[0]


@dataclass(frozen=True)
class Derived:
    """``columns`` over ``base``, or over ``base`` joined to ``headers`` (inner, ``on`` their two key columns)."""
    base: DataFrame
    columns: dict[str, Column]
    key: str = ""                          # of a dimension: the base column that is its key
    headers: DataFrame | None = None
    on: tuple[str, str] = ("", "")         # key of the base, key of the headers
    of_header: tuple[str, ...] = ()        # the columns that the headers alone give

    def joined(self, headers: DataFrame | None = None) -> DataFrame:
        """The frame the columns are over; ``headers``: the headers with columns added."""
        headers = self.headers if headers is None else headers
        if headers is None:
            return self.base
        return self.base.join(headers, self.base[self.on[0]] == headers[self.on[1]], "inner").drop(self.on[1])

    def names(self) -> set[str]:
        return {c.lower() for part in (self.base, self.headers) if part is not None for c in part.columns}

    def frame(self) -> DataFrame:
        return self.joined().select(*[e.alias(c) for c, e in self.columns.items()])
