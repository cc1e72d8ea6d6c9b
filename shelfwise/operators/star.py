"""Star views: a fact left-joined to its dimensions (V1-V9), plus the stock snapshot (V6).

One generic ``star_join`` expresses every view as configuration:
``SELECT a.*, dim.* EXCEPT(key, ...) [, dim.col AS alias] FROM fact a LEFT JOIN dim ON key``.
Only a dimension whose size is bounded by construction or by a count — the calendar, one row
per day of a fixed range, and a product chain of few parts — is broadcast explicitly. Every other dimension is left
to the planner: it broadcasts when the (runtime, under AQE) size is below
``spark.sql.autoBroadcastJoinThreshold`` and uses a sort-merge join beyond it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.derived import Derived, column_by_column


@dataclass
class DimSpec:
    name: str                      # short alias, used for carried columns: __<name>__<col>
    df: DataFrame
    left_on: str | tuple[str, ...]   # column(s) of the accumulated frame (fact or a carried key)
    right_on: str | tuple[str, ...]  # key column(s) of the dimension
    pick: list[str] | None = None  # explicit columns (b.CurrencyName); None = all but except_
    except_: tuple[str, ...] = ()  # columns excluded from the star (the key is always excluded)
    rename: dict[str, str] = field(default_factory=dict)  # dim col -> output alias, appended
    carry: tuple[str, ...] = ()    # dim columns kept hidden for later snowflake joins
    small: bool = False            # size bounded by construction (calendar): broadcast explicitly
    late: bool = False             # few rows, so that its join shuffles nothing: joined after those that may
    how: str = "left"
    made: Derived | None = None    # how ``df`` is derived from narrow columns, which a whole view moves instead

    def out_columns(self) -> list[tuple[str, str]]:
        cols = self.df.columns
        if self.pick is not None:
            base = [(c, c) for c in self.pick]
        else:
            skip = {*(k.lower() for k in _keys(self.right_on)), *(c.lower() for c in self.except_)}
            base = [(c, c) for c in cols if c.lower() not in skip]
        return base + list(self.rename.items())


def _keys(k: str | tuple[str, ...]) -> tuple[str, ...]:
    return (k,) if isinstance(k, str) else tuple(k)


def carried(name: str, col: str) -> str:
    return f"__{name}__{col}"


def star_join(fact: DataFrame, dims: list[DimSpec], need: set[str] | None = None, made: Derived | None = None) -> DataFrame:
    """Left-join ``fact`` to each dimension in order; see module doc.

    ``need``: if given, dimensions contributing none of these columns (and carrying
    no key a later needed dimension joins on) are skipped. Valid because dimension
    keys are unique, so an unused LEFT join never changes the fact row count.

    Rows and columns are those of joining in the given order. Yet in a whole view a dimension keyed on another one's column
    (snowflake) joins that one before the facts do, so wide fact rows never move for it; the few columns of a view with
    ``need`` move cheaply, and there the planner knows each dimension's size. Of the others, the narrowest join first and the
    ``late`` and ``small`` ones last, so that rows are as narrow as they can be whenever a join shuffles them.

    ``made`` (of the fact) and ``DimSpec.made``, used in whole views: what a shuffle moves are the columns a table is derived from; the
    derived ones are computed after the last join, those of a dimension only where its key was met. A dimension that may shuffle and is
    keyed on a column of the fact's headers joins the headers before their many lines do.
    """
    if need is not None:
        made = None
    active = list(dims)
    if need is not None:
        needed = {c.lower() for c in need}
        keep: list[DimSpec] = []
        required_keys: set[str] = set()
        for spec in reversed(dims):
            provides = {alias.lower() for _, alias in spec.out_columns()}
            provides |= {carried(spec.name, c).lower() for c in spec.carry}
            if provides & (needed | required_keys):
                keep.append(spec)
                required_keys.update(k.lower() for k in _keys(spec.left_on))
        active = list(reversed(keep))

    seen = {c.lower() for c in fact.columns}
    order = [c for c in fact.columns if not c.startswith("__")]
    outer: list[DimSpec] = []
    sides: dict[str, DataFrame] = {}  # name of an outer dimension -> its frame, snowflake dimensions joined
    keys: dict[str, list[str]] = {}
    home = {c.lower(): "" for c in fact.columns}  # column -> the outer dimension it comes from
    inside = {c.lower(): e for c, e in (made.columns if made else {c: F.col(c) for c in fact.columns}).items()}  # column -> its value in the frame it comes from
    value = dict(inside)  # column -> its value after the joins
    taken = made.names() if made else set()
    late = ""  # a column that is derived after the joins
    for spec in active:
        lkeys, rkeys = _keys(spec.left_on), _keys(spec.right_on)
        tmp = [f"__k_{spec.name}_{i}" for i in range(len(rkeys))]
        cols = spec.out_columns()
        for _, alias in cols:
            if alias.lower() in seen:
                raise ValueError(f"column {alias!r} from dimension {spec.name!r} collides; "
                                 "exclude or rename it")
            seen.add(alias.lower())
            order.append(alias)
        own = spec.made if need is None and len(rkeys) == 1 else None
        given = [*cols, *[(c, carried(spec.name, c)) for c in spec.carry]]
        if own and own.headers is None and not own.names() & (taken | seen | set(home)):
            side, tmp = own.base, [own.key]
            taken |= own.names()
            # literals and CASE chains give values for null columns too
            met = F.col(own.key).isNotNull()
            inside.update({alias.lower(): own.columns[src] for src, alias in given})
            value.update({alias.lower(): F.when(met, own.columns[src]) for src, alias in given})
            late = late or (cols[0][1].lower() if cols else "")
        else:
            side = spec.df.select(*[F.col(k).alias(t) for k, t in zip(rkeys, tmp)], *[F.col(src).alias(alias) for src, alias in given])
            inside.update({alias.lower(): F.col(alias) for _, alias in given})
            value.update({alias.lower(): F.col(alias) for _, alias in given})
        owners = {home[k.lower()] for k in lkeys}
        owner = owners.pop() if len(owners) == 1 else ""
        if owner and need is None and spec.how == "left" and not (spec.small or spec.late):
            cond = [inside[lk.lower()] == F.col(t) for lk, t in zip(lkeys, tmp)]
            sides[owner] = sides[owner].join(side, cond, spec.how).drop(*[t for t in tmp if t.startswith("__")])
        else:
            owner = spec.name
            outer.append(spec)
            sides[owner], keys[owner] = side, tmp
        home.update({c.lower(): owner for c in [a for _, a in cols] + [carried(spec.name, c) for c in spec.carry]})

    def rank(spec: DimSpec) -> tuple:
        return (spec.small, spec.late, len(sides[spec.name].columns))

    def joined(out: DataFrame, spec: DimSpec) -> DataFrame:
        side, tmp = sides[spec.name], keys[spec.name]
        side = F.broadcast(side) if spec.small else side
        cond = [value[lk.lower()] == F.col(t) for lk, t in zip(_keys(spec.left_on), tmp)]
        return out.join(side, cond, spec.how).drop(*[t for t in tmp if t.startswith("__")])

    # only joins that keep every fact row, on keys of the fact, may change places
    free = all(s.how == "left" and all(home[k.lower()] == "" for k in _keys(s.left_on)) for s in outer)
    rest, out = sorted(outer, key=rank) if free else outer, fact
    if made:
        headers = made.headers
        early = [s for s in rest if free and headers is not None and not (s.small or s.late) and set(_keys(s.left_on)) <= set(made.of_header)]
        for spec in early:
            headers = joined(headers, spec)
        rest, out = [s for s in rest if s not in early], made.joined(headers)
    for spec in rest:
        out = joined(out, spec)
    if late:
        value[late] = column_by_column(value[late])
    return out.select(*[value[c.lower()].alias(c) for c in order])


# ------------------------------------------------------------------ views

def v_fact_call_center(w) -> DataFrame:
    return star_join(w.fact_call_center, [
        DimSpec("b", w.dim_date, "DateKey", "DateKey", small=True)])


def v_fact_currency_rate(w) -> DataFrame:
    return star_join(w.fact_currency_rate, [
        DimSpec("b", w.dim_currency, "CurrencyKey", "CurrencyKey"),
        DimSpec("c", w.dim_date, "DateKey", "DateKey", small=True)])


def v_fact_finance(w) -> DataFrame:
    return star_join(w.fact_finance, [
        DimSpec("b", w.dim_account, "AccountKey", "AccountKey"),
        DimSpec("c", w.dim_department_group, "DepartmentGroupKey", "DepartmentGroupKey"),
        DimSpec("d", w.dim_organization, "OrganizationKey", "OrganizationKey"),
        DimSpec("e", w.dim_date, "DateKey", "DateKey", small=True)])


def _made(w, table: str) -> Derived | None:
    return getattr(w, "made", lambda name: None)(table)


def _product_chain(w, left_on: str = "ProductKey") -> list[DimSpec]:
    """product (all but key) -> subcategory name -> category name (snowflake).

    The planner can't tell the size of the joined chain, so it is broadcast when the table of parts is known to have few rows.
    """
    few = getattr(w, "few", lambda table: False)("part")
    return [
        DimSpec("d", w.dim_product, left_on, "ProductKey", small=few),
        DimSpec("e", w.dim_product_subcategory, "ProductSubcategoryKey", "ProductSubcategoryKey",
                pick=["EnglishProductSubcategoryName"], carry=("ProductCategoryKey",)),
        DimSpec("f", w.dim_product_category, carried("e", "ProductCategoryKey"), "ProductCategoryKey",
                pick=["EnglishProductCategoryName"]),
    ]


def v_fact_internet_sales(w, need: set[str] | None = None) -> DataFrame:
    return star_join(w.fact_internet_sales, [
        DimSpec("b", w.dim_currency, "CurrencyKey", "CurrencyKey", pick=["CurrencyName"], late=True),
        DimSpec("c", w.dim_customer, "CustomerKey", "CustomerKey", made=_made(w, "dim_customer")),
        *_product_chain(w),
        DimSpec("g", w.dim_date, "OrderDateKey", "DateKey", small=True),
    ], need=need, made=_made(w, "fact_internet_sales"))


def v_fact_internet_sales_reason(w) -> DataFrame:
    # the fact-to-fact LEFT join on the composite (order, line) key comes first: facts bucketed on it
    # (sources.colocate) meet as they are stored, others shuffle on both keys
    return star_join(w.fact_internet_sales_reason, [
        DimSpec("c", w.fact_internet_sales, ("SalesOrderNumber", "SalesOrderLineNumber"),
                ("SalesOrderNumber", "SalesOrderLineNumber")),
        DimSpec("b", w.dim_sales_reason, "SalesReasonKey", "SalesReasonKey"),
        DimSpec("d", w.dim_date, "OrderDateKey", "DateKey", small=True)])


def v_fact_reseller_sales(w, need: set[str] | None = None) -> DataFrame:
    emp_renamed = ("StartDate", "EndDate", "Phone", "SalesTerritoryKey", "Status")
    return star_join(w.fact_reseller_sales, [
        DimSpec("b", w.dim_currency, "CurrencyKey", "CurrencyKey", pick=["CurrencyName"], late=True),
        DimSpec("c", w.dim_employee, "EmployeeKey", "EmployeeKey", except_=emp_renamed,
                rename={c: "Emp" + c for c in emp_renamed}, late=True),
        *_product_chain(w),
        DimSpec("g", w.dim_date, "OrderDateKey", "DateKey", small=True),
        DimSpec("h", w.dim_reseller, "ResellerKey", "ResellerKey", except_=("ProductLine",),
                rename={"ProductLine": "ResellerProductLine"}),
    ], need=need, made=_made(w, "fact_reseller_sales"))


def v_fact_sales_quota(w) -> DataFrame:
    return star_join(w.fact_sales_quota, [
        DimSpec("b", w.dim_employee, "EmployeeKey", "EmployeeKey"),
        DimSpec("c", w.dim_date, "DateKey", "DateKey", except_=("CalendarYear", "CalendarQuarter"),
                )])


def v_fact_survey_response(w) -> DataFrame:
    return star_join(w.fact_survey_response, [
        DimSpec("b", w.dim_customer, "CustomerKey", "CustomerKey"),
        DimSpec("c", w.dim_date, "DateKey", "DateKey", small=True)])


def stock_position(inventory: DataFrame) -> DataFrame:
    """Latest inventory snapshot per product: (ProductKey, UnitsBalance, LeadTimeWeeks).

    One partial+final hash aggregate (max_by keeps O(1) state per key), so a hot
    product costs no more than any other key.
    """
    latest = F.max_by(F.struct("UnitsBalance", "LeadTimeWeeks"), F.col("DateKey"))
    return (inventory.groupBy("ProductKey").agg(latest.alias("s"))
            .select("ProductKey", F.col("s.UnitsBalance").alias("UnitsBalance"),
                    F.col("s.LeadTimeWeeks").alias("LeadTimeWeeks")))
