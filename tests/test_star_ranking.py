import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from shelfwise.functions.derived import Derived
from shelfwise.operators import ranking
from shelfwise.operators.ranking import global_rank_table, with_percent_rank, with_percent_ranks, with_row_number
from shelfwise.operators.star import DimSpec, star_join, stock_position, v_fact_internet_sales


def test_star_join_keeps_fact_rows_and_nulls_unmatched(spark):
    fact = spark.createDataFrame([(1, 10, 5.0), (2, 99, 1.0), (3, None, 2.0), (4, 10, 3.0)],
                                 "id int, k int, v double")
    dim = spark.createDataFrame([(10, "a", "x")], "k int, name string, other string")
    out = star_join(fact, [DimSpec("d", dim, "k", "k")])
    assert out.columns == ["id", "k", "v", "name", "other"]
    got = {r["id"]: r["name"] for r in rows(out)}
    assert got == {1: "a", 2: None, 3: None, 4: "a"}


def test_star_join_empty_dimension(spark):
    fact = spark.createDataFrame([(1, 10)], "id int, k int")
    dim = spark.createDataFrame([], "k int, name string")
    assert rows(star_join(fact, [DimSpec("d", dim, "k", "k")])) == [{"id": 1, "k": 10, "name": None}]


def test_star_join_collision_raises_and_rename_resolves(spark):
    fact = spark.createDataFrame([(1, 10, "fact")], "id int, k int, Status string")
    dim = spark.createDataFrame([(10, "dim")], "k int, Status string")
    with pytest.raises(ValueError, match="collides"):
        star_join(fact, [DimSpec("d", dim, "k", "k")])
    out = star_join(fact, [DimSpec("d", dim, "k", "k", except_=("Status",), rename={"Status": "DimStatus"})])
    assert rows(out) == [{"id": 1, "k": 10, "Status": "fact", "DimStatus": "dim"}]


def test_star_join_snowflake_and_need_pruning(spark):
    fact = spark.createDataFrame([(1, 100), (2, 200)], "id int, pk int")
    prod = spark.createDataFrame([(100, 7, "p100"), (200, None, "p200")], "pk int, sk int, pname string")
    sub = spark.createDataFrame([(7, 3, "s7")], "sk int, ck int, sname string")
    cat = spark.createDataFrame([(3, "c3")], "ck int, cname string")
    other = spark.createDataFrame([(100, "unused")], "pk int, junk string")
    dims = [DimSpec("d", prod, "pk", "pk"),
            DimSpec("e", sub, "sk", "sk", pick=["sname"], carry=("ck",)),
            DimSpec("f", cat, "__e__ck", "ck", pick=["cname"]),
            DimSpec("o", other, "pk", "pk")]
    full = star_join(fact, dims)
    assert full.columns == ["id", "pk", "sk", "pname", "sname", "cname", "junk"]
    pruned = star_join(fact, dims, need={"cname"})
    assert "junk" not in pruned.columns and "cname" in pruned.columns
    assert {r["id"]: r["cname"] for r in rows(pruned)} == {1: "c3", 2: None}


def test_stock_position_latest_snapshot(spark):
    inv = spark.createDataFrame([(1, 20010101, 5, 2), (1, 20010201, -3, 2), (2, 20000101, 50, 1)],
                                "ProductKey long, DateKey int, UnitsBalance int, LeadTimeWeeks int")
    assert rows(stock_position(inv), "ProductKey") == [
        {"ProductKey": 1, "UnitsBalance": -3, "LeadTimeWeeks": 2},
        {"ProductKey": 2, "UnitsBalance": 50, "LeadTimeWeeks": 1}]


def _random_frame(spark, n=400, seed=7):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        a = rnd.choice([None, 0.0, 0.0, 0.0, 1.5, 2.0, 2.0, 3.25, rnd.random()])
        b = rnd.choice([None, 1, 2, 2, 3, rnd.randint(0, 50)])
        data.append((i, a, b))
    return spark.createDataFrame(data, "id int, a double, b int")


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_distributed_percent_rank_equals_global_window(spark, parts):
    df = _random_frame(spark)
    keys = [("a", True), ("b", True)]
    got = with_percent_rank(df, keys, "pr", num_partitions=parts)
    w = Window.orderBy(F.col("a").desc_nulls_last(), F.col("b").desc_nulls_last())
    want = df.withColumn("pr", F.percent_rank().over(w))
    assert {r["id"]: r["pr"] for r in rows(got)} == {r["id"]: r["pr"] for r in rows(want)}


def test_distributed_row_number_equals_global_window(spark):
    df = _random_frame(spark)
    keys = [("a", True), ("id", False)]
    got = with_row_number(df, keys, "rn", count_col="n", num_partitions=5)
    w = Window.orderBy(F.col("a").desc_nulls_last(), F.col("id").asc_nulls_first())
    want = {r["id"]: r["rn"] for r in rows(df.withColumn("rn", F.row_number().over(w)))}
    g = rows(got)
    assert {r["id"]: r["rn"] for r in g} == want
    assert {r["n"] for r in g} == {df.count()}


def test_rank_table_one_row_and_all_equal(spark):
    one = spark.createDataFrame([(1, 5.0)], "id int, a double")
    assert rows(with_percent_rank(one, [("a", True)], "pr")) == [{"id": 1, "a": 5.0, "pr": 0.0}]
    same = spark.createDataFrame([(i, 1.0) for i in range(10)], "id int, a double")
    t = rows(global_rank_table(same, [("a", True)], 4))
    assert t == [{"a": 1.0, "rank": 1, "mult": 10, "total": 10}]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 4)), st.one_of(st.none(), st.integers(0, 3))),
                min_size=1, max_size=60),
       st.integers(1, 6))
def test_property_distributed_rank_equals_window(spark, data, parts):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(data)], "id int, a int, b int")
    keys = [("a", True), ("b", False)]
    got = with_percent_rank(df, keys, "pr", num_partitions=parts)
    w = Window.orderBy(F.col("a").desc_nulls_last(), F.col("b").asc_nulls_first())
    want = df.withColumn("pr", F.percent_rank().over(w))
    assert {r["id"]: r["pr"] for r in rows(got)} == {r["id"]: r["pr"] for r in rows(want)}


@pytest.mark.parametrize("parts", [1, 7])
def test_several_orders_in_one_pass_equal_global_windows(spark, parts):
    """Orders of different columns, types and directions; a third of all rows tie over several ranges; NULL, NaN and -0.0."""
    rnd = random.Random(3)
    nan = float("nan")
    data = [(i, rnd.choice([0.0, 0.0, -0.0, None, nan, rnd.random()]), rnd.choice(["x", "y", None, "z" * rnd.randint(0, 3)]), rnd.choice([None, 1, 2]))
            for i in range(500)]
    df = spark.createDataFrame(data, "id int, a double, s string, b int").repartition(5)
    orders = [[("a", True)], [("s", False), ("a", True)], [("b", False)], [("a", False), ("b", True), ("s", True)]]
    got = df.join(with_percent_ranks(df, [(o, f"r{n}") for n, o in enumerate(orders)], parts).drop("a", "s", "b"), "id")
    want = df
    for n, order in enumerate(orders):
        sort = [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_first() for c, d in order]
        want = want.withColumn(f"r{n}", F.percent_rank().over(Window.orderBy(*sort)))
    ranks = lambda d: {r["id"]: tuple(r[f"r{n}"] for n in range(len(orders))) for r in rows(d)}
    assert ranks(got) == ranks(want)


def test_ranks_of_ties_running_over_all_ranges(spark):
    """One value over all ranges: everyone ranks first; and two values whose border lies inside a range."""
    df = spark.range(200).withColumn("v", (F.col("id") >= 130).cast("int"))
    table = with_row_number(df, [("id", False)], "n", "total", num_partitions=9)
    assert {r["id"]: (r["n"], r["total"]) for r in rows(table)} == {i: (i + 1, 200) for i in range(200)}
    got = {r["id"]: r["pr"] for r in rows(with_percent_rank(df, [("v", False)], "pr", num_partitions=9))}
    assert {got[i] for i in range(130)} == {0.0} and {got[i] for i in range(130, 200)} == {130 / 199}
    assert rows(with_percent_rank(df.where("id < 0"), [("v", False)], "pr")) == []


def test_ranks_use_one_range_exchange(spark):
    stacked, _, sort = ranking._stacked(ranking.with_row(spark.range(10).withColumn("v", F.lit(1))), [[("id", True)], [("v", True)], [("v", False)]])
    plan = stacked.repartitionByRange(4, *sort)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and plan.count("Scan parquet") == 1


def test_star_joins_move_narrow_facts_and_snowflakes_not_at_all(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fact = spark.createDataFrame([(1, 10, 100), (2, 99, 200), (3, None, None), (1, 10, 100)], "id int, wk int, pk int")
        wide = spark.createDataFrame([(10, "a", "b", "c"), (10, "d", "e", "f")], "wk int, w1 string, w2 string, w3 string")
        prod = spark.createDataFrame([(100, 7), (200, None)], "pk int, sk int")
        sub = spark.createDataFrame([(7, "s7")], "sk int, sname string")
        out = star_join(fact, [DimSpec("w", wide, "wk", "wk"), DimSpec("p", prod, "pk", "pk"), DimSpec("s", sub, "sk", "sk")])
        assert out.columns == ["id", "wk", "pk", "w1", "w2", "w3", "sk", "sname"]
        want = [(1, 10, 100, *w, 7, "s7") for w in [("a", "b", "c"), ("d", "e", "f")] * 2] + [(2, 99, 200, None, None, None, None, None), (3, *[None] * 7)]
        assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        # outermost first: the wide dimension joins last, the snowflake joins the product, not the facts
        assert [line.split("SortMergeJoin")[1].split("#")[0] for line in plan.split("\n") if "SortMergeJoin" in line] == [" [wk", " [pk", " [sk"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _joins(df):
    """Keys of the sort-merge joins, outermost first."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line.split("SortMergeJoin [")[1].split("#")[0] for line in plan.split("\n") if "SortMergeJoin" in line]


def test_derived_columns_are_those_of_plain_joins(spark, no_broadcast):
    """Unknown and null keys, keys that repeat on every side, lines without an order, columns that are never null by themselves."""
    lines = spark.createDataFrame([(1, 100, 2.0), (1, 100, 2.0), (2, 200, 3.0), (3, None, None), (4, 100, 1.0), (9, 100, 1.0), (None, 100, 1.0)],
                                  "l_o long, l_p long, l_q double")
    orders = spark.createDataFrame([(1, 10), (2, 11), (2, 11), (3, None), (4, 99), (5, 10), (None, 10)], "o_o long, o_c long")
    people = spark.createDataFrame([(10, "ann"), (10, "abe"), (11, None), (None, "nil")], "c_k long, c_name string")
    prod = spark.createDataFrame([(100, "p", 7), (200, "q", None)], "pk long, pname string, sk int")
    sub = spark.createDataFrame([(7, "s7")], "sk int, sname string")
    made = Derived(lines, {"id": F.col("l_o"), "pk": F.col("l_p"), "ck": F.col("o_c"), "twice": F.col("l_q") * 2}, headers=orders, on=("l_o", "o_o"), of_header=("ck",))
    own = Derived(people, {"ck": F.col("c_k"), "half": F.when(F.col("c_k") % 2 == 0, "M").otherwise("S"), "fixed": F.lit("x"), "name": F.upper("c_name")}, key="c_k")

    def view(late):
        return star_join(made.frame(), [DimSpec("c", own.frame(), "ck", "ck", made=own if late else None), DimSpec("p", prod, "pk", "pk"),
                                        DimSpec("s", sub, "sk", "sk")], made=made if late else None)

    assert view(True).columns == view(False).columns and view(True).dtypes == view(False).dtypes
    got = sorted(map(tuple, view(True).collect()), key=str)
    assert got == sorted(map(tuple, view(False).collect()), key=str)
    assert got == sorted([*[(1, 100, 10, 4.0, "M", "x", n, "p", 7, "s7") for n in ("ANN", "ABE") * 2], *[(2, 200, 11, 6.0, "S", "x", None, "q", None, None)] * 2,
                          (3, *[None] * 9), (4, 100, 99, 2.0, None, None, None, "p", 7, "s7")], key=str)
    assert _joins(view(True)) == ["l_p", "l_o", "o_c", "sk"]


def test_internet_sales_move_raw_columns(spark, no_broadcast, monkeypatch):
    """Customers join the orders before the order lines do, and the lines shuffle twice: for their orders and for the products."""
    from shelfwise.sources import binding
    monkeypatch.setattr(binding, "FEW_ROWS", 0)
    view = v_fact_internet_sales(binding.bind(spark, "/root/testdata/sf0.001"))
    joins = _joins(view)
    assert joins.index("l_partkey") < joins.index("l_orderkey") < joins.index("o_custkey")
    assert len(view.columns) == 62 and view.columns[:3] == ["SalesOrderNumber", "SalesOrderLineNumber", "ProductKey"]


def test_shuffles_follow_the_rows(spark):
    from shelfwise import session
    before = {k: spark.conf.get(k) for k in (session.SHUFFLE_PARTITIONS, session.MERGE_SIZE)}
    try:
        session.size_shuffles(spark, 1000)
        assert {k: spark.conf.get(k) for k in before} == before
        session.size_shuffles(spark, 100 * session.ROWS_PER_TASK + 1)
        assert spark.conf.get(session.SHUFFLE_PARTITIONS) == "101" and spark.conf.get(session.MERGE_SIZE) == session.MERGE_UP_TO
        session.size_shuffles(spark, 1000)
        assert spark.conf.get(session.SHUFFLE_PARTITIONS) == "101"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_buckets_follow_the_order_lines(spark, monkeypatch):
    from shelfwise import session
    from shelfwise.sources import binding
    from shelfwise.sources.colocate import default_buckets
    before = {k: spark.conf.get(k) for k in (session.SHUFFLE_PARTITIONS, session.MERGE_SIZE)}
    monkeypatch.setattr(session, "ROWS_PER_TASK", 100)
    monkeypatch.setattr(binding, "_ROWS", {})
    try:
        lines = binding.bind(spark, "/root/testdata/sf0.001").raw("lineitem").count()
        assert default_buckets(spark) == -(-lines // 100) > 8
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
