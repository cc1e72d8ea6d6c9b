import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from conftest import rows
from shelfwise.operators import propensity

ATTRS = propensity.ATTRS


def _view(spark, n=300, seed=3):
    """Sales-view rows with a planted signal: high income and few children buy the anchor category."""
    rnd = random.Random(seed)
    data = []
    for k in range(n):
        income = rnd.choice([20000.0, 30000.0, 90000.0, 120000.0])
        kids = rnd.randint(0, 5)
        buyer = (income > 60000 and kids < 3) if rnd.random() < 0.9 else (rnd.random() < 0.5)
        gender = None if k % 13 == 0 else rnd.choice(["M", "F"])  # null categorical
        base = (k, dt.date(1960 + k % 30, 1 + k % 12, 1), rnd.choice(["M", "S"]), gender, income, kids,
                kids % 3, rnd.choice(["Bachelors", "High School"]), rnd.choice(["A", "B"]),
                str(k % 2), k % 4, rnd.choice(["0-1 Miles", "10+ Miles"]))
        data.append(base + ("Other",))
        if buyer:
            data.append(base + ("Bikes",))
    schema = ("CustomerKey long, BirthDate date, MaritalStatus string, Gender string, YearlyIncome double, "
              "TotalChildren int, NumberChildrenAtHome int, EnglishEducation string, EnglishOccupation string, "
              "HouseOwnerFlag string, NumberCarsOwned int, CommuteDistance string, "
              "EnglishProductCategoryName string")
    return spark.createDataFrame(data, schema)


def _labels(view):
    return propensity.customer_labels(view, view.select(*ATTRS).distinct(), "Bikes")


def test_buyers_and_non_buyers_partition_customers(spark):
    v = _view(spark)
    labels = _labels(v)
    b = {r["CustomerKey"] for r in rows(propensity.buyers(labels))}
    nb = {r["CustomerKey"] for r in rows(propensity.non_buyers(labels))}
    assert b == {r["CustomerKey"] for r in rows(v.where("EnglishProductCategoryName = 'Bikes'").select("CustomerKey"))}
    assert not (b & nb) and (b | nb) == {r["CustomerKey"] for r in rows(v.select("CustomerKey").distinct())}


def test_model_learns_planted_signal(spark):
    v = _view(spark)
    train = propensity.training_set(_labels(v), "2002-01-01")
    model = propensity.fit(train)
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    auc = BinaryClassificationEvaluator(labelCol="BikeBuyer", rawPredictionCol="p").evaluate(
        model.transform(train).select("BikeBuyer", F.col("rawPrediction").alias("p")))
    assert auc > 0.75
    sc = rows(propensity.score(model, train))
    assert sc and all(0.0 <= r["score"] <= 1.0 for r in sc)
    assert [r["score"] for r in sc] == sorted((r["score"] for r in sc), reverse=True)
    assert {r["customerkey"] for r in sc} == {r["CustomerKey"] for r in rows(propensity.non_buyers(_labels(v)))}


def _numpy_scores(table, steps=200):
    """Maximum-likelihood probabilities by plain Newton steps on the coded features."""
    x = np.array([[1.0] + [float(r[c]) for c in propensity.FEATURES] for r in table])
    x[:, 1:] -= x[:, 1:].mean(axis=0)
    keep = [0] + [j for j in range(1, x.shape[1]) if x[:, j].std() > 0]
    x = x[:, keep] / np.array([1.0] + [x[:, j].std() for j in keep[1:]])
    y = np.array([float(r["BikeBuyer"]) for r in table])
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.lstsq(x.T @ (x * (p * (1 - p))[:, None]), x.T @ (y - p), rcond=1e-12)[0]
        beta += step
        if np.abs(step).max() < 1e-12:
            break
    return dict(zip((r["CustomerKey"] for r in table), 1 / (1 + np.exp(-x @ beta))))


def test_newton_scores_equal_numpy_and_repeat(spark):
    train = propensity.training_set(_labels(_view(spark)), "2002-01-01")
    table = propensity.coded(train).cache()
    want = _numpy_scores(rows(table))
    runs = []
    for parts in (1, 7):
        part = table.repartition(parts).cache()
        model = propensity.newton_fit(part)
        got = {r["CustomerKey"]: r["p"] for r in rows(part.select("CustomerKey", model.probability().alias("p")))}
        assert max(abs(got[k] - want[k]) for k in want) < 1e-7
        assert all(r["solved"] for r in rows(propensity.score_equations(model, part)))
        runs.append([(r["customerkey"], round(r["score"], 6)) for r in propensity.newton_scores(model, part).collect()])
    assert runs[0] == runs[1] and len(runs[0]) == sum(r["BikeBuyer"] == 0 for r in rows(table))
    # a model that is off does not solve the equations
    model.intercept += 0.01
    assert not all(r["solved"] for r in rows(propensity.score_equations(model, table)))


def test_newton_fit_of_degenerate_tables(spark):
    """Constant and dependent features, a missing number, labels that a feature separates, one label only, no row."""
    base = propensity.coded(propensity.training_set(_labels(_view(spark, 60)), "2002-01-01")).coalesce(1).cache()
    dependent = base.withColumn("NumberCarsOwned", F.col("TotalChildren") * 2).withColumn("YearlyIncome", F.lit(5.0))
    model = propensity.newton_fit(dependent)
    assert "YearlyIncome" not in model.weights and all(r["solved"] for r in rows(propensity.score_equations(model, dependent)))
    missing = base.withColumn("YearlyIncome", F.when(F.col("CustomerKey") > 5, F.col("YearlyIncome")))
    assert all(0 <= r["p"] <= 1 for r in rows(missing.select(propensity.newton_fit(missing).probability().alias("p"))))
    apart = base.withColumn("BikeBuyer", (F.col("TotalChildren") > 2).cast("int"))
    fitted = rows(apart.select("BikeBuyer", propensity.newton_fit(apart).probability().alias("p")))
    assert all((r["p"] > 0.5) == (r["BikeBuyer"] == 1) for r in fitted)
    ones = base.withColumn("BikeBuyer", F.lit(0))
    assert max(r["p"] for r in rows(ones.select(propensity.newton_fit(ones).probability().alias("p")))) < 0.01
    assert propensity.newton_scores(propensity.newton_fit(base.where("false")), base.where("false")).count() == 0
