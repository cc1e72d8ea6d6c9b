"""Purchase-propensity model (C9-C15): buyers / non-buyers, features, logistic regression, scores."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import age_fraction_years

# The model's customer attributes, by kind.
ATTRS = ["CustomerKey", "BirthDate", "MaritalStatus", "Gender", "YearlyIncome", "TotalChildren",
         "NumberChildrenAtHome", "EnglishEducation", "EnglishOccupation", "HouseOwnerFlag",
         "NumberCarsOwned", "CommuteDistance"]
CATEGORICAL = ["MaritalStatus", "Gender", "EnglishEducation", "EnglishOccupation",
               "CommuteDistance", "HouseOwnerFlag"]
NUMERIC = ["YearlyIncome", "TotalChildren", "NumberChildrenAtHome", "NumberCarsOwned", "Age"]


def customer_labels(sales_view: DataFrame, customers: DataFrame, anchor: str,
                    category_col: str = "EnglishProductCategoryName") -> DataFrame:
    """One row per customer with sales: the attributes and ``BikeBuyer`` (1 with an anchor-category line, else 0).

    The lines are reduced to customers before any attribute is joined.
    """
    bought = F.coalesce((F.col(category_col) == anchor).cast("int"), F.lit(0))
    per = sales_view.groupBy("CustomerKey").agg(F.max(bought).alias("BikeBuyer"))
    return per.join(customers.select(*ATTRS), "CustomerKey", "left").select(*ATTRS, "BikeBuyer")


def buyers(labels: DataFrame) -> DataFrame:
    """Attributes of customers with an anchor-category line."""
    return labels.where("BikeBuyer = 1").drop("BikeBuyer")


def non_buyers(labels: DataFrame) -> DataFrame:
    """Attributes of customers without one."""
    return labels.where("BikeBuyer = 0").drop("BikeBuyer")


def training_set(labels: DataFrame, as_of: str) -> DataFrame:
    """C11+C12: labelled customers with their fractional age in years (days / 365)."""
    return labels.withColumn("Age", age_fraction_years("BirthDate", as_of))


def pipeline(handle_invalid: str = "keep", max_iter: int = 100, reg_param: float = 0.0) -> Pipeline:
    """C13+C14: text attributes to codes (all in one pass), one feature vector, logistic regression.

    ``handle_invalid="keep"`` gives missing and unseen values a code of their own instead of failing.
    """
    coded = {column: f"{column}_code" for column in CATEGORICAL}
    stages = [
        StringIndexer(inputCols=list(coded), outputCols=list(coded.values()), handleInvalid=handle_invalid),
        VectorAssembler(inputCols=[*NUMERIC, *coded.values()], outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="BikeBuyer", maxIter=max_iter, regParam=reg_param),
    ]
    return Pipeline(stages=stages)


def fit(train: DataFrame, **kw) -> PipelineModel:
    return pipeline(**kw).fit(train)


def probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The rows with ``p``, the fitted probability of label 1."""
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1])


FEATURES = [*NUMERIC, *[f"{c}_code" for c in CATEGORICAL]]
NEWTON_TOLERANCE, NEWTON_STEPS = 1e-10, 50


def coded(train: DataFrame) -> DataFrame:
    """The training rows with a code per text attribute (by frequency, ties alphabetically; missing values last)."""
    names = {c: f"{c}_code" for c in CATEGORICAL}
    indexer = StringIndexer(inputCols=list(names), outputCols=list(names.values()), handleInvalid="keep")
    return indexer.fit(train).transform(train)


class ScoreModel:
    """Coefficients of the logistic regression on the attributes' own scale, the intercept apart."""

    def __init__(self, intercept: float, weights: dict[str, float], means: dict[str, float]):
        self.intercept, self.weights, self.means = intercept, weights, means

    def probability(self) -> Column:
        """P(label=1) from the feature columns; a missing number counts as the mean."""
        terms = [F.coalesce(F.col(c).cast("double") - F.lit(self.means[c]), F.lit(0.0)) * F.lit(w) for c, w in self.weights.items()]
        return 1 / (1 + F.exp(-sum(terms, F.lit(self.intercept))))


def newton_fit(rows: DataFrame, tolerance: float = NEWTON_TOLERANCE, max_steps: int = NEWTON_STEPS) -> ScoreModel:
    """C14 to a stated tolerance: the maximum-likelihood coefficients by Newton steps over ``coded`` rows (a written table).

    A step is one aggregate: the gradient and the Hessian, 90 sums, of standardised features. It ends when no component of the
    gradient exceeds ``tolerance`` per row, so the scores repeat to about that precision whatever the partitioning. Constant features
    get no weight; of linearly dependent ones the shortest solution is taken. A step that lowers the likelihood is halved.
    """
    moments = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(f"m_{c}") for c in FEATURES], *[F.stddev_pop(c).alias(f"s_{c}") for c in FEATURES]).first()
    used = [c for c in FEATURES if moments[f"s_{c}"]]
    means = {c: float(moments[f"m_{c}"]) for c in used}
    z = [F.lit(1.0), *[F.coalesce((F.col(c).cast("double") - F.lit(means[c])) / F.lit(float(moments[f"s_{c}"])), F.lit(0.0)) for c in used]]
    names = [f"z{i}" for i in range(len(z))]
    scaled = rows.select(F.col("BikeBuyer").cast("double").alias("y"), *[v.alias(n) for v, n in zip(z, names)])
    at = [(i, j) for i in range(len(z)) for j in range(i + 1)]

    def sums(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood, gradient and Hessian at ``beta``."""
        margin = sum((F.col(n) * F.lit(float(b)) for n, b in zip(names, beta)), F.lit(0.0))
        p = scaled.withColumn("t", margin).withColumn("p", 1 / (1 + F.exp(-F.col("t"))))
        weight = p.withColumn("w", F.col("p") * (1 - F.col("p")))
        # y*t - log(1 + e^t), without overflow
        likelihood = F.sum(F.col("y") * F.col("t") - F.greatest("t", F.lit(0.0)) - F.log1p(F.exp(-F.abs("t"))))
        found = weight.agg(likelihood.alias("l"), *[F.sum((F.col("y") - F.col("p")) * F.col(n)).alias(f"g_{n}") for n in names],
                           *[F.sum(F.col("w") * F.col(names[i]) * F.col(names[j])).alias(f"h_{i}_{j}") for i, j in at]).first()
        hessian = np.zeros((len(z), len(z)))
        for i, j in at:
            hessian[i, j] = hessian[j, i] = found[f"h_{i}_{j}"] or 0.0
        return found["l"] or 0.0, np.array([found[f"g_{n}"] or 0.0 for n in names]), hessian

    beta = np.zeros(len(z))
    value, gradient, hessian = sums(beta)
    for _ in range(max_steps):
        if np.abs(gradient).max() <= tolerance * max(1, moments["n"]):
            break
        step = np.linalg.lstsq(hessian, gradient, rcond=1e-12)[0]
        for _ in range(30):
            new, g, h = sums(beta + step)
            if new >= value - 1e-12 * abs(value):
                break
            step = step / 2
        beta, value, gradient, hessian = beta + step, new, g, h
    weights = {c: float(b) / float(moments[f"s_{c}"]) for c, b in zip(used, beta[1:])}
    return ScoreModel(float(beta[0]), weights, means)


def newton_scores(model: ScoreModel, rows: DataFrame) -> DataFrame:
    """P(label=1) of the label-0 rows as float ``score``, best first."""
    return (rows.where("BikeBuyer = 0").select(F.col("CustomerKey").alias("customerkey"), model.probability().cast("float").alias("score"))
            .orderBy(F.desc("score"), F.asc("customerkey")))


def score_equations(model: ScoreModel, rows: DataFrame) -> DataFrame:
    """(feature, observed, solved): per feature and the intercept the sum over the buyers, and whether the fitted probabilities add up to
    the same, to 1e-6 of the feature's absolute sum. The likelihood is concave, so this holds at its maximum alone."""
    own = rows.select(F.col("BikeBuyer").cast("double").alias("y"), model.probability().alias("p"), F.lit(1.0).alias("intercept"),
                      *[F.col(c).cast("double").alias(c) for c in FEATURES])
    names = ["intercept", *FEATURES]
    found = own.agg(*[F.struct(F.sum(F.col("y") * F.col(c)).alias("o"), F.sum(F.col("p") * F.col(c)).alias("e"), F.sum(F.abs(c)).alias("a")).alias(c) for c in names])
    each = found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c)["o"].alias("o"), F.col(c)["e"].alias("e"), F.col(c)["a"].alias("a")) for c in names])).alias("f")).select("f.*")
    return each.select("feature", F.round("o", 3).alias("observed"), (F.abs(F.col("o") - F.col("e")) <= F.greatest(F.col("a"), F.lit(1.0)) * 1e-6).alias("solved"))


def score(model: PipelineModel, train: DataFrame) -> DataFrame:
    """P(label=1) for the label-0 rows as float ``score``, best first."""
    scored = probabilities(model, train.filter(F.col("BikeBuyer") == 0))
    return (scored.select(F.col("CustomerKey").alias("customerkey"), F.col("p").cast("float").alias("score"))
            .orderBy(F.desc("score"), F.asc("customerkey")))


def save_scores(scores: DataFrame, path: str) -> None:
    """The score table, range-partitioned and sorted best first, for the customer tables to read."""
    scores.write.mode("overwrite").parquet(path)
