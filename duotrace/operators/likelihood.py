"""The likelihood ratio's own fit, cross-fitted between folds, and scores put on another run's scale."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duotrace.functions.expr import linear

FEATURES = ("sigma_h", "sigma_l", "coh", "centroid_h", "centroid_l", "gate_h", "gate_l")


def fit(rows: DataFrame, label: str = "signal", features: tuple[str, ...] = FEATURES, rising: tuple[str, ...] = ("coh",), ridge: float = 1.0) -> dict[str, list[float]]:
    """mean, scale and beta (intercept first) of a logistic fit of `label` (0 or 1), both classes weighing alike.

    Features are standardised by the rows' own mean and deviation; the penalty is ridge times the squared slopes, against
    the sum of all weighted losses, and slopes of `rising` features can't be negative. Spark's own bounded fit: only
    sums of gradients come to the driver. Both classes must be there.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.linalg import DenseMatrix

    sums = rows.agg(F.count("*"), F.sum(label), *(f(c) for c in features for f in (F.avg, F.stddev_pop))).first()
    n, n_signal = sums[0], sums[1] or 0
    if not 0 < n_signal < n:
        raise ValueError("the fit needs rows of both classes")
    mean, scale = list(sums[2::2]), [s + 1e-9 for s in sums[3::2]]
    ready = rows.select(F.col(label).cast("double").alias("label"), F.when(F.col(label) == 1, n / (2 * n_signal)).otherwise(n / (2 * (n - n_signal))).alias("weight"), *((F.col(c) - m) / s for c, m, s in zip(features, mean, scale)))
    ready = ready.toDF("label", "weight", *features)
    ready = VectorAssembler(inputCols=list(features), outputCol="features").transform(ready)
    least = DenseMatrix(1, len(features), [0.0 if c in rising else float("-inf") for c in features])
    model = LogisticRegression(weightCol="weight", standardization=False, regParam=2 * ridge / n, maxIter=500, tol=1e-12, family="binomial", lowerBoundsOnCoefficients=least).fit(ready)
    return {"mean": mean, "scale": scale, "beta": [model.intercept, *model.coefficients.toArray().tolist()]}


def cross_fit(rows: DataFrame, fold: str = "fold", label: str = "signal", features: tuple[str, ...] = FEATURES, **options) -> DataFrame:
    """rows (folds 0 and 1) with loglr, each fold's by the fit of the other's rows alone."""
    models = {g: fit(rows.filter(F.col(fold) == 1 - g), label, features, **options) for g in (0, 1)}
    score = lambda g: linear([F.col(c) for c in features], models[g]["mean"], models[g]["scale"], models[g]["beta"])
    return rows.withColumn("loglr", F.when(F.col(fold) == 0, score(0)).when(F.col(fold) == 1, score(1)))


def grid(rows: DataFrame, value: str, points: int = 513) -> list[float]:
    """The value's quantiles at evenly spaced shares, ends included (`points` numbers)."""
    return rows.agg(F.percentile(value, F.array(*(F.lit(k / (points - 1)) for k in range(points))))).first()[0]


def aligned(x: Column, source: list[float], target: list[float]) -> Column:
    """x moved from one run's quantiles to another's: linear between grid points, held at the ends. NaN and null stay."""

    @F.pandas_udf("double")
    def move(values: pd.Series) -> pd.Series:
        return pd.Series(np.interp(values, source, target)).where(values.notna().to_numpy())

    return move(x)


def reanchored(x: Column, mean_a: Column, sd_a: Column, mean_b: Column, sd_b: Column) -> Column:
    """A score of run a in deviations of run b."""
    return (x * sd_a + mean_a - mean_b) / sd_b


def weighted_density(rows: DataFrame, by: str, value: str, weight: str, points: list[float], least: int = 20) -> DataFrame:
    """by, x, density: a Gaussian kernel density of weighted values at fixed points, for groups of `least` rows or more.

    The bandwidth is Scott's rule for the effective count (squared sum of weights over sum of squares) times the weighted
    deviation. One scan for the sums and one for the density, both with map-side combine.
    """
    w, v = F.col(weight), F.col(value)
    sums = rows.groupBy(by).agg(F.count("*").alias("n"), F.sum(w).alias("w1"), F.sum(w * w).alias("w2"), F.sum(w * v).alias("wv"), F.sum(w * v * v).alias("wvv")).filter(F.col("n") >= least)
    share = F.col("w2") / (F.col("w1") * F.col("w1"))  # 1 over the effective count
    spread = (F.col("wvv") / F.col("w1") - F.pow(F.col("wv") / F.col("w1"), F.lit(2.0))) / (1 - share)
    sums = sums.select(by, "w1", (F.sqrt(spread) * F.pow(share, F.lit(0.2))).alias("h"))
    met = rows.join(F.broadcast(sums), by).select(by, weight, value, "w1", "h", F.explode(F.array(*map(F.lit, points))).alias("x"))
    kernel = w * F.exp(-F.pow((F.col("x") - v) / F.col("h"), F.lit(2.0)) / 2) / (F.col("h") * F.sqrt(F.lit(2 * np.pi)))
    return met.groupBy(by, "x").agg((F.sum(kernel) / F.first("w1")).alias("density"))
