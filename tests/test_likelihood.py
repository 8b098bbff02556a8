"""The fit, the alignment and the density against plain NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from duotrace.operators import likelihood

NAMES = ("a", "coh")


def rows_of(spark, x, y, fold):
    return spark.createDataFrame([(int(f), int(s), *map(float, v)) for f, s, v in zip(fold, y, x)], "fold int, signal int, a double, coh double")


def cost(x, y, mean, scale, beta):
    """What the fit makes least: half the rows times each class's mean loss, and the squared slopes."""
    score = beta[0] + sum(b * (x[:, k] - mean[k]) / scale[k] for k, b in enumerate(beta[1:]))
    losses = [np.logaddexp(0.0, -score[y == 1]).mean(), np.logaddexp(0.0, score[y == 0]).mean()]
    return len(y) / 2 * sum(losses) + sum(b * b for b in beta[1:])


@pytest.mark.parametrize("sign", [1, -1])
def test_no_allowed_step_lowers_the_cost(spark, sign):
    rng = np.random.default_rng(3)
    y = (np.arange(400) % 4 == 0).astype(int)
    x = np.column_stack([rng.normal(size=400) + y, rng.normal(size=400) + 0.5 * sign * y])
    m = likelihood.fit(rows_of(spark, x, y, y * 0), features=NAMES)
    assert np.allclose(m["mean"], x.mean(0)) and np.allclose(m["scale"], x.std(0) + 1e-9)
    found = cost(x, y, m["mean"], m["scale"], m["beta"])
    for size in (0.003, 0.03, 0.3, 3.0):
        for step in rng.normal(size=(150, 3)):
            other = np.array(m["beta"]) + size * step
            other[2] = max(other[2], 0.0)  # the slope that may not fall
            assert cost(x, y, m["mean"], m["scale"], other) >= found - 1e-6
    assert (m["beta"][2] > 0) if sign > 0 else (m["beta"][2] == 0)
    with pytest.raises(ValueError):
        likelihood.fit(rows_of(spark, x, y * 0, y), features=NAMES)


def test_folds_are_scored_by_each_other(spark):
    rng = np.random.default_rng(4)
    y, fold = (np.arange(300) % 3 == 0).astype(int), np.arange(300) % 2
    x = np.column_stack([rng.normal(size=300) + y, rng.normal(size=300) + y])
    df = rows_of(spark, x, y, fold)
    models = [likelihood.fit(df.filter(F.col("fold") == g), features=NAMES) for g in (0, 1)]
    for r in likelihood.cross_fit(df, features=NAMES).collect():
        m = models[1 - r["fold"]]
        assert r["loglr"] == pytest.approx(m["beta"][0] + sum(b * (r[c] - u) / s for b, c, u, s in zip(m["beta"][1:], NAMES, m["mean"], m["scale"])))


def test_alignment(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=700), 3 + 2 * rng.normal(size=900)
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v], "x double")
    source, target = likelihood.grid(frame(a), "x"), likelihood.grid(frame(b), "x")
    assert np.allclose(source, np.quantile(a, np.linspace(0, 1, 513)))
    odd = [-99.0, 99.0, 0.0, 0.5, None, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in odd], "x double").select(likelihood.aligned(F.col("x"), source, target)).collect()]
    assert got[0] == pytest.approx(b.min()) and got[1] == pytest.approx(b.max()) and np.allclose(got[2:4], np.interp([0.0, 0.5], source, target)) and got[4] is None
    assert got[5] is None or np.isnan(got[5])


def test_weighted_density(spark):
    rng = np.random.default_rng(6)
    v, w = rng.normal(size=50), rng.random(50)
    df = spark.createDataFrame([(0, float(x), float(y)) for x, y in zip(v, w)] + [(1, 0.0, 1.0)] * 19, "bin int, v double, w double")
    got = {r["x"]: r["density"] for r in likelihood.weighted_density(df, "bin", "v", "w", [-1.0, 0.0, 2.0]).collect()}
    neff = w.sum() ** 2 / (w**2).sum()
    h = np.sqrt(np.cov(v, aweights=w)) * neff**-0.2
    want = {x: (w * np.exp(-(((x - v) / h) ** 2) / 2)).sum() / w.sum() / (h * np.sqrt(2 * np.pi)) for x in (-1.0, 0.0, 2.0)}
    assert got == pytest.approx(want)
