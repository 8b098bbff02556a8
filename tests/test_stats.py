"""Special functions: known values, and the joint solution against the single ones."""

from __future__ import annotations

import numpy as np
import pytest

from duotrace.functions.stats import clopper_pearson, garwood, poisson_upper, poisson_uppers


def test_upper_limits():
    assert poisson_upper(0) == pytest.approx(2.302585093, abs=1e-8)
    assert garwood(0)[0] == 0.0 and garwood(0)[1] == pytest.approx(2.995732274, abs=1e-8)
    n = np.array([0, 1, 2, 7, 40])
    assert poisson_uppers(n, 0.1) == pytest.approx([poisson_upper(int(x)) for x in n], abs=1e-8)


def test_clopper_pearson():
    low, high = clopper_pearson(0, 10)
    assert low == 0.0 and high == pytest.approx(1 - 0.025**0.1, abs=1e-8)
    assert clopper_pearson(10, 10)[1] == 1.0


def test_upper_limits_of_large_counts(spark):
    from pyspark.sql import functions as F

    from duotrace.functions.stats import poisson_upper_large

    n = np.array([401, 1000, 5000])
    got = spark.createDataFrame([(int(x),) for x in n], "n long").select("n", poisson_upper_large(F.col("n")).alias("ul")).orderBy("n").collect()
    assert [r["ul"] for r in got] == pytest.approx(poisson_uppers(n, 0.1), abs=1e-6)


def test_detections_have_limits_whatever_the_count(spark):
    """1,000 louder families: both channels' limits are there, and the combined one is that of the lesser rate, for two channels of two arms."""
    from duotrace.operators.far import rates

    trig = spark.createDataFrame([(0, 1, 0, 5.0, 4.5, 0.9, 0.9)], "seg long, idx long, fold int, loglr double, net double, hm double, lm double")
    families = lambda n, score: spark.createDataFrame([(0, 2, 4, k, 6.0, 0.95, 0.95) for k in range(n)], f"fold int, ai long, bi long, l1bin long, {score} double, hm double, lm double")
    for loud, least in ((3, 3), (1500, 1000)):
        row = rates(trig, families(1000, "loglr"), families(loud, "net"), spark.createDataFrame([(0, 2.0)], "fold int, live_yr double")).first()
        assert row["far_lr"] == 1000.0 and row["far_net"] == float(loud) and row["best_far"] == 2.0 * least
        assert abs(row["best_ul"] - 2 * poisson_uppers(np.array([least]), 0.1)[0]) < 1e-6 * row["best_ul"]
