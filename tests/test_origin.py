"""Probability of origin: densities, rates, resampling and draws against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duotrace.operators import origin
from duotrace.plans.origin import STAND_IN, OriginConfig


def normal(x, m, s):
    return math.exp(-0.5 * ((x - m) / s) ** 2) / (s * math.sqrt(2 * math.pi))


def test_rates_reach_the_likeliest_pair(spark):
    r = random.Random(1)
    rows = []
    for key, share in ((0, 0.2), (1, 0.7), (2, 0.5)):
        for _ in range(300):
            x = r.gauss(3, 1) if r.random() < share else r.gauss(0, 1)
            rows.append((key, normal(x, 3, 1), normal(x, 0, 1)))
    got = {row["share"]: (row["rate_s"], row["rate_n"]) for row in origin.fit_rates(spark.createDataFrame(rows, "share int, ps double, pn double"), "share", passes=200, tolerance=1e-7).collect()}
    for key, (s, n) in got.items():
        ps, pn = (np.array([x[i] for x in rows if x[0] == key]) for i in (1, 2))
        assert s + n == pytest.approx(300, abs=1e-6)
        grid = np.linspace(0.5, 299.5, 29901)  # the total is the number of events at the maximum
        best = grid[np.argmax([np.log(g * ps + (300 - g) * pn).sum() for g in grid])]
        assert s == pytest.approx(best, abs=0.02)


def test_rates_of_events_without_any_density(spark):
    rows = [(0, 0.0, 0.5), (0, None, 0.5), (1, 0.0, 0.0)]
    got = {r["share"]: r for r in origin.fit_rates(spark.createDataFrame(rows, "share int, ps double, pn double"), "share", passes=30).collect()}
    assert got[0]["rate_s"] < 1e-9 and got[0]["rate_n"] == pytest.approx(2)
    assert got[1]["rate_s"] + got[1]["rate_n"] == pytest.approx(1)
    assert origin.fit_rates(spark.createDataFrame([], "share int, ps double, pn double"), "share", passes=3).count() == 0


def test_kernels_of_near_rows_equal_those_of_all(spark):
    r = random.Random(2)
    sample = [(k, r.gauss(0, 4), r.random(), 0.3 + k, r.randint(0, 2)) for k in (0, 1) for _ in range(300)]
    points = [(p, k, r.uniform(-15, 15)) for p in range(60) for k in (0, 1)] + [(99, 0, 1e6)]
    got = {(x["p"], x["key"], x["g"]): x["k"] for x in origin.kernel_sums(spark.createDataFrame(points, "p int, key int, x double"), spark.createDataFrame(sample, "key int, v double, w double, width double, g int"), ["p", "key"], "x", "v", "w", ["g"]).collect()}
    for p, k, x in points:
        for g in range(3):
            want = sum(w * normal(x, v, h) for kk, v, w, h, gg in sample if (kk, gg) == (k, g))
            assert abs(got.get((p, k, g), 0.0) - want) < 1e-12


def test_noise_sample_stands_for_all_noise(spark):
    rows = [(i, float(i % 17)) for i in range(1000)]
    sample = origin.stratified_noise(spark.createDataFrame(rows, "id long, score double"), "score", ["id"], F.col("id") * 7919 % 1009, 50, 100).collect()
    assert len(sample) == 150 and len({r["id"] for r in sample}) == 150
    assert sum(r["base"] for r in sample) == pytest.approx(1)
    assert sorted(r["id"] for r in sample if r["base"] == 1 / 1000) == sorted(i for i, _ in sorted(rows, key=lambda x: (-x[1], x[0]))[:50])
    scores = np.array([s for _, s in rows])
    assert sample[0]["width"] == pytest.approx(1.06 * scores.std() * 1000**-0.2)
    few = origin.stratified_noise(spark.createDataFrame(rows[:30], "id long, score double"), "score", ["id"], F.col("id"), 50, 100).collect()
    assert len(few) == 30 and sum(r["base"] for r in few) == pytest.approx(1)


def test_proposal_is_a_smoothed_histogram(spark):
    r = random.Random(3)
    xy = [(r.gauss(0, 1), r.uniform(0, 1)) for _ in range(2000)]
    placed, grid = origin.proposal_density(spark.createDataFrame(xy, "x double, y double"), F.col("x"), F.col("y"), cells=20)
    x, y = np.array(xy).T
    ends = [(v.min() - 1e-3, v.max() + 1e-3) for v in (x, y)]
    hist, ex, ey = np.histogram2d(x, y, bins=20, range=ends)
    weights = np.exp(-0.5 * np.arange(-4, 5) ** 2)
    weights /= weights.sum()
    for axis in (0, 1):
        padded = np.pad(hist, [(4, 4) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        hist = np.apply_along_axis(lambda v: np.convolve(v, weights, "valid"), axis, padded)
    want = (hist + 1e-6) / ((hist + 1e-6).sum() * (ex[1] - ex[0]) * (ey[1] - ey[0]))
    got = {(g["i"], g["j"]): g["density"] for g in grid.collect()}
    for (i, j), v in got.items():
        assert v == pytest.approx(want[i, j], rel=1e-9)
    assert {(p["i"], p["j"]) for p in placed.collect()} <= got.keys()


def test_population_norm_is_the_sum_of_its_density(spark):
    p = origin.Population()
    cells = 60
    m = np.exp(np.linspace(np.log(5), np.log(350), cells))
    side = m * np.gradient(np.log(m))
    rows = [(float(a), float(b), float(u * v)) for a, u in zip(m, side) for b, v in zip(m, side)]
    for high in (0.0, 0.05, 1.0):
        got = spark.createDataFrame(rows, "m1 double, m2 double, area double").agg(F.sum(p.density(F.col("m1"), F.col("m2"), high) * F.col("area"))).first()[0]
        assert got == pytest.approx(p.norm(high, cells), rel=1e-9)


def test_resampling_weighs_pairs_by_both_segments(spark):
    kernels = [(1, 0, 0, 0.5), (1, 0, 1, 0.25), (1, 2, 1, 1.0), (2, 2, 2, 4.0)]
    got = {(r["e"], r["rep"]): r["k"] for r in origin.resampled(spark.createDataFrame(kernels, "e int, a long, b long, k double"), ["e"], "a", "b", 300).collect()}

    def draw(rep, key, salt):
        u = ((rep * 15485863 + key * 104729 + salt) * 7919) % 1000003 / 1000003.0
        return sum(u >= c for c in origin.POISSON)

    for rep in range(300):
        for e in (1, 2):
            assert got[e, rep] == pytest.approx(sum(k * draw(rep, a, 12345) * draw(rep, b, 67891) for x, a, b, k in kernels if x == e))
    assert np.mean([draw(r, 1, 12345) for r in range(300)]) == pytest.approx(1, abs=0.15)


def test_draws_follow_the_weights(spark):
    rows = [(i, w) for i, w in enumerate([0.0, 5.0, 1.0, 0.0, 1000.0, 2.5] + [0.5] * 200)]
    df = spark.createDataFrame(rows, "id long, w double")
    got = {r["id"]: r["drawn"] for r in origin.weighted_draws(df, "w", F.floor(F.col("id") / 10), ["id"], 5000, 12345).collect()}
    total, edge, want = sum(w for _, w in rows), 0.0, {}
    us = [(((k * 15485863 + 12345) * 7919) % 1000003 + 0.5) / 1000003 for k in range(5000)]
    for i, w in rows:
        n = sum(edge / total <= u < (edge + w) / total for u in us)
        edge += w
        if n:
            want[i] = n
    assert got == want and sum(got.values()) == 5000 and 0 not in got and got[4] > 4000


def test_defaults_are_those_of_a_whole_analysis():
    whole = OriginConfig()
    assert (whole.reps, whole.mock, whole.tail, whole.bulk, whole.threshold, whole.seen_rate) == (1000, 150_000, 40_000, 40_000, 0.9, 10.0) and STAND_IN.high_shares == whole.high_shares


def test_kernels_by_expansions_equal_those_of_rows(spark):
    """Points meet a row a cell, not a row of the sample; sums agree with brute force to the last digits, also nine widths away and far from zero."""
    r = random.Random(5)
    sample = [(k, 1e4 * k + r.gauss(0, 2), r.random(), 0.3 + k) for k in (0, 1) for _ in range(4000)]
    points = [(p, k, 1e4 * k + r.uniform(-12, 12)) for p in range(40) for k in (0, 1)] + [(98, 0, min(s[1] for s in sample if s[0] == 0) - 0.3 * 8.9), (99, 0, 1e6)]
    rows = spark.createDataFrame(sample, "key int, v double, w double, width double")
    cells = origin.expansions(rows, ["key"], "v", "w")
    assert cells.count() == len({(k, math.floor(v / (origin.STEP * h))) for k, v, _, h in sample}) < 200
    got = {(x["p"], x["key"]): x["k"] for x in origin.kernel_sums(spark.createDataFrame(points, "p int, key int, x double"), rows, ["p", "key"], "x", "v", "w", []).collect()}
    assert (99, 0) not in got
    for p, k, x in points[:-1]:
        want = math.fsum(w * normal(x, v, h) for kk, v, w, h in sample if kk == k)
        assert got.get((p, k), 0.0) == pytest.approx(want, rel=1e-9, abs=1e-17)


def test_shares_of_resampled_segments(spark):
    """The same quantiles as from a row a repetition, for events with several pairs, one, or none."""
    kernels = [(1, 0, 0, 0.5), (1, 0, 1, 0.25), (1, 2, 1, 1.0), (2, 2, 2, 4.0)]
    events = [(e, s, 0.1 * s + e, 2.0, 3.0 + s) for e in (1, 2, 3) for s in (0, 1)]
    k = spark.createDataFrame(kernels, "e int, a long, b long, k double")
    each = spark.createDataFrame(events, "e int, share int, ps double, rate_s double, rate_n double")
    got = {(x["e"], x["share"]): (x["mid"], x["low"]) for x in origin.resampled_shares(each, k, ["e"], "a", "b", 200, {"mid": 0.5, "low": 0.05}).collect()}
    noise = {(x["e"], x["rep"]): x["k"] for x in origin.resampled(k, ["e"], "a", "b", 200).collect()}
    assert len(got) == 6
    for e, s, ps, rate_s, rate_n in events:
        p = [rate_s * ps / (rate_s * ps + rate_n * max(noise.get((e, rep), 0.0), origin.TINY)) for rep in range(200)]
        assert got[e, s] == pytest.approx((np.quantile(p, 0.5), np.quantile(p, 0.05)), rel=1e-12)
