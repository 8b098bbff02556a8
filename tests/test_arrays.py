"""Blocks, frames, spectra, lags and injections against numpy."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duotrace.operators import arrays


def made(spark, n=103, missing=(), seed=1):
    r = random.Random(seed)
    rows = [(s, i, r.uniform(-5, 5)) for s in (0, 1) for i in range(n) if (s, i) not in missing]
    return spark.createDataFrame(rows, "seg long, at long, v double").repartition(5), {(s, i): v for s, i, v in rows}


@pytest.mark.parametrize("size, length, step", [(16, 8, 4), (10, 10, 3), (5, 17, 6), (7, 3, 11), (64, 200, 1)])
def test_frames_cross_the_edges_of_blocks(spark, size, length, step):
    missing = {(1, 40), (0, 0)}
    samples, held = made(spark, missing=missing)
    got = {(f["seg"], f["start"]): f["s"] for f in arrays.frames(arrays.blocks(samples, ["seg"], "at", "v", size), ["seg"], size, length, step).collect()}
    want = {(s, a): [held[s, a + k] for k in range(length)] for s in (0, 1) for a in range(0, 103, step) if all((s, a + k) in held for k in range(length))}
    assert got == want


def test_a_missing_block_ends_the_frames_before_it(spark):
    samples, held = made(spark, n=60, missing={(0, i) for i in range(16, 32)})
    got = {(f["seg"], f["start"]) for f in arrays.frames(arrays.blocks(samples, ["seg"], "at", "v", 16), ["seg"], 16, 8, 4).collect()}
    assert got == {(s, a) for s in (0, 1) for a in range(0, 60, 4) if all((s, a + k) in held for k in range(8))}


def test_spectra_of_a_tone_and_noise(spark):
    n, rate = 64, 128.0
    t = np.arange(n) / rate
    rng = np.random.default_rng(1)
    frames = [np.sin(2 * np.pi * 16 * t) + 3, rng.normal(size=n), np.zeros(n)]
    rows = spark.createDataFrame([(i, [float(v) for v in f]) for i, f in enumerate(frames)], "i int, s array<double>")
    got = {r["i"]: np.array(r["p"]) for r in arrays.spectra(rows, rate).collect()}
    assert got[0].argmax() == 8 and len(got[0]) == n // 2 + 1 and not got[2].any()
    window = np.hanning(n + 1)[:-1]
    for i in (0, 1):
        x = (frames[i] - frames[i].mean()) * window
        assert got[i].sum() * rate == pytest.approx((x * x).sum() * n / (window**2).sum(), rel=1e-9)  # Parseval
    middle = arrays.spectra(rows, rate).select("i", F.round(arrays.centroid("p", rate, n, 10.0, 40.0), 6).alias("c")).collect()
    assert {m["i"]: m["c"] for m in middle}[0] == pytest.approx(16, abs=0.1) and {m["i"]: m["c"] for m in middle}[2] is None
    per = arrays.floored(arrays.by_element(arrays.spectra(rows, rate).withColumn("g", F.lit(1)), ["g"], "p", F.avg("v").alias("m")), ["g"], "m", 0.5)
    mean = np.mean([got[i] for i in range(3)], axis=0)
    assert [round(r["m"], 9) for r in per.orderBy("bin").collect()] == [round(float(v), 9) for v in np.maximum(mean, 0.5 * np.median(mean))]


@pytest.mark.parametrize("lags", [0, 3, 45])
def test_lags_by_transform_equal_a_loop(spark, lags):
    rng = np.random.default_rng(lags)
    pairs = [(i, rng.normal(size=20), rng.normal(size=20)) for i in range(10)]
    pairs.append((10, pairs[0][1], np.roll(pairs[0][1], 2)))
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, x, y in pairs], "i int, x array<double>, y array<double>")
    for pearson in (False, True):
        got = {r["i"]: r["c"] for r in arrays.max_lag(df, "x", "y", lags, "c", pearson).collect()}
        for i, x, y in pairs:
            if pearson:
                x, y = ((v - v.mean()) / (np.linalg.norm(v - v.mean()) + 1e-12) for v in (x, y))
            best = max(abs((x * np.roll(y, k)).sum()) for k in range(-lags, lags + 1))
            assert got[i] == pytest.approx(best if pearson else 2 * best / ((x * x).sum() + (y * y).sum()), rel=1e-6)


def test_signals_are_laid_over_stretches(spark):
    samples, held = made(spark)
    table = arrays.blocks(samples, ["seg"], "at", "v", 16)
    placed = [(1, 0, 3, 20), (2, 1, 30, 80), (3, 0, 90, 110), (4, 1, 16, 32)]  # the third runs past the end
    df = spark.createDataFrame(placed, "id int, seg long, lo long, hi long")
    got = {r["id"]: r for r in arrays.stretch(df, table, "seg", ["id"], 16, "lo", "hi").withColumn("h", F.array(F.lit(1.0), F.lit(2.0))).withColumn("x", arrays.laid_over("noise", "h", F.lit(-1), F.lit(3.0))).collect()}
    assert got.keys() == {1, 2, 4}
    for i, s, lo, hi in placed:
        if i in got:
            want = [held[s, k] for k in range(lo, hi)]
            assert got[i]["noise"] == want
            want[0] += 6.0  # the signal's first sample lies before the stretch
            assert got[i]["x"] == pytest.approx(want)
