"""Counts of families beyond a trigger, and values between a curve's points, against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from duotrace.operators import curves, far

ROW = "fold int, ai long, bi long, l1bin long, loglr double, hm double, lm double"
TRIG = "seg long, idx long, fold int, loglr double, hm double, lm double"


def plain(triggers, rows, inclusive):
    out = {}
    for seg, idx, fold, x, hm, lm in triggers:
        for k, mine in ((5, hm), (6, lm)):
            met = {(r[2], r[3]) for r in rows if r[0] == fold and seg not in (r[1], r[2]) and x is not None and r[4] is not None and (r[4] >= x if inclusive else r[4] > x) and r[k] >= mine}
            out.setdefault((seg, idx), []).append(len(met))
    return out


@pytest.mark.parametrize("inclusive", [False, True])
@pytest.mark.parametrize("grain", [0, 3])
def test_families_beyond_a_trigger(spark, inclusive, grain):
    r = random.Random(grain + inclusive)
    number = (lambda a, b: round(r.uniform(a, b) * grain) / grain) if grain else r.uniform  # coarse numbers make ties
    rows = [(r.randint(0, 1), r.randint(0, 5), r.randint(0, 5), r.randint(0, 3), number(0, 5), number(0, 1), number(0, 1)) for _ in range(1500)]
    rows += [(0, 1, 2, 9, None, 0.5, 0.5)] + [(0, 3, 3, 8, 9.0, 1.0, 1.0)] * 3
    triggers = [(r.randint(0, 6), i, r.randint(0, 1), number(-1, 6), number(0, 1), number(0, 1)) for i in range(60)] + [(9, 900, 0, None, 0.1, 0.1), (9, 901, 7, 0.0, 0.0, 0.0)]
    got = far.per_arm(spark.createDataFrame(triggers, TRIG), spark.createDataFrame(rows, ROW), "loglr", inclusive)
    assert {(g["seg"], g["idx"]): [g["n_hm"], g["n_lm"]] for g in got.collect()} == plain(triggers, rows, inclusive)


def test_no_background(spark):
    triggers = spark.createDataFrame([(0, 1, 0, 1.0, 0.5, 0.5)], TRIG)
    got = far.per_arm(triggers, spark.createDataFrame([], ROW), "loglr").collect()
    assert [(g["n_hm"], g["n_lm"]) for g in got] == [(0, 0)]


@pytest.mark.parametrize("points", [1, 2, 7, 400])
def test_interpolation(spark, points):
    r = random.Random(points)
    xs = sorted(r.sample(range(-5000, 5000), points))
    curve = [(x / 10 + (1e-7 if k % 50 == 1 else 0), math.exp(r.uniform(-5, 5))) for k, x in enumerate(xs)]
    asked = [(i, r.uniform(-600, 600)) for i in range(500)] + [(1000 + k, c[0]) for k, c in enumerate(curve[:20])] + [(2000, curve[0][0]), (2001, curve[-1][0]), (2002, None)]
    shuffled = curve + [(c[0], c[1] + 1) for c in curve[:3]] + [(None, 1.0)]  # of equal x the least counts
    r.shuffle(shuffled)
    for logarithmic in (False, True):
        got = {g["id"]: g for g in curves.interpolated(spark.createDataFrame(asked, "id int, v double"), spark.createDataFrame(shuffled, "x double, y double"), "v", "x", "y", "f", logarithmic).collect()}
        x, y = np.array(curve).T
        for i, v in asked:
            if v is None:
                assert got[i]["f"] is None
                continue
            want = np.interp(v, x, np.log(y) if logarithmic else y)
            assert got[i]["f"] == pytest.approx(math.exp(want) if logarithmic else want, rel=1e-9)
            assert (got[i]["f_low"], got[i]["f_high"]) == (v <= x[0], v >= x[-1])
        assert len(got) == len(asked)


def test_an_empty_curve(spark):
    got = curves.interpolated(spark.createDataFrame([(1, 2.0)], "id int, v double"), spark.createDataFrame([], "x double, y double"), "v", "x", "y", "f").collect()
    assert [tuple(g) for g in got] == [(1, 2.0, None, None, None)]
