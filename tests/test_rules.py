"""Small tables whose rows are written out by hand from the search's rules: comparisons at equality, floors, guards, empty sides."""

from __future__ import annotations

import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from duotrace.config import SearchConfig
from duotrace.functions.expr import kept_by
from duotrace.functions.stats import poisson_upper, poisson_upper_large
from duotrace.operators import cluster, far, pairing

CONFIG = SearchConfig()
T = "seg long, idx long, fold int, loglr double, net double, hm double, lm double, matches_known string"
B = "fold int, ai long, bi long, l1bin long, loglr double, hm double, lm double"
FAM = "fold int, ai long, bi long, l1bin long, net double, hm double, lm double"


def test_real_defaults():
    assert (CONFIG.net_cut, CONFIG.max_offsets, CONFIG.offset_step, CONFIG.min_self_offset, CONFIG.noise_cap, CONFIG.far_threshold) == (4.0, 400, 4, 3600, 15_000, 1.0)


def test_gaps_of_4_join_and_of_5_part(spark):
    rows = [(0, 0, 5.0), (0, 4, 5.0), (1, 0, 5.0), (1, 5, 6.0)]
    got = cluster.cluster_triggers(spark.createDataFrame(rows, "seg long, idx long, net double")).select("seg", "idx").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (1, 0), (1, 5)]  # equal net: the first


def test_kept_by_is_strict(spark):
    rows = [(0.5, 0.5), (0.51, 0.5), (0.51, 0.6), (0.1, 0.9)]
    got = spark.createDataFrame(rows, "hm double, lm double").select(kept_by(F.col("hm"), F.col("lm"))).collect()
    assert [r[0] for r in got] == ["none", "HM", "HM+LM", "+LM"]


def test_equal_scores_count_in_the_net_channel_alone(spark):
    t = spark.createDataFrame([(0, 1, 5.0), (0, 2, None), (1, 3, 9.0)], "fold int, idx long, x double")
    b = spark.createDataFrame([(0, 5.0), (0, 5.0), (0, 6.0), (0, 0.0), (2, 9.0)], "fold int, x double")
    for inclusive, want in ((False, {1: 1, 2: None, 3: 0}), (True, {1: 3, 2: None, 3: 0})):
        got = {r["idx"]: r["n"] for r in far.count_louder(t, b, "x", ["fold"], "n", inclusive).collect()}
        assert got == want


def test_arms_are_ranks_with_a_guard_for_the_own_segment(spark):
    t = spark.createDataFrame([(0, 7, 0, 5.0, 4.5, 0.4, 0.6, None), (2, 8, 0, 9.0, 4.0, 0.1, 0.1, None)], T)
    rows = [
        (0, 2, 4, 1, 5.0, 0.9, 0.9),  # as loud, not louder
        (0, 2, 4, 1, 5.1, 0.4, 0.5),  # arm hm as high
        (0, 4, 2, 1, 6.0, 0.3, 0.6),  # arm lm as high, another family
        (0, 2, 4, 1, 7.0, 0.4, 0.6),  # the first family again, now by both arms
        (0, 0, 4, 9, 8.0, 0.9, 0.9), (0, 4, 0, 9, 8.0, 0.9, 0.9),  # own segment
        (1, 3, 5, 9, 8.0, 0.9, 0.9),  # other fold
    ]
    got = {r["seg"]: (r["n_hm"], r["n_lm"]) for r in far.per_arm(t, spark.createDataFrame(rows, B), "loglr").collect()}
    assert got == {0: (1, 2), 2: (0, 0)}


def test_cells_of_any_size_give_the_same_counts(spark, monkeypatch):
    t = spark.createDataFrame([(s, i, 0, float(i), 4.5, 0.1 * s, 0.2, None) for s in (1, 2) for i in range(5)], T)
    b = spark.createDataFrame([(0, 3, 4, k, k / 3, (k % 7) / 10, 0.3) for k in range(20)], B)
    want = sorted(map(tuple, far.per_arm(t, b, "loglr").collect()))
    monkeypatch.setattr(far, "CELL", 3.1)
    monkeypatch.setattr(far, "ARM_CELL", 0.013)
    assert sorted(map(tuple, far.per_arm(t, b, "loglr").collect())) == want


def rated(spark, trig, background, fam, live, config):
    frames = (spark.createDataFrame(*x) for x in ((trig, T), (background, B), (fam, FAM), (live, "fold int, live_yr double")))
    return {(r["seg"], r["idx"]): r for r in far.detections(far.rates(*frames, config), config).collect()}


def test_rates_and_limits(spark):
    trig = [
        (0, 1, 0, 4.5, 3.9, 0.9, 0.9, None),  # at the floor of the ratio, under that of net
        (0, 2, 0, 4.4, 4.0, 0.9, 0.9, None),  # the other way round
        (0, 3, 0, 9.0, 9.0, 0.9, 0.9, None),  # nothing louder in either channel
        (0, 4, 0, 1.0, 1.0, 0.9, 0.9, "EV"),  # below both
        (1, 5, 1, 9.0, 9.0, 0.9, 0.9, None),  # a fold without livetime
        (0, 6, 0, 9.0, 9.0, 0.49, 0.4, None),  # a glitch
    ]
    background = [(0, 2, 4, k, 5.0 + k, 0.95, 0.95) for k in range(3)]
    fam = [(0, 2, 4, 1, 4.0, 0.95, 0.1)]
    config = replace(CONFIG, far_threshold=5.0)
    got = rated(spark, trig, background, fam, [(0, 2.0)], config)
    r = got[0, 1]
    assert (r["far_lr"], r["far_net"], r["best_far"], r["channel"]) == (2 * 3 / 2.0, None, 3.0, "loglr")
    assert r["best_ul"] == pytest.approx(2 * poisson_upper(3) / 2.0) and not r["detected"]
    r = got[0, 2]
    assert (r["far_lr"], r["far_net"], r["best_far"], r["channel"]) == (None, 0.0, 0.0, "net-sigma")  # 0.1 is a lower rank in lm
    assert r["best_ul"] == pytest.approx(math.log(10)) and r["detected"]
    r = got[0, 3]
    assert (r["best_far"], r["channel"]) == (0.0, "loglr") and r["best_ul"] == pytest.approx(2 * math.log(10)) and r["detected"]
    assert got[0, 4]["best_far"] is None and got[0, 4]["channel"] is None and not got[0, 4]["detected"]
    assert got[1, 5]["best_far"] is None and got[1, 5]["is_glitch"] is False
    assert got[0, 6]["is_glitch"] and not got[0, 6]["detected"]


def test_the_veto_rule_counts_what_the_cut_keeps(spark):
    background = [(0, 2, 4, 1, 6.0, 0.5, 0.5), (0, 2, 4, 2, 6.0, 0.6, 0.1), (0, 0, 4, 3, 6.0, 0.1, 0.6)]  # exactly 0.5 isn't kept; no guard
    got = rated(spark, [(0, 1, 0, 5.0, 4.0, 0.9, 0.9, None)], background, [(0, 2, 4, 1, 4.0, 0.1, 0.2)], [(0, 2.0)], replace(CONFIG, per_arm=False))[0, 1]
    assert (got["far_lr"], got["far_net"], got["best_far"], got["channel"]) == (1.0, 0.0, 0.0, "net-sigma")
    assert got["best_ul"] == pytest.approx(math.log(10) / 2)


def test_candidates_and_floor(spark):
    rows = [(0, k, 0, 4.5 + k, 1.0, 0.9, 0.9, None) for k in range(5)] + [(1, 0, 1, 0.0, 4.0, 0.9, 0.9, None), (1, 1, 1, 3.0, 1.0, 0.9, 0.9, "EV"), (1, 2, 1, 4.4, 1.0, 0.9, 0.9, None)]
    trig = spark.createDataFrame(rows, T)
    got = {(r["seg"], r["idx"]) for r in far.top_candidates(trig, replace(CONFIG, candidates=2)).collect()}
    assert got == {(0, 4), (0, 3), (1, 0), (1, 1)}
    assert far.floor_of(trig) == 3.0 and far.floor_of(trig, replace(CONFIG, blind_floor=True)) == 4.5


def test_limits_of_large_counts(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 400, 401, 5000, None)], "n long")
    got = {r["n"]: r["ul"] for r in far.with_upper(rows, "n", "ul").collect()}
    assert got[None] is None and got[0] == pytest.approx(2.302585093)
    assert got[401] == pytest.approx(poisson_upper(401), rel=1e-6) and got[5000] > got[401] > got[400]
    assert spark.range(1).select(poisson_upper_large(F.lit(1000.0))).first()[0] == pytest.approx(poisson_upper(1000), rel=1e-7)


def test_offsets(spark):
    segs = spark.createDataFrame([(0, 0, 20), (2, 0, 16), (4, 0, 10), (1, 1, 5000)], "seg long, fold int, n long")
    got = {}
    for r in pairing.pairings(segs).collect():
        got.setdefault((r["ai"], r["bi"]), set()).add(r["off"])
    assert got[0, 2] == got[2, 0] == {-12, -8, -4, 0, 4, 8, 12} and got[0, 4] == {-6, -2, 2, 6} and (0, 0) not in got and (0, 1) not in got
    whole = spark.createDataFrame([(0, 0, 100), (2, 0, 100)], "seg long, fold int, n long")
    offsets = sorted(r["off"] for r in pairing.pairings(whole).filter("ai = 0 and bi = 2").collect())
    assert offsets == list(range(-96, 97, 4))
    wide = pairing.pairings(whole, replace(CONFIG, offset_step=16, min_self_offset=64))
    assert sorted(r["off"] for r in wide.filter("ai = 0 and bi = 0").collect()) == [-80, -64, 64, 80]
    assert len(got[1, 1]) == 400 and min(abs(o) for o in got[1, 1]) >= 3600 and all((abs(o) - 3600) % 4 == 0 for o in got[1, 1])


def test_excision_and_matches(spark):
    near = spark.createDataFrame([("EV", 0, 10)], "name string, seg long, idx long")
    slide = spark.createDataFrame([(0, i, 2, 50) for i in range(6, 15)] + [(2, 50, 0, i) for i in range(6, 15)], "ai long, ih long, bi long, il long")
    got = {tuple(r) for r in pairing.excise(slide, near).collect()}
    assert got == {(0, i, 2, 50) for i in (6, 7, 13, 14)} | {(2, 50, 0, i) for i in (6, 7, 13, 14)}
    trig = spark.createDataFrame([(0, 8), (0, 13), (1, 10)], "seg long, idx long")
    assert {tuple(r) for r in far.known_matches(trig, near).collect()} == {(0, 8, "EV"), (0, 13, None), (1, 10, None)}
