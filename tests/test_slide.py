"""Slid pairs read off blocks of windows: the same rows as a join of all, and no exchange of slid rows."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from duotrace.config import FIXTURE
from duotrace.operators import far, pairing
from duotrace.plans import registry, search
from duotrace.sources.tables import written

SF = "/root/testdata/sf0.01"


def test_slid_pairs_by_brute_force(spark):
    """Blocks of any size, segments of other lengths, gaps, an index that occurs twice, and windows left out."""
    win = [(s, det, i, 1000.0 * s + i, (i * 37 + s * 11 + k) % 19 / 3.0, float(i % 7), 0.0, s % 2) for s, n in ((0, 41), (2, 30), (1, 25)) for k, det in enumerate(("H1", "L1")) for i in range(n) if (i + s) % 9 != 4 or k]
    win.append((0, "L1", 7, 7.5, 9.0, 1.0, 2.0, 0))
    windows = spark.createDataFrame(win, "seg long, det string, idx long, gps double, sigma double, centroid double, g double, fold int")
    segs = spark.createDataFrame([(0, 0, 38), (2, 0, 30), (1, 1, 25)], "seg long, fold int, n long")
    pairs = pairing.pairings(segs, replace(FIXTURE, offset_step=3, min_self_offset=6, max_offsets=9))
    out = spark.createDataFrame([(0, 5), (2, 11)], "seg long, idx long")
    size, left_out = {0: 38, 2: 30, 1: 25}, {(0, 5), (2, 11)}
    by = defaultdict(list)
    for w in win:
        if w[2] < size[w[0]] and (w[0], w[2]) not in left_out:
            by[w[0], w[1]].append(w)
    want = sorted((p["ai"], p["bi"], p["off"], h[2], low[2], h[4], low[4], low[3]) for p in pairs.collect() for h in by[p["ai"], "H1"] for low in by[p["bi"], "L1"] if low[2] == h[2] + p["off"])
    assert any(w[7] == 7.5 for w in want)
    for block in (4, 7, 64):
        got = pairing.time_slide(windows, pairs, segs, out, block).select("ai", "bi", "off", "ih", "il", "sigma_h", "sigma_l", "gps_l")
        assert sorted(map(tuple, got.collect())) == want


def test_offsets_do_not_depend_on_stretches(spark, monkeypatch):
    segs = spark.createDataFrame([(0, 0, 900), (2, 0, 700)], "seg long, fold int, n long")
    whole = sorted(map(tuple, pairing.pairings(segs, FIXTURE).collect()))
    monkeypatch.setattr(pairing, "CHUNK", 3)
    assert sorted(map(tuple, pairing.pairings(segs, FIXTURE).collect())) == whole


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["livetime_full", "excision_antijoin_full", "family_max_full", "noise_sample_cap_full"])
def test_no_exchange_of_slid_rows(spark, name):
    plan = registry.FULL_QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert all("il#" not in line and "ih#" not in line for line in plan.splitlines() if "Exchange hashpartitioning(" in line)


def test_copies_do_not_grow_with_the_length_of_streams(spark, monkeypatch):
    """A stream of any length is BLOCKS blocks, only blocks that meet are sent, and their size changes no row."""
    monkeypatch.setattr(pairing, "BLOCK", 16)
    sent = {}
    for n in (400, 3200):
        windows = spark.sql(
            f"select s.id * 2 as seg, d.det, w.id as idx, w.id + 0.5D as gps, (w.id % 7) + 0.0D as sigma, 0.0D as centroid, 0.0D as g, 0 as fold from range(2) s, (values ('H1'), ('L1')) d(det), range({n}) w"
        )
        segs = spark.createDataFrame([(0, 0, n), (2, 0, n)], "seg long, fold int, n long")
        pairs = pairing.pairings(segs, replace(FIXTURE, offset_step=1, min_self_offset=1, max_offsets=n))
        slid = pairing.time_slide(windows, pairs, segs)
        assert slid.count() == pairs.agg({"off": "count"}).first()[0] * n - pairs.selectExpr("sum(abs(off))").first()[0]
        assert slid.filter("il <> ih + off or gps_l <> il + 0.5D or gps_h <> ih + 0.5D or sigma_l <> il % 7").count() == 0
        sent[n] = -(-n // pairing.block_size(segs))
    assert sent == {400: 8, 3200: 8}


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["per_arm_far", "fitted_detections", "best_far_detections", "named_events", "needed_pairs"])
def test_generated_code_of_slid_rows_is_compiled(spark, monkeypatch, name):
    """The JVM never compiles a method of over 8000 bytes, and one that all slid rows pass through takes ten times the seconds."""
    plans = []

    def kept(df):
        plans.append(df)
        return written(df)

    for module in (pairing, far, search):
        monkeypatch.setattr(module, "written", kept)
    plans.append(registry.QUERIES[name](spark, SF))
    debug = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # its plans show no code before they run
    try:
        sizes = {}
        for df in plans:
            code = debug.codegenStringSeq(df.select("*")._jdf.queryExecution().executedPlan()).iterator()
            while code.hasNext():
                part = code.next()
                sizes[part._1()] = part._3().maxMethodCodeSize()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    passed = {tree: size for tree, size in sizes.items() if "explode(offs" in tree and "CollectMetrics bounded" not in tree}  # up to the bound, which few rows pass
    assert passed and max(passed.values()) < 8000


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["needed_pairs", "noise_sample_cap_full"])
def test_blocks_and_offsets_are_made_once(spark, name):
    """Passes over slid pairs read the blocks and offsets that were written; windows aren't numbered, sorted into blocks or paired again."""
    plan = registry.QUERIES.get(name, registry.FULL_QUERIES.get(name))(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(offs") > 1
    assert "row_number" not in plan and "collect_list(struct" not in plan


def test_generated_code_holds_a_stretch_of_pairs(spark, monkeypatch):
    """Of slid pairs, no more are made than a stretch before the next step takes the first, whatever the lengths of blocks and of lists of offsets."""
    monkeypatch.setattr(pairing, "STRETCH", 64, raising=False)
    n = 3200
    windows = spark.sql(f"select s.id * 2 as seg, d.det, w.id as idx, w.id + 0.5D as gps, (w.id % 7) + 0.0D as sigma, 0.0D as centroid, 0.0D as g, 0 as fold from range(2) s, (values ('H1'), ('L1')) d(det), range({n}) w")
    segs = spark.createDataFrame([(0, 0, n), (2, 0, n)], "seg long, fold int, n long")
    pairs = pairing.pairings(segs, replace(FIXTURE, offset_step=100, min_self_offset=100, max_offsets=20))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = pairing.time_slide(windows, pairs, segs).observe("slid", F.count("*")).limit(1)
        assert len(one.collect()) == 1
        plan, made, names = one._jdf.queryExecution().executedPlan(), [], []
        while plan.children().size():
            names.append(plan.nodeName())
            if plan.nodeName() == "Generate":
                made.append(plan.metrics().apply("numOutputRows").value())
            plan = plan.children().apply(0)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert 0 < made[0] <= 64
    assert "Exchange" not in names[: names.index("SortMergeJoin")]  # rows that hold an offset's blocks stay where they are made


def test_tasks_grow_with_the_windows(spark):
    """A task makes blocks of, and is dealt, bounded bytes: six times the windows get six times the tasks."""
    segs = lambda n: spark.createDataFrame([(s, s % 2, n) for s in range(8)], "seg long, fold int, n long")
    few, many = (pairing.task_parts(segs(n), pairing.block_size(segs(n))) for n in (400_000, 2_400_000))
    assert few == (25, 49) and many == (147, 293)
