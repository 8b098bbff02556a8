"""Numbers by buckets, strata, splits and exact intervals against plain versions."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from duotrace.functions.stats import beta_cdf, binomial_cdf, clopper_pearson, share_bounds, with_share_interval
from duotrace.operators import allocation
from duotrace.operators.allocation import MARKS


def table(spark, rows, schema="inj_id long, cell int"):
    return spark.createDataFrame(rows, schema)


def marks(k, salt=7919):
    return (k * salt + 1) % MARKS


def test_numbers_are_gapless_in_order_and_one_key_may_hold_nearly_all(spark):
    rows = [(k, 0 if k % 50 else None) for k in range(3000)]
    df = table(spark, rows).withColumn("m", allocation.mark(F.col("inj_id"), 7919)).withColumn("q", F.lit(17))
    for quota, most in ((None, 10**9), ("q", 17)):
        got = {(r["inj_id"], r["cell"]): r["place"] for r in allocation.numbered(df, ["cell"], "m", "inj_id", "place", quota).collect()}
        want = {}
        for cell in (0, None):
            order = sorted((k for k, c in rows if c == cell), key=lambda k: (marks(k), k))
            want |= {(k, cell): p for p, k in enumerate(order) if p < most}
        assert got == want
    assert allocation.numbered(df.limit(0), ["cell"], "m", "inj_id", "place").count() == 0


@pytest.mark.parametrize("count", [0, 7, 20, 33, 50])
def test_strata_with_remainders_leftovers_and_fills(spark, count):
    rows = [(k, 0) for k in range(25)] + [(100 + k, 1) for k in range(3)] + [(200, 3)] + [(300 + k, None) for k in range(4)]
    cells = 4
    picked, how = [], Counter()
    for cell in range(cells):
        order = sorted((k for k, c in rows if c == cell), key=lambda k: (marks(k), k))
        part = order[: count // cells + (cell < count % cells)]
        picked += [(k, "cell") for k in part]
    rest = sorted((k for k, c in rows if c is not None and (k, "cell") not in picked), key=lambda k: (marks(k, 104729), k))
    picked += [(k, "left") for k in rest[: count - len(picked)]]
    every = sorted((k for k, _ in rows), key=lambda k: (marks(k), k))
    picked += [(every[marks(j, 15485863) * len(every) // MARKS], "fill") for j in range(count - len(picked))]
    how = Counter(picked)
    got = {(r["inj_id"], r["how"]): r["times"] for r in allocation.stratified(table(spark, rows), "cell", cells, "inj_id", count).collect()}
    assert got == dict(how) and sum(got.values()) == count


def test_an_empty_table_has_nothing_to_draw(spark):
    empty = table(spark, [])
    assert allocation.stratified(empty, "cell", 3, "inj_id", 0).count() == 0
    with pytest.raises(ValueError):
        allocation.stratified(empty, "cell", 3, "inj_id", 1)


def test_a_split_has_no_empty_part(spark):
    rows = table(spark, [(k, 0) for k in range(5)])
    got = Counter(r["split"] for r in allocation.split(rows, "inj_id", 0.01, 0.01).collect())
    assert got == {"test": 1, "val": 1, "train": 3}
    with pytest.raises(ValueError):
        allocation.split(rows.limit(2), "inj_id", 0.01, 0.01)


def test_of_both_maps_the_right_one_wins(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS x, map('b', 3, 'c', 4) AS y")
    assert df.select(allocation.union_right_wins(F.col("x"), F.col("y")).alias("m")).first()["m"] == {"a": 1, "b": 3, "c": 4}


def test_intervals_of_shares():
    k, n = np.array([0, 1, 5, 10, 300, 999, 40]), np.array([10, 10, 10, 10, 1000, 1000, 40])
    low, high = share_bounds(k, n)
    want = [clopper_pearson(int(a), int(b)) for a, b in zip(k, n)]
    assert low == pytest.approx([w[0] for w in want], abs=1e-9) and high == pytest.approx([w[1] for w in want], abs=1e-9)
    # The chance of k or more of n at a share is the beta function of (k, n - k + 1).
    assert beta_cdf(np.array([0.3]), np.array([4.0]), np.array([7.0]))[0] == pytest.approx(1 - binomial_cdf(3, 10, 0.3), abs=1e-12)
    low, high = share_bounds(np.array([5 * 10**8]), np.array([10**9]))
    assert 0 < high[0] - low[0] < 7e-5 and low[0] < 0.5 < high[0]


def test_intervals_of_odd_counts(spark):
    rows = spark.createDataFrame([(1, 4), (0, 0), (None, 3), (3, None)], "k long, n long")
    got = {(r["k"], r["n"]): (r["low"], r["high"]) for r in with_share_interval(rows, "k", "n").collect()}
    assert got[1, 4] == pytest.approx(clopper_pearson(1, 4), abs=1e-9)
    assert got[0, 0] == got[None, 3] == got[3, None] == (None, None)
    assert with_share_interval(rows.limit(0), "k", "n").count() == 0
