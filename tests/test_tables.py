"""Sinks and small table operators, by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from duotrace.operators import tables
from duotrace.sources import tables as sinks


def test_streams_are_read_by_folder(spark, tmp_path):
    rows = [(s, d, i, float(i)) for s in (0, 1) for d in ("H1", "L1") for i in range(5)]
    path = str(tmp_path / "win")
    sinks.write_streams(spark.createDataFrame(rows, "seg int, det string, idx int, sigma double"), path)
    one = spark.read.parquet(path).filter("det = 'H1' and seg = 1")
    assert "PartitionFilters: [isnotnull(det" in one._jdf.queryExecution().toString() and [r["idx"] for r in one.collect()] == list(range(5))


def test_results_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_results(spark.createDataFrame([("a", 2.0), ("b", None), ("c", 1.0)], "name string, far double"), path, ["far"])
    rows = spark.read.schema("name string, far double").json(path).coalesce(1).collect()
    assert {(r["name"], r["far"]) for r in rows} == {("a", 2.0), ("b", None), ("c", 1.0)}


def test_a_missing_row_is_an_error(spark):
    rows, table = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "k int, v string")
    assert tables.required(rows.filter("k = 1"), table, ["k"], "v").collect() == [(1, "x")]
    with pytest.raises(Exception, match="no v for 2"):
        tables.required(rows, table, ["k"], "v").collect()


def test_even_choice_and_whole_windows(spark):
    got = tables.evenly(spark.range(11).withColumn("g", F.lit(0)), ["g"], ["id"], 5).collect()
    assert sorted(r["id"] for r in got) == [0, 2, 5, 7, 10]
    s = spark.createDataFrame([(0, k, 1) for k in (0, 1, 2, 3, 4, 5, 7, 8)], "seg int, at long, v int")  # 6 is missing
    assert sorted(r["w"] for r in tables.frames(s, ["seg"], "at", ["v"], 4, 1).collect()) == [0, 1, 2]


def test_clean_frames_need_bits_and_finite_values(spark):
    rows = [(0, i, 7, 23, 1.0) for i in range(40)]
    rows[5] = (0, 5, 3, 23, 1.0)  # a quality bit missing
    rows[12] = (0, 12, 7, 22, 1.0)  # a signal put in
    rows[13] = (0, 13, 7, 31, 1.0)  # the hardware bit may be set
    rows[20], rows[26], rows[33] = (0, 20, 7, 23, float("nan")), (0, 26, 7, 23, float("-inf")), (0, 33, 7, 23, None)
    got = tables.clean_frames(spark.createDataFrame(rows, "seg int, at long, dq long, inj long, v double"), ["seg"], "at", {"dq": 7, "inj": 23}, 4, 2, finite=("v",))
    bad = {5, 12, 20, 26, 33}
    assert sorted(r["w"] for r in got.collect()) == [w for w in range(19) if not bad & set(range(2 * w, 2 * w + 4))]
