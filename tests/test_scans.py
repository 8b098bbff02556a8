"""Catalogues in files, tables kept by their parameters, and the stream of families' maxima."""

from __future__ import annotations

import json
import math
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from duotrace.config import FIXTURE
from duotrace.sources import scans
from duotrace.sources.keyed import ParameterTable
from duotrace.streaming.families import family_maxima


def bank(spark, root, name, values, side=None):
    spark.createDataFrame([(k, float(v), -float(v)) for k, v in enumerate(values)], "k long, H1 double, L1 double").write.parquet(f"{root}/{name}.parquet")
    if side is not None:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / f"{name}.csv").write_text(side)


def test_a_bank_of_files_with_different_columns(spark, tmp_path):
    bank(spark, tmp_path, "a/signals_1", [1, 2], "source_id,distance_mpc,total_mass,mass1,mass2,projection_mode\n70,5,30.5,1,1,projected\n71,6,40,1,1,projected\n")
    bank(spark, tmp_path, "b/c/signals_2", [3, 4], "mass2,mass1,distance_mpc,source_id\n4,8.5,7,90\n1,2,8,91\n")
    bank(spark, tmp_path, "b/signals_3", [5], "source_id,distance_mpc\n3,9\n")
    bank(spark, tmp_path, "z/signals_projbank_4", [6, 7, 8])
    bank(spark, tmp_path, "z/other_5", [9])
    rows, mode = scans.signal_bank(spark, f"file://{tmp_path}")
    got = sorted((r["H1"], r["source_id"], r["total_mass"], r["distance_mpc"]) for r in rows.collect())
    assert mode == "projected" and [g[:2] for g in got] == [(1, 70), (2, 71), (3, 90), (4, 91), (5, 3), (6, 5), (7, 6), (8, 7)]
    assert [g[2] for g in got[:4]] == [30.5, 40, 12.5, 3] and all(math.isnan(g[2]) for g in got[4:]) and [g[3] for g in got[:5]] == [5, 6, 7, 8, 9]


def test_banks_that_fail(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scans.signal_bank(spark, f"file://{tmp_path}")
    bank(spark, tmp_path, "signals_projbank", [1])
    bank(spark, tmp_path, "signals_intrinsicbank", [1])
    with pytest.raises(ValueError, match="intrinsic, projected"):
        scans.signal_bank(spark, f"file://{tmp_path}")
    spark.createDataFrame([(0, 1.0)], "k long, H1 double").write.parquet(f"{tmp_path}/one/signals_x.parquet")
    with pytest.raises(KeyError, match="L1"):
        scans.signal_bank(spark, f"file://{tmp_path}/one")


def test_lists_in_documents_over_lines(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"{k}.json").write_text(json.dumps({"run": f"r{k}", "segments": [{"name": f"s{k}{i}", "start": i} for i in range(k)]}, indent=1))
    got = scans.json_list(spark, f"file://{tmp_path}", "segments", "run string, segments array<struct<name: string, start: long>>")
    assert sorted(map(tuple, got.collect())) == [("r1", "s10", 0), ("r2", "s20", 0), ("r2", "s21", 1)]
    (tmp_path / "3.json").write_text('{"run": ')
    with pytest.raises(Exception, match="(?i)malformed"):
        scans.json_list(spark, f"file://{tmp_path}", "segments", "run string, segments array<struct<name: string, start: long>>").count()


def test_a_second_run_adds_only_what_is_absent(spark, tmp_path):
    units = spark.createDataFrame([(u,) for u in range(6)], "seg long")
    asked = []

    def make(todo):
        asked.append(sorted(r[0] for r in todo.collect()))
        return todo.withColumn("v", F.col("seg") * 10)

    table = ParameterTable(spark, f"file://{tmp_path}", {"b": 2, "a": 1}, "seg")
    assert table.add(units.filter("seg < 2"), make) == 2 and table.add(units.filter("seg < 4"), make) == 2 and table.add(units.filter("seg < 4"), make) == 0
    assert asked == [[0, 1], [2, 3]]
    # a run that was lost after its rows and before its manifest: they aren't read, and the next run replaces them
    spark.createDataFrame([(4, 999)], "seg long, v long").write.partitionBy("seg").mode("append").parquet(table.data)
    again = ParameterTable(spark, f"file://{tmp_path}", {"a": 1, "b": 2}, "seg")  # the same parameters
    assert sorted(r["seg"] for r in again.read().collect()) == [0, 1, 2, 3]
    assert again.add(units, make) == 2 and sorted((r["seg"], r["v"]) for r in again.read().collect()) == [(u, 10 * u) for u in range(6)]
    assert ParameterTable(spark, f"file://{tmp_path}", {"a": 1, "b": 3}, "seg").present().count() == 0


def test_families_go_on_after_a_restart(spark, tmp_path):
    r = random.Random(4)
    at = lambda s: datetime.fromtimestamp(1_700_000_000 + s, timezone.utc).replace(tzinfo=None)
    rows = [(r.randint(0, 1), r.randint(0, 3), i, r.randint(0, 2), r.randint(0, 50), r.uniform(0, 40), round(r.uniform(3, 7), 1)) for i in range(400)]
    rows.sort(key=lambda x: x[5])
    schema = "fold int, ai long, ih long, bi long, il long, ts timestamp, net double"
    parts = [rows[:200], rows[200:], [(0, 0, 0, 9, 0, 500.0, 9.0)], [(0, 0, 0, 9, 0, 900.0, 9.0)]]  # the last two move the watermark on

    def run():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = family_maxima(stream, FIXTURE, "5 seconds").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    for part in parts:  # a new query each time, on the same checkpoint
        spark.createDataFrame([(*x[:5], at(x[5]), x[6]) for x in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    want = {}
    for fold, ai, ih, bi, il, s, net in rows:
        if net >= 4.0:
            key = (fold, bi, (1_700_000_000_000 + int(s * 1000)) // 4000)
            want.setdefault(key, []).append((-net, ai, ih, il))
    got = {(x["fold"], x["bi"], x["l1bin"]): (-x["net"], x["ai"], x["ih"], x["il"], x["n"]) for x in spark.read.parquet(f"{tmp_path}/out").collect() if x["bi"] != 9}
    assert got == {k: (*min(v), len(v)) for k, v in want.items()} and len(got) > 20
