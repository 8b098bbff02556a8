"""The streaming forms give what a plain loop over the same rows gives."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from duotrace.operators import intervals, ranking
from duotrace.operators.cluster import cluster_triggers
from duotrace.streaming.clusters import cluster_stream, coincidences, family_stream, sliding

START = datetime(2020, 1, 1)


def run(spark, make, df, path, name):
    df.write.parquet(path)
    stream = make(spark.readStream.schema(df.schema).parquet(path))
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_clusters(spark, tmp_path):
    rng = random.Random(3)
    at = sorted(rng.sample(range(400), 60))
    rows = [(seg, START + timedelta(seconds=t), float(rng.randrange(20))) for seg in (0, 1) for t in at[seg::2]]
    got = run(spark, cluster_stream, spark.createDataFrame(rows, "seg int, ts timestamp, net double"), str(tmp_path / "a"), "clusters")
    want = []
    for seg in (0, 1):
        groups = []
        for r in (r for r in rows if r[0] == seg):
            if groups and r[1] - groups[-1][-1][1] <= timedelta(seconds=4):
                groups[-1].append(r)
            else:
                groups.append([r])
        want += [(seg, max(g, key=lambda r: (r[2], -r[1].timestamp()))[1], max(r[2] for r in g), len(g)) for g in groups]
    assert sorted((r["seg"], r["ts"], r["net"], r["n"]) for r in got) == sorted(want)
    batch = cluster_triggers(spark.createDataFrame([(seg, int((t - START).total_seconds()), net) for seg, t, net in rows], "seg int, idx int, net double")).collect()
    assert sorted((r["seg"], START + timedelta(seconds=r["idx"]), r["net"]) for r in batch) == sorted(w[:3] for w in want)


def test_families(spark, tmp_path):
    rows = [(k % 2, k % 3, START + timedelta(seconds=k), float(k * 7 % 11)) for k in range(50)]
    got = run(spark, family_stream, spark.createDataFrame(rows, "fold int, bi int, ts timestamp, net double"), str(tmp_path / "b"), "families")
    want = {}
    for fold, bi, ts, net in rows:
        want.setdefault((fold, bi, int((ts - START).total_seconds()) // 4), []).append(net)
    assert sorted((r["fold"], r["bi"], int((r["start"] - START).total_seconds()) // 4, r["net"], r["n"]) for r in got) == sorted((*k, max(v), len(v)) for k, v in want.items())


def test_coincidences_resume_where_they_stopped(spark, tmp_path):
    """Two runs over one checkpoint see each row once; pairs are those of a plain loop."""
    rng = random.Random(4)
    rows = {x: [(k % 2, START + timedelta(milliseconds=rng.randrange(3000)), float(k)) for k in range(60)] for x in "hl"}
    schema = "seg int, ts timestamp, sigma double"
    paths = {x: str(tmp_path / x) for x in "hl"}
    got = []
    for part in (slice(0, 40), slice(40, None)):
        for x in "hl":
            spark.createDataFrame(rows[x][part], schema).write.mode("append").parquet(paths[x])
        out = coincidences(*(spark.readStream.schema(schema).parquet(paths[x]) for x in "hl"))
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted((r["seg"], r["ts_h"], r["ts_l"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((a[0], a[1], b[1]) for a in rows["h"] for b in rows["l"] if a[0] == b[0] and abs(a[1] - b[1]) <= timedelta(milliseconds=15))
    assert got == want and want


def test_sliding_windows(spark, tmp_path):
    rows = [(0, START + timedelta(seconds=k), float(k)) for k in range(12)]
    got = run(spark, sliding, spark.createDataFrame(rows, "seg int, ts timestamp, value double"), str(tmp_path / "s"), "sliding")
    assert {int((r["start"] - START).total_seconds()): (r["n"], r["mean"]) for r in got if r["n"] == 4} == {k: (4, k + 1.5) for k in range(9)}


def test_subtract_by_seconds(spark):
    rng = random.Random(7)
    some = lambda n: [(rng.randrange(2), a := rng.randrange(80), a + rng.randrange(12)) for _ in range(n)]
    locks, vetoes = some(12), some(6)
    frame = lambda rows: spark.createDataFrame(rows, 'seg int, start long, `end` long')
    got = {(r["seg"], t) for r in intervals.subtract(frame(locks), frame(vetoes)).collect() for t in range(r["start"], r["end"])}
    cover = lambda rows: {(s, t) for s, a, b in rows for t in range(a, b)}
    assert got == cover(locks) - cover(vetoes)
    assert intervals.subtract(frame([]), frame(vetoes)).count() == 0


def test_auc_of_ties_and_a_missing_class(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1.0, True), (1.0, False), (0.0, False), (2.0, True), (-1.0, True)], "x double, pos boolean")
    row = ranking.auc(df, "x", F.col("pos"), 0.7).first()
    assert (row["n_pos"], row["n_neg"], round(row["auc"], 6)) == (3, 2, round((1.5 + 2) / 6, 6))
    assert ranking.auc(df.filter("pos"), "x", F.col("pos"), 0.7).first()["auc"] is None
