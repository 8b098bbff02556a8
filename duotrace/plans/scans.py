"""Queries of catalogues in files and of tables kept by their parameters, all derived from the given tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from duotrace.plans.search import _WIN
from duotrace.plans.sensitivity import _INJ
from duotrace.sources import fixtures as fx
from duotrace.sources import keyed, scans
from duotrace.sources.tables import shared

FILES = 4


def bank_scan(spark, d):
    """A bank of nested files: one with total masses beside it, one with both masses, one without any, one without a side file."""
    root = f"{shared(spark)}/{uuid.uuid4().hex}"
    inj = fx.injections(spark, d).withColumn("f", (F.col("inj_id") % FILES)).withColumn("k", F.floor(F.col("inj_id") / FILES).cast("long"))
    first = inj.groupBy("f").agg(F.min("k").alias("low"))  # places count from 0 without a gap
    inj = inj.join(F.broadcast(first), "f").withColumn("k", F.col("k") - F.col("low"))
    second = F.col("mtot") * F.col("q") / (1 + F.col("q"))
    common = [F.col("inj_id").alias("source_id"), F.lit("projected").alias("projection_mode"), F.round(100.0 + F.col("inj_id") % 700, 1).alias("distance_mpc")]
    more = {0: [F.col("mtot").alias("total_mass")], 1: [(F.col("mtot") - second).alias("mass1"), second.alias("mass2")], 2: []}
    for f in range(FILES):
        part = inj.filter(F.col("f") == f)
        stem = f"{root}/{'deep/er' if f % 2 else 'top'}/signals_{f}_projbank"
        part.select("k", F.col("loglr").alias("H1"), (-F.col("loglr")).alias("L1")).write.parquet(f"{stem}.parquet")
        if f in more:
            part.repartitionByRange("k").sortWithinPartitions("k").select(*common, *more[f]).write.option("header", True).csv(f"{stem}.csv")
    bank, mode = scans.signal_bank(spark, root)
    mass = F.when(~F.isnan("total_mass"), F.round("total_mass", 6))
    return bank.select("file", "k", "source_id", mass.alias("total_mass"), F.when(~F.isnan("distance_mpc"), F.col("distance_mpc")).alias("distance_mpc"), F.round("H1", 6).alias("h1"), F.lit(mode).alias("mode"))


def segment_list(spark, d):
    """Windows listed by segment in JSON documents, read back as rows: how many a segment and stream has, and their span."""
    root = f"{shared(spark)}/{uuid.uuid4().hex}"
    win = fx.windows(spark, d).select("seg", "det", "idx", "gps", F.floor(F.col("idx") / 256).alias("part"))
    docs = win.groupBy("seg", "det", "part").agg(F.collect_list(F.struct("idx", "gps")).alias("windows"))  # 256 a document
    docs.select(F.to_json(F.struct("seg", "det", "windows")).alias("value")).write.text(root)
    rows = scans.json_list(spark, root, "windows", "seg long, det string, windows array<struct<idx: long, gps: double>>", lines=True)
    return rows.groupBy("seg", "det").agg(F.count("*").alias("n"), F.min("gps").alias("start"), F.max("gps").alias("end"))


def series_cache(spark, d):
    """A table of scores by segment that two runs fill: the first with four segments, the second with those still absent; rows of other parameters aren't seen."""
    path = f"{shared(spark)}/{uuid.uuid4().hex}"
    win = fx.windows(spark, d)
    make = lambda stride: lambda units: win.join(F.broadcast(units), "seg").filter(F.col("idx") % stride == 0).select("seg", "det", "idx", "sigma")
    whole, other = (keyed.ParameterTable(spark, path, {"stride": s, "window": 4}, "seg") for s in (1, 3))
    units = win.select("seg").distinct()
    first = whole.add(units.filter("seg < 4"), make(1))
    other.add(units.filter("seg < 2"), make(3))
    second = whole.add(units, make(1))
    third = whole.add(units, make(1))
    return whole.read().groupBy("seg").agg(F.count("*").alias("n"), F.round(F.sum("sigma"), 4).alias("total")).select(F.col("seg").cast("long").alias("seg"), "n", "total", F.lit(first).alias("first"), F.lit(second).alias("second"), F.lit(third).alias("third"))


QUERIES = {f.__name__: f for f in (bank_scan, segment_list, series_cache)}

ORACLES = {
    "bank_scan": _INJ + """, b AS (SELECT *, inj_id % 4 AS f, inj_id // 4 AS k0 FROM inj), c AS (SELECT *, k0 - min(k0) OVER (PARTITION BY f) AS k FROM b),
        r AS (SELECT count(*) FILTER (f IN (0, 2)) AS top, count(*) FILTER (f = 1) AS one FROM c)
        SELECT 'signals_' || f || '_projbank.parquet' AS file, k, CASE WHEN f < 3 THEN inj_id ELSE k + one END AS source_id, CASE WHEN f < 2 THEN round(mtot, 6) END AS total_mass,
        CASE WHEN f < 3 THEN round(100.0::DOUBLE + inj_id % 700, 1) END AS distance_mpc, round(loglr, 6) AS h1, 'projected' AS mode FROM c, r""",
    "segment_list": f"WITH {_WIN.strip()} SELECT seg, det, count(*) AS n, min(gps) AS start, max(gps) AS \"end\" FROM win GROUP BY ALL",
    "series_cache": f"WITH {_WIN.strip()} SELECT seg, count(*) AS n, round(sum(sigma), 4) AS total, 4::INT AS first, 4::INT AS second, 0::INT AS third FROM win GROUP BY seg",
}
