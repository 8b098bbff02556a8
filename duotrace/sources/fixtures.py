"""The canonical tables of a search, as views over the driver's tables.

A real deployment has them as Parquet, partitioned by segment and stream; every operator takes DataFrames of these
columns and doesn't care where they come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Digits that derived numbers are rounded to, so that sums of another order give the same rows.
DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seg, det, ts, event_id, value, k, event_type: a row an event, dealt to eight segments and two streams."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("seg"),
        F.when(F.col("event_id") % 2 == 0, "H1").otherwise("L1").alias("det"),
        "ts",
        "event_id",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "event_type",
    )


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seg, det, idx, gps, sigma, centroid, g, fold: a row a window of one stream.

    sigma is the value in standard deviations from its stream's mean. Both come from one scan: the means are a handful of
    rows, which Spark broadcasts.
    """
    raw = raw_windows(spark, sf_dir)
    scale = raw.groupBy("det").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    place = Window.partitionBy("seg", "det").orderBy("ts", "event_id")
    glitch = F.expr("CASE event_type WHEN 'click' THEN -2 WHEN 'view' THEN -1 WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 ELSE 8 END")
    idx = F.row_number().over(place) - 1
    return (
        raw.withColumn("idx", idx.cast("long"))
        .join(F.broadcast(scale), "det")
        .select(
            "seg",
            "det",
            "idx",
            (1000000.0 * F.col("seg") + F.col("idx") + 2.0).alias("gps"),
            F.round((F.col("value") - F.col("mean")) / F.col("sd"), DIGITS).alias("sigma"),
            F.col("k").cast("double").alias("centroid"),
            glitch.cast("double").alias("g"),
            (F.col("seg") % 2).cast("int").alias("fold"),
        )
    )


def segments(win: DataFrame) -> DataFrame:
    """seg, fold, n: segments that have both streams, with as many windows as the shorter has."""
    counts = win.groupBy("seg", "fold").agg(F.count_if(F.col("det") == "H1").alias("h"), F.count_if(F.col("det") == "L1").alias("l"))
    return counts.select("seg", "fold", F.least("h", "l").alias("n")).filter("n > 0")


def injections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """inj_id, mtot, q, loglr, gated, noise_half: simulated signals."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("inj_id"),
        (10.0 + key % 390).alias("mtot"),
        (0.1 + 0.9 * ((key * 37) % 1000) / 1000.0).alias("q"),
        (F.col("o_totalprice") / 50000.0 - 3).alias("loglr"),
        (key % 5 != 0).alias("gated"),
        (key % 2).cast("int").alias("noise_half"),
    )


def series(spark: SparkSession, sf_dir: str, keys: DataFrame) -> DataFrame:
    """seg, det, idx, s: the sample series of the windows in keys."""
    vec = (F.col("seg") * 131 + F.col("idx") * 17 + F.when(F.col("det") == "L1", 7).otherwise(0)) % 500
    samples = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vec"), F.col("embedding").alias("s"))
    return keys.withColumn("vec", vec).join(samples, "vec").drop("vec")
