"""Clusters and families of triggers as Structured Streaming: bounded state behind a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duotrace.config import SearchConfig
from duotrace.functions.expr import net


def cluster_stream(triggers: DataFrame, config: SearchConfig = SearchConfig(), delay: str = "30 seconds") -> DataFrame:
    """seg, start, end, ts, net, n: a row for each session of triggers (seg, ts, net) of a segment, with its loudest one (the first of equals).

    A session ends when nothing comes for cluster_gap windows; triggers exactly that far apart are merged, as in
    cluster.cluster_triggers. Rows later than `delay` behind the newest are dropped, as a watermark does.
    """
    gap = f"{round(config.cluster_gap * config.stride_s * 1e6)} microseconds"
    loud = F.max(F.struct("net", (-F.unix_micros("ts")).alias("first")))
    out = triggers.withWatermark("ts", delay).groupBy("seg", F.session_window("ts", gap).alias("w")).agg(loud.alias("top"), F.count("*").alias("n"))
    return out.select("seg", F.col("w.start").alias("start"), F.col("w.end").alias("end"), F.timestamp_micros(-F.col("top.first")).alias("ts"), F.col("top.net").alias("net"), "n")


def family_stream(pairs: DataFrame, width: str = "4 seconds", delay: str = "30 seconds") -> DataFrame:
    """fold, bi, start, net, n: the loudest pair of each family, a tumbling window of the second stream's time."""
    out = pairs.withWatermark("ts", delay).groupBy("fold", "bi", F.window("ts", width).alias("w")).agg(F.max("net").alias("net"), F.count("*").alias("n"))
    return out.select("fold", "bi", F.col("w.start").alias("start"), "net", "n")


def coincidences(h: DataFrame, low: DataFrame, within: str = "15 milliseconds", delay: str = "30 seconds") -> DataFrame:
    """seg, ts_h, ts_l, net: triggers (seg, ts, sigma) of both streams that come within a time of each other.

    A stream-stream join: both sides' watermarks and the time bound let Spark drop rows that can no longer meet another.
    """
    a = h.withWatermark("ts", delay).select("seg", F.col("ts").alias("ts_h"), F.col("sigma").alias("sigma_h"))
    b = low.withWatermark("ts", delay).select(F.col("seg").alias("seg_l"), F.col("ts").alias("ts_l"), F.col("sigma").alias("sigma_l"))
    span = F.expr(f"interval {within}")
    met = a.join(b, (F.col("seg") == F.col("seg_l")) & (F.col("ts_l") >= F.col("ts_h") - span) & (F.col("ts_l") <= F.col("ts_h") + span))
    return met.select("seg", "ts_h", "ts_l", net(F.col("sigma_h"), F.col("sigma_l")).alias("net"))


def sliding(samples: DataFrame, width: str = "4 seconds", step: str = "1 second", delay: str = "30 seconds") -> DataFrame:
    """seg, start, n, mean: sliding windows over an unbounded stream of samples (seg, ts, value)."""
    out = samples.withWatermark("ts", delay).groupBy("seg", F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return out.select("seg", F.col("w.start").alias("start"), "n", "mean")
