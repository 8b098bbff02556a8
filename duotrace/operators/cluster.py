"""Clusters of triggers and families of background windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duotrace.config import SearchConfig


def cluster_triggers(rows: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """The loudest row of each run of rows whose indexes are at most cluster_gap apart; the first on ties.

    One shuffle by segment. The running sum of gaps numbers the runs, and the second window reuses the partitioning.
    """
    order = Window.partitionBy("seg").orderBy("idx")
    gap = F.when(F.col("idx") - F.lag("idx").over(order) > config.cluster_gap, 1).otherwise(0)
    runs = rows.withColumn("gap", gap).withColumn("cluster", F.sum("gap").over(order)).drop("gap")
    best = Window.partitionBy("seg", "cluster").orderBy(F.desc("net"), "idx")
    return runs.withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place")


def family_bin(gps: Column, config: SearchConfig = SearchConfig()) -> Column:
    """The family of a second-stream window: its time in steps of family_s, rounded down."""
    return F.floor(gps / config.family_s)


def family_max(slide: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """fold, bi, l1bin and the row of greatest net at or above the floor; ties go to the least (ai, ih, il).

    A max over a struct, so mappers combine before the shuffle.
    """
    loud = slide.filter(F.col("net") >= config.net_floor).withColumn("l1bin", family_bin(F.col("gps_l"), config))
    best = F.max(F.struct("net", *((-F.col(c)).alias(c) for c in ("ai", "ih", "il"))))
    out = loud.groupBy("fold", "bi", "l1bin").agg(best.alias("b"))
    return out.select("fold", "bi", "l1bin", F.col("b.net").alias("net"), *((-F.col(f"b.{c}")).alias(c) for c in ("ai", "ih", "il")))
