"""Sets of intervals by segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def subtract(locks: DataFrame, vetoes: DataFrame) -> DataFrame:
    """(seg, start, end): the maximal parts of `locks` that no veto covers. Both have seg, start, end and may overlap; empty ones don't count.

    A sweep: each interval is two steps, running counts by segment tell where a lock and no veto holds, and runs of such
    pieces are joined.
    """

    def steps(df, lock, veto):
        df = df.filter("start < end")
        on = df.select("seg", F.col("start").alias("at"), F.lit(lock).alias("lock"), F.lit(veto).alias("veto"))
        return on.unionByName(df.select("seg", F.col("end").alias("at"), F.lit(-lock).alias("lock"), F.lit(-veto).alias("veto")))

    sweep = Window.partitionBy("seg").orderBy("at")
    moves = steps(locks, 1, 0).unionByName(steps(vetoes, 0, 1)).groupBy("seg", "at").agg(F.sum("lock").alias("lock"), F.sum("veto").alias("veto"))
    state = moves.select("seg", "at", ((F.sum("lock").over(sweep) > 0) & (F.sum("veto").over(sweep) == 0)).alias("good"))
    turns = state.withColumn("was", F.coalesce(F.lag("good").over(sweep), F.lit(False))).filter("good <> was")
    return turns.withColumn("end", F.lead("at").over(sweep)).filter("good").select("seg", F.col("at").alias("start"), "end")
