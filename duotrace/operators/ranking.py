"""Ranks and running totals over a whole table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, value: str, width: float, **amounts: Column) -> DataFrame:
    """A row for each distinct value, with sums of `amounts` at it (name) and above it (name_above).

    Values are counted with map-side combine, then dealt to buckets of `width`. Only the buckets' sums, a row each, meet in one
    window; inside a bucket a window of its own runs. So buckets bound what a task sorts.
    """
    per = df.groupBy(value).agg(*(F.sum(c).alias(n) for n, c in amounts.items())).withColumn("_bucket", F.floor(F.col(value) / width))
    sums = per.groupBy("_bucket").agg(*(F.sum(n).alias(f"_{n}") for n in amounts))
    above = Window.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_bucket").alias("_b"), *(F.coalesce(F.sum(f"_{n}").over(above), F.lit(0)).alias(f"_{n}") for n in amounts))
    inside = Window.partitionBy("_bucket").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    out = per.join(offsets, per["_bucket"] == offsets["_b"])
    return out.select(value, *amounts, *((F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(f"_{n}")).alias(f"{n}_above") for n in amounts))


def auc(df: DataFrame, score: str, positive: Column, width: float) -> DataFrame:
    """One row: n_pos, n_neg and the share of (positive, negative) pairs in the right order, ties for half. Null where a class is missing."""
    one = lambda c: F.when(c, 1).otherwise(0)
    steps = running_total(df, score, width, pos=one(positive), neg=one(~positive))
    total = steps.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("neg") * (F.col("pos_above") + F.col("pos") / 2.0)).alias("good"))
    return total.select("n_pos", "n_neg", F.when(F.col("n_pos") * F.col("n_neg") > 0, F.col("good") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))
