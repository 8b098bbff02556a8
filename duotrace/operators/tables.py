"""Set operations, ordinal and catalogue joins, samples and event tables: the bookkeeping around a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal_pairs(rows: DataFrame, keys: list[str], order: list[str], det: str = "det") -> DataFrame:
    """keys, k, h, l: the k-th row of the first stream with the k-th of the second, each a struct; the longer side's rest has no partner."""
    rank = F.row_number().over(Window.partitionBy(*keys, det).orderBy(*order)) - 1
    ranked = rows.withColumn("k", rank)
    side = lambda name, as_: ranked.filter(F.col(det) == name).select(*keys, "k", F.struct(*(c for c in rows.columns if c not in keys)).alias(as_))
    return side("H1", "h").join(side("L1", "l"), [*keys, "k"])


def required(rows: DataFrame, table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with `value` of the table's row of equal keys; the job fails if a row has none."""
    out = rows.join(table.select(*keys, value), keys, "left")
    missing = F.assert_true(F.col(value).isNotNull(), F.concat(F.lit(f"no {value} for "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))))
    return out.filter(missing.isNull())


def oversampled(rows: DataFrame, branch: Column, times: int) -> DataFrame:
    """rows, those of the branch `times` times over."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(branch, times - 1).otherwise(0))))


def first_of(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One row a key: that of the least position, as a list without repeats keeps it. A min over a struct, so mappers combine."""
    rest = [c for c in rows.columns if c not in (key, position)]
    return rows.groupBy(key).agg(F.min(F.struct(position, *rest)).alias("m")).select(key, f"m.{position}", *(f"m.{c}" for c in rest))


def evenly(rows: DataFrame, keys: list[str], order: list[str], count: int) -> DataFrame:
    """`count` rows of each key at evenly spaced places of their order, ends included; all of them if there are no more."""
    w = Window.partitionBy(*keys)
    ranked = rows.withColumn("_at", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    step = (F.col("_n") - 1) / (count - 1)
    # A place is chosen if some whole number of steps, rounded down, is that place.
    nearest = F.ceil(F.col("_at") / step)
    chosen = (F.col("_n") <= count) | ((F.floor(nearest * step) == F.col("_at")) & (nearest <= count - 1))
    return ranked.filter(chosen).drop("_at", "_n")


def tail_and_bulk(rows: DataFrame, score: str, tail: int, bulk: int, mark: Column, ties: list[str]) -> DataFrame:
    """rows of the `tail` highest scores (weight 1) and `bulk` of the others, those of least mark, weighted to stand for them all.

    Both picks are top-k, which Spark takes by partition first.
    """
    top = rows.orderBy(F.desc(score), *ties).limit(tail)
    rest = rows.join(top.select(*ties), ties, "left_anti")
    few = rest.orderBy(mark, *ties).limit(bulk)
    total = rest.agg(F.count("*").alias("_n"))
    share = few.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")  # one row
    return top.withColumn("weight", F.lit(1.0)).unionByName(share.withColumn("weight", F.col("_n") / F.least(F.lit(bulk), F.col("_n"))).drop("_one", "_n"))


def k_sigma(rows: DataFrame, keys: list[str], value: str, ks: tuple[int, ...] = (3, 5)) -> DataFrame:
    """keys, n, mean, sd, thresholds t3, t5, .. at k standard deviations above the mean."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))
    return out.withColumns({f"t{k}": F.col("mean") + k * F.col("sd") for k in ks})


def event_windows(win: DataFrame, events: DataFrame, reach_s: float) -> DataFrame:
    """name, det, best_idx, best_sigma, centre_idx, centre_sigma: each event's loudest window within reach_s and its nearest one, by stream; the earlier on ties."""
    near = win.join(F.broadcast(events), "seg").withColumn("away", F.abs(F.col("gps") - F.col("event_gps"))).filter(F.col("away") <= reach_s)
    best = F.max(F.struct("sigma", (-F.col("idx")).alias("first"))).alias("best")
    centre = F.min(F.struct("away", "idx", "sigma")).alias("centre")
    out = near.groupBy("name", "det").agg(best, centre)
    return out.select("name", "det", (-F.col("best.first")).alias("best_idx"), F.col("best.sigma").alias("best_sigma"), F.col("centre.idx").alias("centre_idx"), F.col("centre.sigma").alias("centre_sigma"))


def aligned_best(win: DataFrame, events: DataFrame, reach_s: float) -> DataFrame:
    """name, idx, total: the offset at which both streams' scores together are greatest, each event's alone; the earlier on ties."""
    near = win.join(F.broadcast(events), "seg").filter(F.abs(F.col("gps") - F.col("event_gps")) <= reach_s)
    both = near.groupBy("name", "idx").agg(F.sum("sigma").alias("total"), F.count_distinct("det").alias("dets")).filter("dets = 2")
    best = both.groupBy("name").agg(F.max(F.struct("total", (-F.col("idx")).alias("first"))).alias("m"))
    return best.select("name", (-F.col("m.first")).alias("idx"), F.col("m.total").alias("total"))


def trapezoid(rows: DataFrame, keys: list[str], x: str, y: str, out: str) -> DataFrame:
    """rows with the integral of y over x up to each row, by trapezoids; 0 at a key's first row."""
    order = Window.partitionBy(*keys).orderBy(x)
    area = (F.col(y) + F.lag(y).over(order)) / 2 * (F.col(x) - F.lag(x).over(order))
    return rows.withColumn("_area", F.coalesce(area, F.lit(0.0))).withColumn(out, F.sum("_area").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_area")


def frames(samples: DataFrame, keys: list[str], at: str, values: list[str], length: int, step: int) -> DataFrame:
    """keys, w, n and sums of `values`: sliding windows of `length` samples every `step`, only whole ones.

    A sample goes to the windows that hold it (length / step of them), so windows are an aggregation, not a copy of samples;
    `at` counts samples from 0 and windows with a gap are left out.
    """
    first = F.greatest(F.lit(0), F.ceil((F.col(at) - length + 1) / step)).cast("long")
    held = samples.withColumn("w", F.explode(F.sequence(first, F.floor(F.col(at) / step).cast("long"))))
    out = held.groupBy(*keys, "w").agg(F.count("*").alias("n"), *(F.sum(v).alias(v) for v in values))
    return out.filter(F.col("n") == length)


def clean_frames(samples: DataFrame, keys: list[str], at: str, masks: dict[str, int], length: int, step: int, finite: tuple[str, ...] = ()) -> DataFrame:
    """keys, w: whole windows all of whose samples have every bit of each mask and a finite number in each column of `finite` (null, NaN and infinities aren't)."""
    good = [F.when(F.col(c).bitwiseAND(F.lit(m)) == m, 1).otherwise(0).alias(f"_{c}") for c, m in masks.items()]
    good += [F.when(F.abs(F.col(c)) < float("inf"), 1).otherwise(0).alias(f"_{c}") for c in finite]  # NaN is larger than all numbers
    masks = [*masks, *finite]
    out = frames(samples.select(*keys, at, *good), keys, at, [f"_{c}" for c in masks], length, step)
    return out.filter(" and ".join(f"_{c} = n" for c in masks)).select(*keys, "w")
