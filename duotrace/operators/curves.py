"""Values between the points of a curve that is a table of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def brackets(curve: DataFrame, x: str, y: str, bucket: float) -> DataFrame:
    """x0, y0, x1, y1: neighbouring points of the curve, which need not be sorted; of points of equal x the least y counts.

    A point's neighbour is found in its own bucket; a bucket's last point takes the first of the next bucket that has any,
    which only the buckets' first points, a row each, decide.
    """
    points = curve.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).cast("double").alias("x0")).agg(F.min(F.col(y).cast("double")).alias("y0"))
    points = points.withColumn("_b", F.floor(F.col("x0") / bucket))
    firsts = points.groupBy("_b").agg(F.min(F.struct("x0", "y0")).alias("_first"))
    firsts = firsts.select("_b", F.lead("_first").over(Window.orderBy("_b")).alias("_ahead"))  # a row a bucket
    own = Window.partitionBy("_b").orderBy("x0")
    out = points.withColumn("_next", F.lead(F.struct("x0", "y0")).over(own)).join(firsts, "_b").withColumn("_next", F.coalesce("_next", "_ahead"))
    return out.filter("_next is not null").select("x0", "y0", F.col("_next.x0").alias("x1"), F.col("_next.y0").alias("y1"))


def interpolated(rows: DataFrame, curve: DataFrame, value: str, x: str, y: str, out: str, logarithmic: bool = False, cells: int = 1 << 20) -> DataFrame:
    """rows with `out`, the curve's value at `value` (linear between points, in the logarithm if asked, held at the ends), and the flags
    {out}_low and {out}_high where it is at or beyond the first or last point.

    An as-of join of two unsorted tables of any length. Steps of the curve are dealt to cells as wide as its points are apart
    in the mean, a step standing in every cell that it touches (twice as many as points in all). A row lies in one cell,
    so both meet in an equi-join that Spark broadcasts or splits by size. Of a curve of one point that value holds
    everywhere; an empty curve and a null value give null.
    """
    ends = curve.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).agg(F.min(F.struct(x, y)), F.max(F.col(x)), F.count("*")).first()
    if not ends[2]:
        return rows.withColumn(out, F.lit(None).cast("double")).withColumns({f"{out}_{n}": F.lit(None).cast("boolean") for n in ("low", "high")})
    low, high = float(ends[0][0]), float(ends[1])
    v = F.col(value)
    width = (high - low) / min(ends[2], cells) or 1.0
    steps = brackets(curve, x, y, 64 * width)
    cell = lambda c: F.floor((c - low) / width)
    dealt = steps.withColumn("_cell", F.explode(F.sequence(cell(F.col("x0")), cell(F.col("x1")))))
    last = curve.filter(F.col(x) == high).agg(F.min(F.col(y).cast("double"))).first()[0]
    inside = (v > low) & (v < high)
    keyed = rows.withColumn("_cell", F.when(inside, cell(v)))
    met = keyed.join(dealt, (keyed["_cell"] == dealt["_cell"]) & (F.col("x0") <= v) & (v < F.col("x1")), "left")
    scale, back = (F.log, F.exp) if logarithmic else (lambda c: c, lambda c: c)
    between = back(scale(F.col("y0")) + (v - F.col("x0")) * ((scale(F.col("y1")) - scale(F.col("y0"))) / (F.col("x1") - F.col("x0"))))
    at: Column = F.when(v <= low, float(ends[0][1])).when(v >= high, last).otherwise(between)
    return met.select(*rows.columns, at.alias(out), (v <= low).alias(f"{out}_low"), (v >= high).alias(f"{out}_high"))
