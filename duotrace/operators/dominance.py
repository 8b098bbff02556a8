"""How many groups hold a point that is beyond another in two scores at once, without meeting all points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def staircase(points: DataFrame, keys: list[str]) -> DataFrame:
    """A key's points (x, y) that no other of the key equals or exceeds in both: as x falls, y rises. One row for equal points."""
    order = Window.partitionBy(*keys).orderBy(F.desc("x"), F.desc("y"))
    before = F.max("y").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return points.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("y") > F.col("_before"))).drop("_before")


def corners(stairs: DataFrame, keys: list[str], sign: int) -> DataFrame:
    """keys, x, y, n: signed points whose sum beyond any place is `sign` if a point of the key's staircase lies there, and else 0.

    The region that a staircase covers is its outer corners' quadrants less those of its inner corners, where two neighbours overlap.
    """
    after = F.lead("x").over(Window.partitionBy(*keys).orderBy(F.desc("x")))
    both = stairs.select(*keys, "x", "y", after.alias("_next"))
    outer = both.select(*keys, "x", "y", F.lit(sign).alias("n"))
    return outer.unionByName(both.filter("_next is not null").select(*keys, F.col("_next").alias("x"), "y", F.lit(-sign).alias("n")))


def beyond(asked: DataFrame, points: DataFrame, keys: list[str], ident: list[str], inclusive: bool, width: float, height: float) -> DataFrame:
    """ident, n: the sum of n of the points of equal keys with a larger x (or as large, if inclusive) and a y at least as large.

    Points are summed by cell of width x height. A place takes whole cells beyond its own by their sums, of which there are
    as many as the plane has, not as points; only its own column and row of cells are looked into point by point.
    """
    points = points.groupBy(*keys, "x", "y").agg(F.sum("n").alias("n")).filter("n <> 0")
    cell = {"xb": F.floor(F.col("x") / width), "yb": F.floor(F.col("y") / height)}
    points = points.withColumns(cell)
    asked = asked.select(*ident, *keys, F.col("x").alias("tx"), F.col("y").alias("ty"), *(F.floor(F.col(c) / s).alias(f"t{c}b") for c, s in (("x", width), ("y", height))))
    right = F.col("x") >= F.col("tx") if inclusive else F.col("x") > F.col("tx")
    cells = points.groupBy(*keys, "xb", "yb").agg(F.sum("n").alias("n"))
    whole = asked.join(cells, keys).filter((F.col("xb") > F.col("txb")) & (F.col("yb") > F.col("tyb")))
    column = asked.withColumn("xb", F.col("txb")).join(points, [*keys, "xb"]).filter(right & (F.col("y") >= F.col("ty")))
    row = asked.withColumn("yb", F.col("tyb")).join(points, [*keys, "yb"]).filter((F.col("xb") > F.col("txb")) & (F.col("y") >= F.col("ty")))
    met = whole.select(*ident, "n").unionByName(column.select(*ident, "n")).unionByName(row.select(*ident, "n"))
    return met.groupBy(*ident).agg(F.sum("n").alias("n"))
