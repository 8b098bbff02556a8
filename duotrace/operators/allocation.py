"""Places in a stated order, and what is dealt out by them: strata with quotas, leftovers and fills, splits by fractions.

No window sees more than one bucket of marks. Marks are whole numbers in [0, MARKS), spread evenly (an arithmetic hash);
keys x BUCKETS counts are all that meets outside the buckets, so a key that holds most rows is worked on by BUCKETS tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks lie below this number.
MARKS = 1_000_003
#: Buckets of marks: rows of one key are numbered in this many windows.
BUCKETS = 512


def mark(row_id: Column, salt: int) -> Column:
    """An arithmetic hash of a whole number, the same in any engine."""
    return F.pmod(row_id * salt + 1, F.lit(MARKS))


def numbered(rows: DataFrame, keys: list[str], mark: str, row_id: str, out: str, quota: str | None = None) -> DataFrame:
    """rows with `out`, their number from 0 among those of their keys by (mark, row_id).

    With quota (a column that is the same in all rows of a key), only rows whose number is below it are kept, and rows of
    buckets that begin beyond it are dropped before anything is sorted. row_id must tell rows apart; repeated ones are
    numbered in any order. An empty table gives no rows.
    """
    width = -(-MARKS // BUCKETS)
    keys = list(keys)
    dealt = rows.withColumn("_bucket", F.floor(F.col(mark) / width))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    starts = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    met = dealt.join(starts, same)
    if quota:
        met = met.filter(F.col("_start") < F.col(quota))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(mark, row_id)
    met = met.withColumn(out, F.col("_start") + F.row_number().over(inside) - 1)
    if quota:
        met = met.filter(F.col(out) < F.col(quota))
    return met.select(*rows.columns, out)


def stratified(rows: DataFrame, cell: str, cells: int, row_id: str, count: int, salts: tuple[int, int, int] = (7919, 104729, 15485863)) -> DataFrame:
    """row_id, how, times: `count` rows spread over the cells 0 to cells - 1 as evenly as they allow.

    Each cell gives count / cells rows, the first count % cells of them one more ('cell'); what cells lack is taken from the
    rows left in other cells ('left'); if those run out too, rows of the whole table, in a cell or not, are drawn with
    replacement ('fill', `times` often). Rows whose cell is null are in none. An empty table raises an error if anything is to be
    drawn.
    """
    target = F.lit(count // cells) + F.when(F.col(cell) < count % cells, 1).otherwise(0)
    inside = rows.filter(F.col(cell).between(0, cells - 1)).select(row_id, cell).withColumn("_take", target).withColumn("_mark", mark(F.col(row_id), salts[0]))
    taken = numbered(inside, [cell], "_mark", row_id, "_place", "_take").select(row_id, F.lit("cell").alias("how"), F.lit(1).cast("long").alias("times"))
    # How many each cell lacks is known from its count: cells rows, whatever the table's size.
    held = inside.groupBy(cell).agg(F.count("*").alias("n"), F.least(F.count("*"), F.max("_take")).alias("got"))
    n_inside, got = held.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("got"), F.lit(0))).first()
    parts, need = [taken], count - got
    left = min(need, n_inside - got)
    if left:
        rest = inside.join(taken.select(row_id), row_id, "left_anti").select(row_id).withColumns({"_mark": mark(F.col(row_id), salts[1]), "_take": F.lit(left)})
        parts.append(numbered(rest, [], "_mark", row_id, "_place", "_take").select(row_id, F.lit("left").alias("how"), F.lit(1).cast("long").alias("times")))
    if need > left:
        total = rows.count()
        if not total:
            raise ValueError("no rows to draw from")
        every = numbered(rows.select(row_id).withColumn("_mark", mark(F.col(row_id), salts[0])), [], "_mark", row_id, "_place")
        draws = rows.sparkSession.range(need - left).select(F.floor(mark(F.col("id"), salts[2]) * F.lit(total) / F.lit(MARKS)).alias("_place"))
        parts.append(every.join(draws.groupBy("_place").agg(F.count("*").alias("times")), "_place").select(row_id, F.lit("fill").alias("how"), "times"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def split(rows: DataFrame, row_id: str, val: float, test: float, salt: int = 7919) -> DataFrame:
    """rows with `split`: in the order of a hash, the first share is test, the next val, the rest train.

    Both shares are rounded down but hold at least one row; if they leave nothing to train on, an error is raised.
    """
    n = rows.count()
    n_test, n_val = max(1, int(n * test)), max(1, int(n * val))
    if n_test + n_val >= n:
        raise ValueError(f"{n} rows leave none to train on")
    placed = numbered(rows.withColumn("_mark", mark(F.col(row_id), salt)), [], "_mark", row_id, "_place")
    part = F.when(F.col("_place") < n_test, "test").when(F.col("_place") < n_test + n_val, "val").otherwise("train")
    return placed.select(*rows.columns, part.alias("split"))


def union_right_wins(left: Column, right: Column) -> Column:
    """A map of both maps' entries; of keys in both, the right one's value."""
    own = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(own, right)
