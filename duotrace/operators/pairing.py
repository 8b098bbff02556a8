"""Which windows of two streams meet: at zero lag, and at artificial offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duotrace.config import SearchConfig
from duotrace.functions.expr import net
from duotrace.sources.tables import written

#: Offsets of a pair of segments that are sorted at once, and what makes them positive.
CHUNK, OFFSET_ZERO = 65_536, 1 << 41
#: Windows of a block in which streams travel to their pairings: at least, and at most; between them a stream of any length is this many blocks.
BLOCK, LARGEST_BLOCK, BLOCKS = 16_384, 1 << 20, 8
#: Places of a block that are read off at one offset at once; windows of which a task makes blocks; bytes of blocks dealt to a task (it sorts them, so more spill).
STRETCH, TASK_WINDOWS, TASK_BYTES = 65_536, 1 << 17, 64 << 20
H_COLUMNS, L_COLUMNS = (tuple(f"{c}_{s}" for c in ("gps", "sigma", "centroid", "g")) for s in "hl")


def stream(win: DataFrame, det: str, suffix: str) -> DataFrame:
    """One stream's columns, renamed for a join."""
    return win.filter(F.col("det") == det).select("seg", "fold", F.col("idx").alias(f"i{suffix}"), *(F.col(c).alias(f"{c}_{suffix}") for c in ("gps", "sigma", "centroid", "g")))


def zero_lag(win: DataFrame) -> DataFrame:
    """Windows of equal segment and index in both streams: one shuffle by (seg, idx), and the shorter stream ends it."""
    h = stream(win, "H1", "h").withColumnRenamed("ih", "idx")
    low = stream(win, "L1", "l").withColumnRenamed("il", "idx").drop("fold")
    return h.join(low, ["seg", "idx"]).withColumn("net", net(F.col("sigma_h"), F.col("sigma_l")))


def pairings(segs: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """ai, bi, off, fold: offsets of one segment's windows against another's of the same fold.

    Offsets come in steps, out to one step less than the shorter segment; of a segment with itself only distant ones. At most max_offsets are kept for a pair, chosen by
    an arithmetic hash, so a rerun or another engine keeps the same ones.

    A pair's offsets are numbered and dealt out in stretches of CHUNK; each stretch is one array, sorted, of which max_offsets are kept, so no task holds more than a
    stretch before few offsets are left, however long segments are.
    """
    a, b = (segs.select("fold", F.col("seg").alias(x), F.col("n").alias(n)) for x, n in (("ai", "na"), ("bi", "nb")))
    step, least = config.offset_step, config.min_self_offset
    same = F.col("ai") == F.col("bi")
    reach = F.least("na", "nb") - step
    own = F.floor((F.col("na") - step - least) / step) + 1  # of a segment with itself, to either side
    pair = a.join(b, "fold").select("ai", "bi", "fold", same.alias("same"), reach.alias("reach"), own.alias("own"), F.when(same, 2 * own).otherwise(F.floor(2 * reach / step) + 1).cast("long").alias("count"))
    pair = pair.filter("reach >= 0 and count > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(CHUNK).cast("long"))))

    def packed(k: Column) -> Column:
        """An offset's hash, and below it the offset: one number, that sorts like both."""
        to_side = F.when(k < F.col("own"), least + step * k).otherwise(-(least + step * (k - F.col("own"))))
        off = F.when(F.col("same"), to_side).otherwise(step * k - F.col("reach")).cast("long")
        return F.shiftleft(((off + 1000000) * 7919 + F.col("ai") * 104729 + F.col("bi") * 1299709) % 1000003, 42) + off + F.lit(OFFSET_ZERO)

    each = F.transform(F.sequence(F.col("first"), F.least(F.col("first") + CHUNK, F.col("count")) - 1), packed)
    few = pair.select("ai", "bi", "fold", F.explode(F.slice(F.sort_array(each), 1, config.max_offsets)).alias("packed"))
    rank = F.row_number().over(Window.partitionBy("ai", "bi").orderBy("packed"))
    few = few.withColumn("rank", rank).filter(F.col("rank") <= config.max_offsets)
    return few.select("ai", "bi", "fold", (F.col("packed").bitwiseAND(F.lit(2 * OFFSET_ZERO - 1)) - F.lit(OFFSET_ZERO)).alias("off"))


def blocks(win: DataFrame, det: str, suffix: str, size: int, parts: int) -> DataFrame:
    """seg, fold, layer, block, first and arrays of one stream's columns: runs of `size` windows, each in the place of its index from `first` on.

    A place without a window holds nulls. Windows of one index that occurs more than once stand in further layers. The indexes' array is null where
    no place is empty, as `first` then tells them all; `count` is the number of places.
    """
    names = [f"{c}_{suffix}" for c in ("gps", "sigma", "centroid", "g")]
    at = f"i{suffix}"
    rows = stream(win, det, suffix).withColumn("block", F.floor(F.col(at) / size)).repartition(parts, "seg", "block")
    rows = rows.withColumn("layer", F.row_number().over(Window.partitionBy("seg", "block", at).orderBy(*names)))
    held = rows.groupBy("seg", "block", "layer").agg(F.first("fold").alias("fold"), F.sort_array(F.collect_list(F.struct(at, *names))).alias("w"))
    after = lambda k: F.coalesce(F.get(F.col("w"), k + 1)[at] - F.get(F.col("w"), k)[at] - 1, F.lit(0)).cast("int")
    gaps = F.exists(F.sequence(F.lit(0), F.size("w") - 1), lambda k: after(k) > 0)
    filled = F.flatten(F.transform("w", lambda x, k: F.concat(F.array(x), F.array_repeat(F.when(F.lit(False), x), after(k)))))
    held = held.withColumn("first", F.get(F.col("w"), F.lit(0))[at]).withColumn("gaps", gaps).withColumn("w", F.when(F.col("gaps"), filled).otherwise(F.col("w")))
    return held.select("seg", "fold", "block", F.col("first").alias(f"first_{suffix}"), F.size("w").alias(f"count_{suffix}"), F.when(F.col("gaps"), F.col("w")[at]).alias(at), *(F.col("w")[c].alias(c) for c in names))


def both_blocks(win: DataFrame, size: int, parts: int) -> list[DataFrame]:
    """The blocks of the first and of the second stream, written once: a search passes over its slid pairs several times."""
    rows = (blocks(win, det, "x", size, parts).withColumn("det", F.lit(det)) for det in ("H1", "L1"))
    both = written(next(rows).unionByName(next(rows)))
    named = lambda s: {c: c.removesuffix("x") + s for c in both.columns if c.endswith("x")}
    return [both.filter(F.col("det") == det).drop("det", "fold").withColumnsRenamed(named(s)) for det, s in (("H1", "h"), ("L1", "l"))]


def block_size(segs: DataFrame) -> int:
    """Windows of a block: BLOCKS a stream, so that a stream's copies, and with them what is shuffled, don't grow with its length."""
    longest = segs.agg(F.max("n")).first()[0] or 0  # one number
    return min(LARGEST_BLOCK, max(BLOCK, -(-longest // BLOCKS)))


def task_parts(segs: DataFrame, size: int) -> tuple[int, int]:
    """Tasks that make a stream's blocks, and tasks that its copies are dealt to, if all blocks of a fold meet: as many as the windows need, at least the session's shuffle
    partitions. Given, as blocks are few bytes and much work: they must not be merged into few tasks by size."""
    per = segs.groupBy("fold").agg(F.sum("n").alias("n"), F.sum(F.ceil(F.col("n") / size)).alias("b"))
    windows, met = (x or 0 for x in per.agg(F.sum("n"), F.sum(F.col("b") * F.col("b"))).first())  # two numbers
    least = int(segs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-windows // TASK_WINDOWS)), max(least, -(-met * size * 8 * len(H_COLUMNS) // TASK_BYTES))


def time_slide(win: DataFrame, pairs: DataFrame, segs: DataFrame, without: DataFrame | None = None, size: int | None = None) -> DataFrame:
    """Every pair of windows that an offset brings together: il = ih + off; none of the windows (seg, idx) of `without`, a short list.

    Windows travel as blocks, arrays of `size` windows. A pairing brings a block of the first stream to two of the second at
    most, and all offsets of a pair of segments that bring the same two blocks together share one copy: an equi-join of
    blocks by (segments, block), of which only those that the second stream has are made. Pairs of windows are then read off
    both arrays by place, so they are never shuffled or sorted. `size` is block_size unless given.

    Generated code holds all that it makes of one row before the next step sees any of it. So what is read off is a small row
    of its own, an offset and a stretch of STRETCH places of two blocks, which is merged with the first stream's block and
    looks up the second's: however long blocks and lists of offsets are, no more than a stretch's pairs are held.
    """
    size = size or block_size(segs)
    kept = win.join(segs.select("seg", "n"), "seg").filter(F.col("idx") < F.col("n")).drop("n")
    if without is not None:
        kept = kept.join(F.broadcast(without.select("seg", "idx")), ["seg", "idx"], "left_anti")
    makers, parts = task_parts(segs, size)
    h, low = both_blocks(kept, size, makers)
    h, low = h.withColumnsRenamed({"seg": "ai", "block": "hb"}), low.withColumnsRenamed({"seg": "bi", "block": "lb"})
    to = F.explode(F.array_distinct(F.array(F.floor(F.col("off") / size), F.floor((F.col("off") + size - 1) / size)))).alias("by")
    met = pairs.select("ai", "bi", "fold", "off", to).groupBy("ai", "bi", "fold", "by").agg(F.collect_list("off").alias("offs"))
    last = F.floor((F.col("n") - 1) / size)
    for s, name in (("ai", "last_h"), ("bi", "last_l")):
        met = met.join(F.broadcast(segs.select(F.col("seg").alias(s), last.alias(name))), s)  # a row a segment
    first, end = F.greatest(F.lit(0), -F.col("by")), F.least(F.col("last_h"), F.col("last_l") - F.col("by"))
    met = met.filter(first <= end).withColumn("hb", F.explode(F.sequence(first, end))).withColumn("lb", F.col("hb") + F.col("by"))
    tile = ["ai", "bi", "fold", "lb"]  # with the fold, so that a pass over one fold sends only its blocks
    asked = met.select(*tile, "hb", F.explode("offs").alias("off")).withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(size - 1), F.lit(STRETCH)))).repartition(parts, *tile)
    h = met.select(*tile, "hb").hint("merge").join(h, ["ai", "hb"]).withColumnRenamed("hb", "of").repartition(parts, *tile)  # merged as well, so that a block's copies are made one by one
    low = met.select(*tile).distinct().hint("merge").join(low, ["bi", "lb"]).repartition(parts, *tile)
    # Both joins have the tile's keys alone, as the blocks are dealt: with the block among the keys, Spark would deal out what the first join makes, rows with blocks, anew.
    tiles = asked.hint("merge").join(h, tile).filter(F.col("hb") - F.col("of") == 0).join(low.hint("shuffle_hash"), tile)  # the second stream's blocks, one or few a tile, are hashed
    tiles = tiles.withColumn("shift", F.col("first_h") + F.col("off") - F.col("first_l"))  # from a place in one array to that in the other
    start, stop = F.greatest(F.col("at"), -F.col("shift")), F.least(F.col("at") + STRETCH, F.col("count_h"), F.col("count_l") - F.col("shift"))
    rows = tiles.filter(start < stop).withColumn("at", F.explode(F.sequence(start.cast("int"), (stop - 1).cast("int"))))
    other = (F.col("at") + F.col("shift")).cast("int")
    index = lambda s, at: F.when(F.col(f"i{s}").isNull(), F.col(f"first_{s}") + at).otherwise(F.get(F.col(f"i{s}"), at)).alias(f"i{s}")
    at_h, at_l = ([index(s, at), *(F.get(F.col(c), at).alias(c) for c in names)] for s, at, names in (("h", F.col("at"), H_COLUMNS), ("l", other, L_COLUMNS)))
    rows = rows.select("ai", "bi", "fold", "lb", "off", *at_h, *at_l)  # all rows of one lb and pair of segments are made in one task
    return rows.filter("ih is not null and il is not null").withColumn("net", net(F.col("sigma_h"), F.col("sigma_l")))


def split_families(win: DataFrame, segs: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """bi, l1bin: the second stream's families whose windows lie in two blocks, one or two a block: their pairs are made in two tasks."""
    block = F.floor(F.col("idx") / block_size(segs))
    low = win.filter(F.col("det") == "L1").groupBy(F.col("seg").alias("bi"), F.floor(F.col("gps") / config.family_s).alias("l1bin"))
    return low.agg(F.min(block).alias("low"), F.max(block).alias("high")).filter("low < high").select("bi", "l1bin")


def coherence_stub(ih: Column, il: Column, ai: Column, bi: Column) -> Column:
    """A deterministic stand-in for measured coherence, in [0, 0.6)."""
    return ((ih * 31 + il * 17 + ai * 7 + bi * 3) % 1000) / 1000.0 * 0.6


def arm_stubs(ai: Column, ih: Column, bi: Column, il: Column) -> tuple[Column, Column]:
    """Deterministic stand-ins for the two specialists' scores, in [0, 1)."""
    return ((ai * 13 + ih * 29 + bi * 5 + il * 23) % 1000) / 1000.0, ((ai * 17 + ih * 11 + bi * 3 + il * 41) % 1000) / 1000.0


def known_events(spark, config: SearchConfig = SearchConfig()) -> DataFrame:
    return spark.createDataFrame([(n, s, float(t)) for n, s, t in config.known_events], "name string, seg long, event_gps double")


def nearest_window(win: DataFrame, events: DataFrame) -> DataFrame:
    """name, seg, idx: each event's nearest window of its segment, the earlier on ties."""
    h = win.filter(F.col("det") == "H1").join(F.broadcast(events), "seg")
    best = F.min(F.struct(F.abs(F.col("gps") - F.col("event_gps")).alias("away"), F.col("idx").alias("idx")))
    return h.groupBy("name", "seg").agg(best.alias("best")).select("name", "seg", F.col("best.idx").alias("idx"))


def around(near: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """seg, idx: the windows within a few of a known event, a few rows an event."""
    return near.select("seg", F.explode(F.sequence(F.col("idx") - config.excision_windows, F.col("idx") + config.excision_windows)).alias("idx")).distinct()


def excise(slide: DataFrame, near: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """slide without rows within a few windows of a known event in either stream.

    The events' windows are listed out and joined by equality; the list is a few rows an event, so it is broadcast and slid rows stay where they are.
    """
    bad = around(near, config)
    h, low = (F.broadcast(bad.select(F.col("seg").alias(s), F.col("idx").alias(i))) for s, i in (("ai", "ih"), ("bi", "il")))
    return slide.join(h, ["ai", "ih"], "left_anti").join(low, ["bi", "il"], "left_anti")
