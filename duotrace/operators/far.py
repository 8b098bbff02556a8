"""False-alarm rates: how often the background is louder than a trigger."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duotrace.config import YEAR_S, SearchConfig
from duotrace.functions.expr import features, kept_by, linear, loglr
from duotrace.functions.stats import poisson_table, poisson_upper_large
from duotrace.operators import dominance
from duotrace.operators.pairing import arm_stubs, coherence_stub
from duotrace.sources.tables import written


def ratio(values, config: SearchConfig = SearchConfig()):
    """The log likelihood ratio by the fixed values, or by the model for the row's fold (`fold`), which the other fold's rows made."""
    if config.fold_models is None:
        return loglr(values, config)
    return F.when(F.col("fold") == 0, linear(values, *config.fold_models[0])).when(F.col("fold") == 1, linear(values, *config.fold_models[1]))


def with_scores(rows: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Adds coh, loglr, hm and lm. rows: ai, bi, ih, il and both streams' sigma, centroid and g."""
    c = F.col
    rows = rows.withColumn("coh", coherence_stub(c("ih"), c("il"), c("ai"), c("bi")))
    hm, lm = arm_stubs(c("ai"), c("ih"), c("bi"), c("il"))
    score = ratio(features(c("sigma_h"), c("sigma_l"), c("coh"), c("centroid_h"), c("centroid_l"), c("g_h"), c("g_l")), config)
    return rows.withColumn("loglr", score).withColumn("hm", hm).withColumn("lm", lm)


def as_pairs(trig: DataFrame) -> DataFrame:
    """Zero-lag rows under the names of pairs."""
    return trig.withColumn("ai", F.col("seg")).withColumn("bi", F.col("seg")).withColumn("ih", F.col("idx")).withColumn("il", F.col("idx"))


def bounded_prune(slide: DataFrame, config: SearchConfig = SearchConfig(), bound: bool = True) -> DataFrame:
    """Scored rows whose likelihood ratio exceeds the floor.

    The coherence slope isn't negative, so the ratio at the ceiling bounds it: rows that fail there are dropped before
    coherence is found for the rest. `bound` off gives the same rows, more slowly.

    The counts of the rows that come in and that pass the bound are observed. Those steps also end the generated code, of
    the slide and of the bound: together with the scores it would be one method of over 8000 bytes, which the JVM never
    compiles (ten times the seconds).
    """
    c = F.col
    counted = lambda rows, name: rows.observe(f"{name}_{uuid.uuid4().hex}", F.count("*").alias("rows"))
    slide = counted(slide, "slid")
    if bound:
        most = ratio(features(c("sigma_h"), c("sigma_l"), F.lit(config.coh_ceiling), c("centroid_h"), c("centroid_l"), c("g_h"), c("g_l")), config)
        slide = counted(slide.filter(most > config.lr_floor), "bounded")
    return with_scores(slide, config).filter(F.col("loglr") > config.lr_floor)


def tripwire(rows: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """rows, failing if any coherence lies at or above the ceiling that the bound relied on."""
    wrong = F.assert_true(F.col("coh") < config.coh_ceiling, F.lit("coherence above its ceiling"))
    return rows.filter(wrong.isNull())


def livetime(slide: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """fold, live_yr: half of all slid pairs' time, in years."""
    return slide.groupBy("fold").agg((F.count("*") * (config.stride_s * 0.5 / YEAR_S)).alias("live_yr"))


def count_louder(triggers: DataFrame, background: DataFrame, score: str, keys: list[str], out: str, inclusive: bool = False, width: float = 0.05) -> DataFrame:
    """triggers with the number of background rows of the same keys that are louder (or as loud, if inclusive).

    Not a join of all pairs: background is counted by distinct score, with map-side combine, and dealt to buckets of
    `width`. Only the buckets' sums meet in a window by key; inside a bucket a window of its own runs. Scores that
    triggers ask for stand between, ordered by a marker so that equal ones count only if inclusive, and counts are joined
    back to the triggers. A null score has a null count.
    """
    asked = triggers.select(*keys, F.col(score).alias("_x")).filter("_x is not null").distinct().withColumn("_one", F.lit(0).cast("long")).withColumn("_turn", F.lit(1 if inclusive else 0))
    stand = background.groupBy(*keys, F.col(score).alias("_x")).agg(F.count("*").alias("_one")).withColumn("_turn", F.lit(0 if inclusive else 1))
    both = asked.withColumn("_asked", F.lit(True)).unionByName(stand.withColumn("_asked", F.lit(False))).withColumn("_bucket", F.floor(F.col("_x") / width))
    higher = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    sums = both.groupBy(*keys, "_bucket").agg(F.sum("_one").alias("_n")).select(*keys, "_bucket", F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_above"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(F.desc("_x"), "_turn").rowsBetween(Window.unboundedPreceding, 0)
    counted = both.join(sums, [*keys, "_bucket"]).withColumn(out, F.sum("_one").over(inside) + F.col("_above")).filter("_asked")
    return triggers.join(counted.select(*keys, F.col("_x").alias(score), out), [*keys, score], "left")


def gated(rows: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Background rows that the absolute glitch cut keeps: an arm strictly above it."""
    return rows.filter(F.greatest("hm", "lm") > config.glitch_cut)


def louder_families(triggers: DataFrame, background: DataFrame, out: str = "n_louder") -> DataFrame:
    """triggers with the number of distinct second-stream families that hold a louder row of the same fold.

    background: fold, bi, l1bin, loglr. A family is louder when its loudest row is; so families are reduced to that first.
    """
    fam = background.groupBy("fold", "bi", "l1bin").agg(F.max("loglr").alias("loglr"))
    return count_louder(triggers, fam, "loglr", ["fold"], out)


#: The plane's cells in which per_arm sums families: of the ranking score, and of an arm's.
CELL, ARM_CELL = 0.25, 1 / 32


def per_arm(triggers: DataFrame, rows: DataFrame, score: str, inclusive: bool = False, hm: str = "n_hm", lm: str = "n_lm") -> DataFrame:
    """triggers with n_hm, n_lm: distinct families (bi, l1bin) of rows that are louder and whose arm scores as high as the trigger's.

    Rows of the trigger's own segment in either stream don't count. Each family is reduced to its staircase of (score, arm),
    and that to signed points, so that families are counted by sums of points beyond the trigger's place, and triggers never
    meet rows. A segment's own triggers get corrections: less the families of that second segment, and for families whose
    staircase the first segment has a part in, what they are without it instead of what they are.
    """
    family = ["arm", "fold", "bi", "l1bin"]
    arms = F.explode(F.array(*(F.struct(F.lit(n).alias("arm"), F.col(n).cast("double").alias("y")) for n in ("hm", "lm")))).alias("a")
    points = rows.filter(F.col(score).isNotNull()).select("fold", "ai", "bi", "l1bin", F.col(score).cast("double").alias("x"), arms).select("fold", "ai", "bi", "l1bin", "x", "a.*").filter("y is not null")
    own = written(dominance.staircase(points, [*family, "ai"]))
    stairs = written(dominance.staircase(own, family))
    held = stairs.filter("ai <> bi").select(*family, F.col("ai").alias("seg")).distinct()
    everywhere = dominance.corners(stairs, family, 1).withColumn("seg", F.lit(-1).cast("long"))
    second = dominance.corners(stairs, family, -1).withColumn("seg", F.col("bi").cast("long"))
    taken = dominance.corners(stairs.join(held, family), [*family, "seg"], -1)
    without = dominance.corners(dominance.staircase(own.join(held, family).filter("ai <> seg"), [*family, "seg"]), [*family, "seg"], 1)
    signed = written(reduce(DataFrame.unionByName, (df.select("arm", "fold", F.col("seg").cast("long").alias("part"), "x", "y", "n") for df in (everywhere, second, taken, without))))
    asked = triggers.filter(F.col(score).isNotNull()).select("seg", "idx", "fold", F.col(score).cast("double").alias("x"), arms)
    asked = asked.select("seg", "idx", "fold", "x", "a.*", F.explode(F.array(F.lit(-1).cast("long"), F.col("seg").cast("long"))).alias("part"))
    counted = dominance.beyond(asked, signed, ["arm", "fold", "part"], ["seg", "idx", "arm"], inclusive, CELL, ARM_CELL)
    counts = counted.groupBy("seg", "idx").agg(*(F.sum(F.when(F.col("arm") == a, F.col("n")).otherwise(0)).alias(n) for a, n in (("hm", hm), ("lm", lm))))
    return triggers.join(counts, ["seg", "idx"], "left").fillna(0, [hm, lm])


def known_matches(trig: DataFrame, near: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """trig with matches_known: the known event (name, seg, idx of `near`) within excision_windows, null if none."""
    around = F.explode(F.sequence(F.col("idx") - config.excision_windows, F.col("idx") + config.excision_windows))
    marks = near.select("seg", "name", around.alias("idx")).groupBy("seg", "idx").agg(F.max("name").alias("matches_known"))
    return trig.join(marks, ["seg", "idx"], "left")


def floor_of(trig: DataFrame, config: SearchConfig = SearchConfig()) -> float:
    """The floor of the likelihood ratio: lr_floor, or the quietest known event's if that is lower (not if blind_floor). One aggregate."""
    quiet = trig.filter("matches_known is not null").agg(F.min("loglr")).first()[0]
    return config.lr_floor if config.blind_floor or quiet is None else min(config.lr_floor, quiet)


def top_candidates(trig: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """The triggers that are looked into: the best by likelihood ratio at or above its floor, those loud enough for the net channel, and known events."""
    best = trig.filter(F.col("loglr") >= config.lr_floor).orderBy(F.desc("loglr"), "seg", "idx").limit(config.candidates)
    others = trig.filter((F.col("net") >= config.net_floor) | F.col("matches_known").isNotNull())
    return best.unionByName(others).dropDuplicates(["seg", "idx"])


def with_upper(rows: DataFrame, count: str, out: str) -> DataFrame:
    """rows with the 90 % upper limit of a Poisson mean of which `count` were seen: a table for small counts, an expansion above it."""
    table = poisson_table(rows.sparkSession, 400).select(F.col("n").alias(count), F.col("ul").alias(out))
    return rows.join(F.broadcast(table), count, "left").withColumn(out, F.when(F.col(count).isNotNull(), F.coalesce(out, poisson_upper_large(F.col(count)))))


def with_interval(rows: DataFrame, count: str) -> DataFrame:
    """rows with ul (90 %), low and high (the central 90 % interval) of a Poisson mean of which `count` were seen."""
    table = poisson_table(rows.sparkSession, 400).withColumnRenamed("n", count)
    large = {"ul": 0.90, "low": 0.05, "high": 0.95}
    out = rows.join(F.broadcast(table), count, "left")
    return out.withColumns({c: F.coalesce(c, poisson_upper_large(F.col(count) - (1 if c == "low" else 0), q)) for c, q in large.items()})


def rates(cand: DataFrame, background: DataFrame, fam: DataFrame, live: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Candidates with far_lr, far_net (a year), their 90 % limits ul_lr, ul_net, best_far, best_ul and channel.

    background: scored rows above the floor, with l1bin; fam: scored loudest rows of the families in net; live: fold, live_yr.
    Per arm: each channel's rate is twice the lesser of the arms' (two arms tried), and the best is the lesser of the
    channels' times how many there are. Otherwise background that fails the absolute glitch cut doesn't count, and the best
    is the lesser of the channels'. The limit is that of the channel with the lesser rate, under the same factors. A channel whose
    floor the trigger doesn't reach has null, never 0, and so has a fold without livetime.
    """
    if config.per_arm:
        rows = per_arm(cand, background, "loglr", hm="lr_hm", lm="lr_lm")
        rows = per_arm(rows, fam, "net", inclusive=True, hm="net_hm", lm="net_lm")
        rows = rows.withColumn("n_lr", F.least("lr_hm", "lr_lm")).withColumn("n_net", F.least("net_hm", "net_lm"))
        trials = F.lit(2)
    else:
        rows = louder_families(cand, gated(background, config), "n_lr")
        rows = count_louder(rows, gated(fam, config), "net", ["fold"], "n_net", inclusive=True)
        trials = F.lit(1)
    rows = rows.join(F.broadcast(live), "fold", "left")  # a row a fold
    for name, on in (("lr", F.col("loglr") >= config.lr_floor), ("net", F.col("net") >= config.net_floor)):
        rows = with_upper(rows, f"n_{name}", f"ul_{name}")
        for value, rate in ((f"n_{name}", f"far_{name}"), (f"ul_{name}", f"ul_{name}")):
            rows = rows.withColumn(rate, F.when(on & (F.col("live_yr") > 0), trials * F.col(value) / F.col("live_yr")))
    by_lr = F.col("far_net").isNull() | (F.col("far_lr") <= F.col("far_net"))
    tried = F.when(F.col("far_lr").isNotNull() & F.col("far_net").isNotNull(), 2).otherwise(1) if config.per_arm else F.lit(1)
    rows = rows.withColumn("best_far", tried * F.least("far_lr", "far_net")).withColumn("best_ul", tried * F.when(by_lr, F.col("ul_lr")).otherwise(F.col("ul_net")))
    return rows.withColumn("channel", F.when(F.col("best_far").isNotNull(), F.when(by_lr, "loglr").otherwise("net-sigma")))


def detections(rated: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """rated with is_glitch, kept_by and detected: not a glitch, and the best rate and its limit both under the threshold."""
    low = lambda c: F.coalesce(F.col(c) < config.far_threshold, F.lit(False))
    out = rated.withColumn("is_glitch", F.greatest("hm", "lm") < config.glitch_cut).withColumn("kept_by", kept_by(F.col("hm"), F.col("lm"), config.glitch_cut))
    return out.withColumn("detected", ~F.col("is_glitch") & low("best_far") & low("best_ul"))
