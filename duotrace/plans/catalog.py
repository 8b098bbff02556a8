"""Queries of the bookkeeping around a search: event tables, catalogues, file sets, samples and windows of raw samples."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from duotrace.config import FIXTURE
from duotrace.operators import intervals, pairing, tables
from duotrace.plans.search import _WIN, _families
from duotrace.plans.sensitivity import _INJ, _bin, _inj
from duotrace.sources import fixtures as fx

R = fx.DIGITS
REACH = 8.0
#: Quality bits that a clean sample has in each mask.
DQ, INJ = 7, 23


def _events(spark):
    return pairing.known_events(spark, FIXTURE)


def event_windows(spark, d):
    return tables.event_windows(fx.windows(spark, d), _events(spark), REACH)


def aligned_best(spark, d):
    out = tables.aligned_best(fx.windows(spark, d), _events(spark), REACH)
    return out.withColumn("total", F.round("total", R))


def sigma_flags(spark, d):
    """By fold, thresholds of 3 and 5 deviations above the mean of the network statistic, and how many zero-lag rows lie above them."""
    zero = pairing.zero_lag(fx.windows(spark, d))
    marks = tables.k_sigma(zero, ["fold"], "net")
    out = zero.join(F.broadcast(marks), "fold").groupBy("fold", "t3", "t5").agg(F.count_if(F.col("net") > F.col("t3")).alias("over3"), F.count_if(F.col("net") > F.col("t5")).alias("over5"))
    return out.select("fold", F.round("t3", R).alias("t3"), F.round("t5", R).alias("t5"), "over3", "over5")


def mass_hit_rate(spark, d):
    """The share of each mass bin's signals whose likelihood ratio lies above three deviations of the noise half's."""
    inj = _inj(spark, d).withColumn("ratio", F.exp("loglr")).withColumn("one", F.lit(1))
    noise = tables.k_sigma(inj.filter("noise_half = 0"), ["one"], "ratio", (3,))
    out = inj.join(F.broadcast(noise.select("one", "t3")), "one").groupBy(_bin()).agg(F.count("*").alias("n"), F.count_if(F.col("ratio") > F.col("t3")).alias("hits"))
    return out.withColumn("rate", F.round(F.col("hits") / F.col("n"), R))


def benchmark_summary(spark, d):
    out = _inj(spark, d).groupBy("gated").agg(F.count("*").alias("n"), F.round(F.avg("loglr"), R).alias("mean"), F.round(F.percentile("loglr", 0.5), R).alias("median"), F.round(F.max("loglr"), R).alias("most"), F.count_if(F.col("loglr") > 1).alias("n_above"))
    return out


def split_summary(spark, d):
    part = F.when(F.col("inj_id") % 10 < 8, "train").when(F.col("inj_id") % 10 == 8, "val").otherwise("test")
    return _inj(spark, d).groupBy(part.alias("split")).agg(F.count("*").alias("n"), F.count_distinct(F.floor(F.col("inj_id") / 4096)).alias("blocks"))


def _locks(spark, d):
    e = fx.table(spark, d, "events")
    at = F.col("event_id")
    locks = e.filter("event_type <> 'error'").select((F.col("user_id") % 8).alias("seg"), at.alias("start"), (at + 40).alias("end"))
    vetoes = e.filter("event_type = 'error'").select((F.col("user_id") % 8).alias("seg"), at.alias("start"), (at + F.col("user_id") % 7).alias("end"))
    return locks, vetoes


def segment_totals(spark, d):
    """Seconds of each segment's locks, those that no veto covers, and the vetoed fraction."""
    locks, vetoes = _locks(spark, d)
    nothing = vetoes.limit(0)
    seconds = lambda df, n: df.groupBy("seg").agg(F.sum(F.col("end") - F.col("start")).alias(n))
    out = seconds(intervals.subtract(locks, nothing), "total_s").join(seconds(intervals.subtract(locks, vetoes), "good_s"), "seg", "left").fillna(0, ["good_s"])
    return out.withColumn("vetoed_frac", F.round(1 - F.col("good_s") / F.col("total_s"), R))


def coherence_pass(spark, d):
    """Zero-lag rows that pass the coherence cut, the morphology cut, and both."""
    z = pairing.zero_lag(fx.windows(spark, d))
    coh = pairing.coherence_stub(F.col("idx"), F.col("idx"), F.col("seg"), F.col("seg")) >= 0.4
    low = (F.col("centroid_h") < 40) & (F.col("centroid_l") < 40)
    return z.groupBy("seg").agg(F.count_if(coh).alias("coherent"), F.count_if(low).alias("low"), F.count_if(coh & low).alias("massive"))


def _samples(spark, d):
    at = F.row_number().over(Window.partitionBy("seg").orderBy("event_id")) - 1
    e = fx.raw_windows(spark, d).select("seg", "event_id", "value", "k")
    return e.withColumn("at", at.cast("long")).withColumn("dq", F.col("k") % 8).withColumn("inj", (F.col("k") * 3) % 32)


def sample_windows(spark, d):
    """Windows of 4 samples every 2, whole ones only: their sums, and how many a segment has."""
    out = tables.frames(_samples(spark, d), ["seg"], "at", ["value"], 4, 2)
    return out.groupBy("seg").agg(F.count("*").alias("n"), F.round(F.max("value"), 3).alias("most"))


def _masked(spark, d):
    """Samples most of which have every quality bit and no signal put in; some bits are missing, and some values aren't finite."""
    k = F.col("k")
    s = _samples(spark, d).withColumn("dq", F.when(k % 13 == 0, k % 8).otherwise(127)).withColumn("inj", F.when(k % 17 == 0, k % 32).otherwise(F.when(k % 2 == 0, 31).otherwise(23)))
    return s.withColumn("value", F.when(F.col("event_id") % 53 == 0, F.lit(float("nan"))).when(F.col("event_id") % 59 == 0, F.lit(float("inf"))).otherwise(F.col("value")))


def clean_windows(spark, d):
    """Windows of 4 samples all of which have the quality bits, no signal put in (the hardware bit, 8, doesn't matter) and a finite value."""
    good = tables.clean_frames(_masked(spark, d), ["seg"], "at", {"dq": DQ, "inj": INJ}, 4, 2, finite=("value",))
    return good.groupBy("seg").agg(F.count("*").alias("n"), F.sum("w").alias("sum_w"))


def injection_mask(spark, d):
    s = _samples(spark, d)
    return s.groupBy("seg").agg(F.count_if(F.col("inj").bitwiseAND(INJ) == INJ).alias("clean"), F.count_if(F.col("dq").bitwiseAND(DQ) == DQ).alias("good"))


def ordinal_pairing(spark, d):
    rows = fx.raw_windows(spark, d).select("seg", "det", "ts", "event_id")
    return tables.ordinal_pairs(rows, ["seg"], ["ts", "event_id"]).select("seg", "k", F.col("h.event_id").alias("h_id"), F.col("l.event_id").alias("l_id"))


def bank_parameters(spark, d):
    """Signals with their source's parameters, one branch four times over: counts and sums by segment."""
    bank = fx.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("source_id"))
    rows = tables.required(bank, fx.table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), "c_mktsegment"), ["source_id"], "c_mktsegment")
    return tables.oversampled(rows, F.col("o_orderkey") % 3 == 0, 4).groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("copy").alias("copies"))


def metadata_merge(spark, d):
    """A part's own size where it is known, else its type's first: the first source wins."""
    part = fx.table(spark, d, "part").select("p_partkey", "p_type", F.when(F.col("p_partkey") % 3 > 0, F.col("p_size")).alias("size"))
    types = fx.table(spark, d, "part").groupBy("p_type").agg(F.min_by("p_size", "p_partkey").alias("usual"))
    return part.join(types, "p_type", "left").select("p_partkey", F.coalesce("size", "usual").alias("size"))


def catalogue_order(spark, d):
    """Rows of a catalogue that a list names, in the list's order; names that the catalogue lacks are left out."""
    wanted = fx.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("position"))
    wanted = tables.first_of(wanted, "id", "position")
    return wanted.join(fx.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"), "id").select("position", "id", "c_name")


def file_sets(spark, d):
    """Starts of the files (of 4096 s) that both streams have and that hold no known event."""
    win = fx.windows(spark, d)
    start = (F.floor(F.col("gps") / 4096) * 4096).alias("start")
    h, low = (win.filter(F.col("det") == x).select(start).distinct() for x in ("H1", "L1"))
    events = _events(spark).select((F.floor(F.col("event_gps") / 4096) * 4096).alias("start"))
    return h.intersect(low).join(events, "start", "left_anti")


def even_choice(spark, d):
    """Five windows of each segment and stream, evenly spaced."""
    return tables.evenly(fx.windows(spark, d).select("seg", "det", "idx"), ["seg", "det"], ["idx"], 5)


def tail_bulk_sample(spark, d):
    mark = (F.col("inj_id") * 7919) % 1000003
    return tables.tail_and_bulk(_inj(spark, d).select("inj_id", "loglr"), "loglr", 50, 100, mark, ["inj_id"]).select("inj_id", F.round("loglr", R).alias("loglr"), F.round("weight", R).alias("weight"))


def both_folds(spark, d):
    """Signals in the fold of their noise, and all in both."""
    inj = _inj(spark, d)
    out = inj.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1)))).groupBy("fold").agg(F.count("*").alias("both"), F.count_if(F.col("fold") == F.col("noise_half")).alias("own"))
    return out


def mass_cells(spark, d):
    """Signals of nearly equal masses, and those within 5 of (m1, m2) = (60, 30) either way round."""
    low = F.col("mtot") * F.col("q") / (1 + F.col("q"))
    near = lambda m, x: F.abs(m - x) <= 5
    m1, m2 = F.col("mtot") - low, low
    cell = (near(m1, 60) & near(m2, 30)) | (near(m1, 30) & near(m2, 60))
    return _inj(spark, d).groupBy("noise_half").agg(F.count_if(F.col("q") >= 0.9).alias("n_equal"), F.count_if(cell).alias("n_cell"))


def needed_pairs(spark, d):
    """Pairs that either channel wants scored, once each: families loud in net, and rows loud together."""
    from duotrace.plans.search import _binned, _clean, far

    _, clean = _clean(spark, d, FIXTURE)
    one = _families(clean).select("ai", "ih", "bi", "il")
    two = _binned(far.bounded_prune(clean, FIXTURE)).select("ai", "ih", "bi", "il")
    return one.unionByName(two).distinct().groupBy("ai", "bi").agg(F.count("*").alias("n"))


def survivor_count(spark, d):
    """How many of the background rows the absolute glitch cut keeps."""
    from duotrace.plans.search import _clean, far

    _, clean = _clean(spark, d, FIXTURE)
    return far.bounded_prune(clean, FIXTURE).agg(F.count("*").alias("n_scored"), F.count_if(F.greatest("hm", "lm") > FIXTURE.glitch_cut).alias("n_pass"))


def threshold_at_rate(spark, d):
    """The least score whose false alarms, over half a year of noise, come at most 100, 1,000 or 10,000 times a year; null if none does."""
    from duotrace.operators import ranking

    noise = _inj(spark, d).filter("noise_half = 0").withColumn("score", F.round("loglr", 2))
    curve = ranking.running_total(noise, "score", 0.5, n=F.lit(1)).select("score", ((F.col("n") + F.col("n_above")) / 0.5).alias("far"))
    return curve.agg(*(F.min(F.when(F.col("far") <= x, F.col("score"))).alias(f"at_{x}") for x in (100, 1000, 10_000)))


def cumulative_volume(spark, d):
    """The integral of the signals' volume element over mass, by trapezoids from one mass to the next, in each noise half."""
    points = _inj(spark, d).groupBy("noise_half", "mtot").agg(F.count("*").alias("n")).withColumn("y", 100.0 * F.col("n") / (1 + F.col("mtot") / 100.0))
    return tables.trapezoid(points, ["noise_half"], "mtot", "y", "volume").select("noise_half", "mtot", F.round("volume", 4).alias("volume"))


def nulls_last(spark, d):
    """The ten loudest signals where half the scores are unknown, those last."""
    score = F.when(F.col("noise_half") == 0, F.col("loglr"))
    return _inj(spark, d).select("inj_id", score.alias("s")).orderBy(F.desc_nulls_last("s"), "inj_id").limit(10).select("inj_id", F.round("s", R).alias("s"))


def reanchor(spark, d):
    """Scores of one stream on the scale of the other: by mean and deviation."""
    win = fx.windows(spark, d)
    stats = win.groupBy("det").agg(F.avg("sigma").alias("m"), F.stddev_pop("sigma").alias("s"))
    a, b = (stats.filter(F.col("det") == x).select(F.lit("H1").alias("det"), F.col("m").alias(f"m_{x}"), F.col("s").alias(f"s_{x}")) for x in ("H1", "L1"))
    both = win.filter("det = 'H1'").join(F.broadcast(a), "det").join(F.broadcast(b), "det")
    return both.select("seg", "idx", F.round((F.col("sigma") * F.col("s_H1") + F.col("m_H1") - F.col("m_L1")) / F.col("s_L1"), 5).alias("sigma"))


QUERIES = {
    f.__name__: f
    for f in (
        event_windows, aligned_best, sigma_flags, mass_hit_rate, benchmark_summary, split_summary, segment_totals, coherence_pass, sample_windows, clean_windows, injection_mask,
        ordinal_pairing, bank_parameters, metadata_merge, catalogue_order, file_sets, even_choice, tail_bulk_sample, both_folds, mass_cells, needed_pairs, survivor_count,
        threshold_at_rate, cumulative_volume, nulls_last, reanchor,
    )
}

_W = f"WITH {_WIN.strip()}"
_KNOWN = "known(name, seg, event_gps) AS (VALUES ('EV0', 0, 100.3::DOUBLE), ('EV3', 3, 3000250.7::DOUBLE))"
_SAMPLES = """WITH s AS (SELECT seg, event_id, value, k, pos, k % 8 AS dq, (k * 3) % 32 AS inj FROM (SELECT user_id % 8 AS seg, event_id, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS pos FROM events)),
f AS (SELECT a.seg, a.pos // 2 AS w, count(*) AS n, sum(b.value) AS v, bool_and(((CASE WHEN b.k % 13 = 0 THEN b.k % 8 ELSE 127 END) & 7) = 7 AND ((CASE WHEN b.k % 17 = 0 THEN b.k % 32 WHEN b.k % 2 = 0 THEN 31 ELSE 23 END) & 23) = 23 AND b.event_id % 53 <> 0 AND b.event_id % 59 <> 0) AS good FROM s a JOIN s b ON b.seg = a.seg AND b.pos BETWEEN a.pos AND a.pos + 3 WHERE a.pos % 2 = 0 GROUP BY a.seg, a.pos HAVING count(*) = 4)"""
_SECONDS = """WITH i AS (SELECT user_id % 8 AS seg, event_id AS s, event_id + CASE WHEN event_type = 'error' THEN user_id % 7 ELSE 40 END AS e, event_type = 'error' AS veto FROM events),
sec AS (SELECT DISTINCT seg, unnest(range(s, e)) AS t FROM i WHERE NOT veto), bad AS (SELECT DISTINCT seg, unnest(range(s, e)) AS t FROM i WHERE veto)"""


def _searched(rest: str) -> str:
    from duotrace.plans.search import _ALL

    return f"WITH {_ALL} {rest}"


ORACLES = {
    "event_windows": f"""{_W}, {_KNOWN}, n AS (SELECT name, det, idx, sigma, abs(gps - event_gps) AS away FROM win JOIN known USING (seg) WHERE abs(gps - event_gps) <= {REACH})
        SELECT * FROM (SELECT name, det, idx AS best_idx, sigma AS best_sigma FROM n QUALIFY row_number() OVER (PARTITION BY name, det ORDER BY sigma DESC, idx) = 1)
        JOIN (SELECT name, det, idx AS centre_idx, sigma AS centre_sigma FROM n QUALIFY row_number() OVER (PARTITION BY name, det ORDER BY away, idx) = 1) USING (name, det)""",
    "aligned_best": f"""{_W}, {_KNOWN} SELECT name, idx, round(total, {R}) AS total FROM (SELECT name, idx, sum(sigma) AS total FROM win JOIN known USING (seg) WHERE abs(gps - event_gps) <= {REACH} GROUP BY name, idx HAVING count(DISTINCT det) = 2)
        QUALIFY row_number() OVER (PARTITION BY name ORDER BY total DESC, idx) = 1""",
    "sigma_flags": f"""{_W}, m AS (SELECT fold, avg(net) + 3 * stddev_pop(net) AS t3, avg(net) + 5 * stddev_pop(net) AS t5 FROM zero GROUP BY fold)
        SELECT fold, round(t3, {R}) AS t3, round(t5, {R}) AS t5, count(*) FILTER (net > t3) AS over3, count(*) FILTER (net > t5) AS over5 FROM zero JOIN m USING (fold) GROUP BY fold, m.t3, m.t5""",
    "mass_hit_rate": _INJ + f""", m AS (SELECT avg(exp(loglr)) + 3 * stddev_pop(exp(loglr)) AS t FROM inj WHERE noise_half = 0)
        SELECT bin, count(*) AS n, count(*) FILTER (exp(loglr) > t) AS hits, round(count(*) FILTER (exp(loglr) > t) / count(*), {R}) AS rate FROM inj, m GROUP BY bin""",
    "benchmark_summary": _INJ + f"SELECT gated, count(*) AS n, round(avg(loglr), {R}) AS mean, round(quantile_cont(loglr, 0.5), {R}) AS median, round(max(loglr), {R}) AS most, count(*) FILTER (loglr > 1) AS n_above FROM inj GROUP BY gated",
    "split_summary": _INJ + "SELECT CASE WHEN inj_id % 10 < 8 THEN 'train' WHEN inj_id % 10 = 8 THEN 'val' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT inj_id // 4096) AS blocks FROM inj GROUP BY 1",
    "segment_totals": _SECONDS + f""" SELECT seg, total_s, coalesce(good_s, 0) AS good_s, round(1 - coalesce(good_s, 0) / total_s, {R}) AS vetoed_frac FROM (SELECT seg, count(*) AS total_s FROM sec GROUP BY seg)
        LEFT JOIN (SELECT seg, count(*) AS good_s FROM (SELECT * FROM sec EXCEPT SELECT * FROM bad) GROUP BY seg) USING (seg)""",
    "coherence_pass": f"""{_W}, c AS (SELECT seg, ((idx * 48 + seg * 10) % 1000) / 1000.0::DOUBLE * 0.6::DOUBLE >= 0.4::DOUBLE AS coh, centroid_h < 40 AND centroid_l < 40 AS low FROM zero)
        SELECT seg, count(*) FILTER (coh) AS coherent, count(*) FILTER (low) AS low, count(*) FILTER (coh AND low) AS massive FROM c GROUP BY seg""",
    "sample_windows": _SAMPLES + " SELECT seg, count(*) AS n, round(max(v), 3) AS most FROM f GROUP BY seg",
    "clean_windows": _SAMPLES + " SELECT seg, count(*) AS n, sum(w)::BIGINT AS sum_w FROM f WHERE good GROUP BY seg",
    "injection_mask": _SAMPLES + f" SELECT seg, count(*) FILTER ((inj & {INJ}) = {INJ}) AS clean, count(*) FILTER ((dq & {DQ}) = {DQ}) AS good FROM s GROUP BY seg",
    "ordinal_pairing": """WITH r AS (SELECT user_id % 8 AS seg, event_id % 2 AS det, event_id, (row_number() OVER (PARTITION BY user_id % 8, event_id % 2 ORDER BY ts, event_id) - 1)::INT AS k FROM events)
        SELECT h.seg, h.k, h.event_id AS h_id, l.event_id AS l_id FROM r h JOIN r l ON h.seg = l.seg AND h.k = l.k AND h.det = 0 AND l.det = 1""",
    "bank_parameters": """SELECT c_mktsegment, sum(CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 1 END)::BIGINT AS n, sum(CASE WHEN o_orderkey % 3 = 0 THEN 6 ELSE 0 END)::BIGINT AS copies FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""",
    "metadata_merge": """SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_size ELSE first_value(p_size) OVER (PARTITION BY p_type ORDER BY p_partkey) END AS size FROM part""",
    "catalogue_order": "SELECT min(o_orderkey) AS position, o_custkey AS id, any_value(c_name) AS c_name FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY o_custkey",
    "file_sets": f"""{_W}, {_KNOWN} SELECT start::BIGINT AS start FROM (SELECT floor(gps / 4096) * 4096 AS start FROM win WHERE det = 'H1' INTERSECT SELECT floor(gps / 4096) * 4096 FROM win WHERE det = 'L1'
        EXCEPT SELECT floor(event_gps / 4096) * 4096 FROM known)""",
    "even_choice": f"""{_W}, n AS (SELECT seg, det, count(*) AS n FROM win GROUP BY ALL), k AS (SELECT DISTINCT seg, det, floor(k * (n - 1) / 4.0::DOUBLE)::BIGINT AS idx FROM n, (SELECT unnest(range(5)) AS k)) SELECT seg, det, idx FROM k""",
    "tail_bulk_sample": _INJ + f""", r AS (SELECT inj_id, loglr, row_number() OVER (ORDER BY loglr DESC, inj_id) AS p FROM inj),
        b AS (SELECT *, row_number() OVER (ORDER BY (inj_id * 7919) % 1000003, inj_id) AS q, count(*) OVER () AS n FROM r WHERE p > 50)
        SELECT inj_id, round(loglr, {R}) AS loglr, 1.0::DOUBLE AS weight FROM r WHERE p <= 50 UNION ALL SELECT inj_id, round(loglr, {R}), round(n / least(100, n), {R}) FROM b WHERE q <= 100""",
    "both_folds": _INJ + "SELECT fold, count(*) AS both, count(*) FILTER (fold = noise_half) AS own FROM inj, (SELECT unnest(range(2))::INT AS fold) GROUP BY fold",
    "mass_cells": _INJ + """, m AS (SELECT noise_half, q, mtot - mtot * q / (1 + q) AS m1, mtot * q / (1 + q) AS m2 FROM inj)
        SELECT noise_half, count(*) FILTER (q >= 0.9::DOUBLE) AS n_equal, count(*) FILTER ((abs(m1 - 60) <= 5 AND abs(m2 - 30) <= 5) OR (abs(m1 - 30) <= 5 AND abs(m2 - 60) <= 5)) AS n_cell FROM m GROUP BY noise_half""",
    "needed_pairs": _searched("SELECT ai, bi, count(*) AS n FROM (SELECT ai, ih, bi, il FROM fam UNION SELECT ai, ih, bi, il FROM bg) GROUP BY ai, bi"),
    "survivor_count": _searched("SELECT count(*) AS n_scored, count(*) FILTER (greatest(hm, lm) > 0.5) AS n_pass FROM bg"),
    "threshold_at_rate": _INJ + """, c AS (SELECT score, count(*) OVER (ORDER BY score DESC) / 0.5::DOUBLE AS far FROM (SELECT round(loglr, 2) AS score FROM inj WHERE noise_half = 0))
        SELECT min(score) FILTER (far <= 100) AS at_100, min(score) FILTER (far <= 1000) AS at_1000, min(score) FILTER (far <= 10000) AS at_10000 FROM c""",
    "cumulative_volume": _INJ + """, p AS (SELECT noise_half, mtot, 100.0::DOUBLE * count(*) / (1 + mtot / 100.0::DOUBLE) AS y FROM inj GROUP BY noise_half, mtot),
        a AS (SELECT noise_half, mtot, coalesce((y + lag(y) OVER w) / 2 * (mtot - lag(mtot) OVER w), 0.0) AS a FROM p WINDOW w AS (PARTITION BY noise_half ORDER BY mtot))
        SELECT noise_half, mtot, round(sum(a) OVER (PARTITION BY noise_half ORDER BY mtot), 4) AS volume FROM a""",
    "nulls_last": _INJ + f"SELECT inj_id, round(s, {R}) AS s FROM (SELECT inj_id, CASE WHEN noise_half = 0 THEN loglr END AS s FROM inj ORDER BY s DESC NULLS LAST, inj_id LIMIT 10)",
    "reanchor": f"""{_W}, w AS (SELECT * FROM win), m AS (SELECT det, avg(sigma) AS m, stddev_pop(sigma) AS s FROM w GROUP BY det)
        SELECT seg, idx, round((sigma * h.s + h.m - l.m) / l.s, 5) AS sigma FROM w, (SELECT * FROM m WHERE det = 'H1') h, (SELECT * FROM m WHERE det = 'L1') l WHERE w.det = 'H1'""",
}
