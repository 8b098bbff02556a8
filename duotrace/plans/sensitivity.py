"""Queries of the post-processing: efficiencies, sensitive volume, calibration, samples and intervals."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from duotrace.functions.expr import logistic
from duotrace.operators import curves, intervals, ranking
from duotrace.sources import fixtures as fx

R = 6
#: Upper edges of the mass bins (the last is closed by the table's largest mass).
EDGES = (50, 100, 200, 400)
#: Detection thresholds on the likelihood ratio, and a curve of (score, log10 of the false-alarm rate) to interpolate.
GRID = tuple(round(-3 + 0.25 * k, 2) for k in range(41))
CURVE = ((-3.0, 4.0), (-1.0, 2.5), (0.0, 1.0), (2.0, -0.5), (5.0, -3.0))
REPS = 200
#: Chances that a Poisson variable of mean 1 is at most 0, 1, .. 9; beyond lies less than the grid of the draws (a millionth).
POISSON = tuple(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(10))


def _bin():
    out = F.lit(len(EDGES) - 1)
    for k in reversed(range(len(EDGES) - 1)):
        out = F.when(F.col("mtot") < EDGES[k], k).otherwise(out)
    return out.alias("bin")


def _horizon():
    """Distance at which a signal of this mass is just seen: a power law of the mass."""
    return 100.0 * F.pow(F.col("mtot") / 30.0, F.lit(5.0 / 6.0))


def _inj(spark, d):
    return fx.injections(spark, d)


def mass_efficiency(spark, d):
    found = F.col("gated") & (F.col("loglr") > 1.0)
    out = _inj(spark, d).groupBy(_bin()).agg(F.count("*").alias("n"), F.count_if(found).alias("n_found"))
    return out.withColumn("efficiency", F.round(F.col("n_found") / F.col("n"), R))


def sensitive_volume(spark, d):
    vol = 4.0 / 3.0 * math.pi * F.pow(_horizon(), F.lit(3.0))
    found = F.col("gated") & (F.col("loglr") > 1.0)
    out = _inj(spark, d).groupBy(_bin()).agg((F.count_if(found) / F.count("*") * F.avg(vol)).alias("v"))
    return out.select("bin", F.round(F.col("v") / 1e6, 4).alias("volume"), F.round(F.pow(3.0 * F.col("v") / (4.0 * math.pi), F.lit(1.0 / 3.0)), 4).alias("distance"))


def volume_curve(spark, d):
    """Volume by threshold: each signal falls into one step of the grid, and steps are summed from above, so nothing is crossed with the grid."""
    step = F.least(F.ceil((F.col("loglr") - GRID[0]) / 0.25) - 1, F.lit(len(GRID) - 1)).cast("int")
    base = _inj(spark, d).groupBy(_bin()).agg(F.count("*").alias("n"), F.avg(F.pow(_horizon(), F.lit(3.0))).alias("v"))
    got = _inj(spark, d).filter(F.col("gated")).groupBy(_bin(), step.alias("step")).agg(F.count("*").alias("found")).filter("step >= 0")
    grid = base.select("bin", "n", "v", F.posexplode(F.array(*map(F.lit, GRID))).alias("step", "threshold"))
    above = Window.partitionBy("bin").orderBy(F.desc("step"))
    out = grid.join(got, ["bin", "step"], "left").withColumn("found", F.sum(F.coalesce("found", F.lit(0))).over(above))
    return out.select("bin", "threshold", "found", F.round(F.col("found") / F.col("n") * F.col("v") / 1e6, 4).alias("volume"))


def _hundredths(x):
    """x to two digits as SQL's engine rounds: the product with 100, halves away from zero. F.round(x, 2) rounds the number's decimal form, which differs where the product falls on a half."""
    return F.round(x * 100.0) / 100.0


def far_curve(spark, d):
    """How many noise rows reach each score, and the rate that is over half a year."""
    noise = _inj(spark, d).filter("noise_half = 0").withColumn("score", _hundredths(F.col("loglr")))
    out = ranking.running_total(noise, "score", 0.5, n=F.lit(1))
    return out.select("score", (F.col("n") + F.col("n_above")).alias("rank"), ((F.col("n") + F.col("n_above")) / 0.5).alias("far"))


def roc_auc(spark, d):
    out = ranking.auc(_inj(spark, d).withColumn("score", _hundredths(F.col("loglr"))), "score", F.col("mtot") >= 200, 0.5)
    return out.select("n_pos", "n_neg", F.round("auc", R).alias("auc"))


def reliability(spark, d):
    p = logistic(F.col("loglr"), 0.0, 1.0)
    out = _inj(spark, d).groupBy(F.floor(p * 10).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(p), R).alias("predicted"), F.round(F.avg(F.col("gated").cast("int")), R).alias("realised"))
    return out.filter("n >= 10 and bin between 0 and 9")  # a probability of 1 belongs to no bin


def mass_density(spark, d):
    low = F.col("mtot") * F.col("q") / (1 + F.col("q"))
    cell = lambda m: F.floor(F.log10(m) * 10)
    return _inj(spark, d).groupBy(cell(F.col("mtot") - low).alias("m1"), cell(low).alias("m2")).agg(F.count("*").alias("n"))


def quantile_grid(spark, d):
    at = [k / 32 for k in range(33)]
    out = fx.windows(spark, d).filter("sigma >= 1").groupBy("det").agg(F.percentile("sigma", F.array(*map(F.lit, at))).alias("v"))
    return out.select("det", F.posexplode("v").alias("k", "v")).select("det", "k", F.round("v", 5).alias("v"))


def curve_lookup(spark, d):
    """The false-alarm rate of each score by interpolation in its logarithm, held at the ends."""
    x = F.col("loglr")
    out = F.lit(CURVE[-1][1])
    for (a, u), (b, v) in reversed(list(zip(CURVE, CURVE[1:]))):
        out = F.when(x < b, F.lit(u) + (x - a) * ((v - u) / (b - a))).otherwise(out)
    out = F.when(x <= CURVE[0][0], CURVE[0][1]).otherwise(out)
    return _inj(spark, d).select("inj_id", F.round(out, R).alias("log_far"), (x >= CURVE[-1][0]).alias("upper_limit"), (x <= CURVE[0][0]).alias("lower_bound"))


def curve_table_lookup(spark, d):
    """Rates of the second noise half's scores by the curve that the first half's ranks make, in the logarithm; an as-of join of two tables."""
    curve = far_curve(spark, d).select("score", "far")
    out = curves.interpolated(_inj(spark, d).filter("noise_half = 1"), curve, "loglr", "score", "far", "rate", logarithmic=True)
    return out.select("inj_id", F.round("rate", R).alias("rate"), "rate_low", "rate_high")


def aligned_scores(spark, d):
    """The first stream's scores moved to the second's quantiles: both grids as one curve, looked up as of each score."""
    win = fx.windows(spark, d)
    at = [k / 512 for k in range(513)]
    grids = win.filter("sigma >= 1").groupBy("det").agg(F.percentile("sigma", F.array(*map(F.lit, at))).alias("v")).select("det", F.posexplode("v").alias("k", "v"))
    h, low = (grids.filter(F.col("det") == x).select("k", F.col("v").alias(n)) for x, n in (("H1", "a"), ("L1", "b")))
    out = curves.interpolated(win.filter("det = 'H1'").select("seg", "idx", "sigma"), h.join(low, "k"), "sigma", "a", "b", "aligned")
    return out.select("seg", "idx", F.round("aligned", 5).alias("aligned"))


def veto_subtract(spark, d):
    e = fx.table(spark, d, "events")
    at = F.col("event_id")
    locks = e.filter("event_type <> 'error'").select((F.col("user_id") % 8).alias("seg"), at.alias("start"), (at + 40).alias("end"))
    vetoes = e.filter("event_type = 'error'").select((F.col("user_id") % 8).alias("seg"), at.alias("start"), (at + F.col("user_id") % 7).alias("end"))
    return intervals.subtract(locks, vetoes)


def source_split(spark, d):
    """Train, validation and test by source, so that no source is in two of them."""
    mark = (F.col("o_custkey") * 7919 + 104729) % 1000
    part = F.when(mark < 800, "train").when(mark < 900, "val").otherwise("test")
    return fx.table(spark, d, "orders").groupBy(part.alias("split")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("sources"))


def stratified_sample(spark, d):
    """Twenty signals of each mass and noise cell, those of least arithmetic hash."""
    mark = (F.col("inj_id") * 7919) % 1000003
    rank = F.row_number().over(Window.partitionBy("bin", "noise_half").orderBy("mark", "inj_id"))
    return _inj(spark, d).select("inj_id", _bin(), "noise_half", mark.alias("mark")).withColumn("rank", rank).filter("rank <= 20").select("inj_id", "bin", "noise_half")


def poisson_bootstrap(spark, d):
    """Bootstrap over segments, not rows: a segment's rows are summed once and weighted by a Poisson draw in each repetition."""
    sums = fx.windows(spark, d).groupBy("seg").agg(F.sum("sigma").alias("s"), F.count("*").alias("n"))
    u = ((F.col("rep").cast("long") * 15485863 + F.col("seg") * 104729 + 12345) * 7919) % 1000003 / 1000003.0
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0))
    reps = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(REPS - 1))).alias("rep")).withColumn("w", weight)
    means = reps.groupBy("rep").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("mean"))
    return means.agg(*(F.round(F.percentile("mean", p), R).alias(n) for n, p in (("p05", 0.05), ("median", 0.5), ("p95", 0.95))))


def quality_bits(spark, d):
    """Windows of four seconds all of whose samples have the three quality bits."""
    e = fx.table(spark, d, "events").select((F.col("user_id") % 8).alias("seg"), F.floor(F.col("event_id") / 4).alias("w"), (F.col("event_id") % 11 + 5).alias("dq"))
    clean = e.groupBy("seg", "w").agg(F.bool_and(F.col("dq").bitwiseAND(7) == 7).alias("good"))
    return clean.groupBy("seg").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"))


def kernel_density(spark, d):
    """Gaussian density of the scores at nine fixed points: one scan, with partial sums."""
    points = [-2.0 + k for k in range(9)]
    out = _inj(spark, d).select("loglr", F.explode(F.array(*map(F.lit, points))).alias("x")).groupBy("x")
    return out.agg(F.round(F.avg(F.exp(-F.pow((F.col("x") - F.col("loglr")) / 0.5, F.lit(2.0)) / 2)) / (0.5 * math.sqrt(2 * math.pi)), R).alias("density"))


QUERIES = {
    f.__name__: f
    for f in (
        mass_efficiency, sensitive_volume, volume_curve, far_curve, roc_auc, reliability, mass_density, quantile_grid, curve_lookup, curve_table_lookup, aligned_scores, veto_subtract, source_split,
        stratified_sample, poisson_bootstrap, quality_bits, kernel_density,
    )
}

_INJ = """WITH inj0 AS (SELECT o_orderkey AS inj_id, (10.0 + o_orderkey % 390)::DOUBLE AS mtot, 0.1::DOUBLE + 0.9::DOUBLE * ((o_orderkey * 37) % 1000) / 1000.0::DOUBLE AS q,
  o_totalprice::DOUBLE / 50000.0::DOUBLE - 3 AS loglr, o_orderkey % 5 <> 0 AS gated, (o_orderkey % 2)::INT AS noise_half FROM orders),
inj AS (SELECT *, CASE WHEN mtot < 50 THEN 0 WHEN mtot < 100 THEN 1 WHEN mtot < 200 THEN 2 ELSE 3 END AS bin, 100.0::DOUBLE * pow(mtot / 30.0::DOUBLE, 5.0::DOUBLE / 6.0::DOUBLE) AS dh FROM inj0) """
_P = "(1 / (1 + exp(-loglr)))"


def _curve() -> str:
    arms = "".join(f" WHEN loglr < {b} THEN {u}::DOUBLE + (loglr - {a}::DOUBLE) * ({(v - u) / (b - a)})::DOUBLE" for (a, u), (b, v) in zip(CURVE, CURVE[1:]))
    return f"CASE WHEN loglr <= {CURVE[0][0]} THEN {CURVE[0][1]}::DOUBLE{arms} ELSE {CURVE[-1][1]}::DOUBLE END"


def _windows(rest: str) -> str:
    from duotrace.plans.search import _WIN

    return f"WITH {_WIN.strip()} {rest}"


ORACLES = {
    "mass_efficiency": _INJ + f"SELECT bin, count(*) AS n, count(*) FILTER (gated AND loglr > 1) AS n_found, round(count(*) FILTER (gated AND loglr > 1) / count(*), {R}) AS efficiency FROM inj GROUP BY bin",
    "sensitive_volume": _INJ + """, v AS (SELECT bin, count(*) FILTER (gated AND loglr > 1) / count(*) * avg(4.0::DOUBLE / 3.0::DOUBLE * pi() * pow(dh, 3)) AS v FROM inj GROUP BY bin)
        SELECT bin, round(v / 1e6, 4) AS volume, round(pow(3.0::DOUBLE * v / (4.0::DOUBLE * pi()), 1.0::DOUBLE / 3.0::DOUBLE), 4) AS distance FROM v""",
    "volume_curve": _INJ + """, g AS (SELECT (-3 + 0.25 * k)::DOUBLE AS threshold FROM (SELECT unnest(range(41)) AS k)),
        n AS (SELECT bin, count(*) AS n, avg(pow(dh, 3)) AS v FROM inj GROUP BY bin),
        f AS (SELECT bin, threshold, n, v, (SELECT count(*) FROM inj i WHERE i.bin = n.bin AND gated AND loglr > threshold) AS found FROM n, g)
        SELECT bin, threshold, found, round(found / n * v / 1e6, 4) AS volume FROM f""",
    "far_curve": _INJ + """SELECT score, count(*) OVER (ORDER BY score DESC) AS rank, count(*) OVER (ORDER BY score DESC) / 0.5::DOUBLE AS far FROM
        (SELECT round(loglr, 2) AS score FROM inj WHERE noise_half = 0) QUALIFY row_number() OVER (PARTITION BY score) = 1""",
    "roc_auc": _INJ + f""", r AS (SELECT mtot >= 200 AS pos, rank() OVER (ORDER BY round(loglr, 2)) + (count(*) OVER (PARTITION BY round(loglr, 2)) - 1) / 2.0::DOUBLE AS r FROM inj),
        s AS (SELECT count(*) FILTER (pos) AS p, count(*) FILTER (NOT pos) AS n, sum(r) FILTER (pos) AS r FROM r)
        SELECT p AS n_pos, n AS n_neg, round((r - p * (p + 1) / 2) / (p::DOUBLE * n), {R}) AS auc FROM s""",
    "reliability": _INJ + f"SELECT floor({_P} * 10)::BIGINT AS bin, count(*) AS n, round(avg({_P}), {R}) AS predicted, round(avg(gated::INT), {R}) AS realised FROM inj GROUP BY 1 HAVING count(*) >= 10 AND bin BETWEEN 0 AND 9",
    "mass_density": _INJ + "SELECT floor(log10(mtot - mtot * q / (1 + q)) * 10)::BIGINT AS m1, floor(log10(mtot * q / (1 + q)) * 10)::BIGINT AS m2, count(*) AS n FROM inj GROUP BY ALL",
    "quantile_grid": _windows("""SELECT det, k::INT AS k, round(v[k + 1], 5) AS v FROM (SELECT det, quantile_cont(sigma, [""" + ", ".join(str(k / 32) for k in range(33)) + """]) AS v
        FROM win WHERE sigma >= 1 GROUP BY det), (SELECT unnest(range(33)) AS k)"""),
    "curve_lookup": _INJ + f"SELECT inj_id, round({_curve()}, {R}) AS log_far, loglr >= {CURVE[-1][0]} AS upper_limit, loglr <= {CURVE[0][0]} AS lower_bound FROM inj",
    "curve_table_lookup": _INJ + f""", c AS MATERIALIZED (SELECT DISTINCT round(loglr, 2) AS score, rank() OVER (ORDER BY round(loglr, 2) DESC) - 1 + count(*) OVER (PARTITION BY round(loglr, 2)) AS k FROM inj WHERE noise_half = 0),
        p AS (SELECT score, k / 0.5::DOUBLE AS far FROM c), e AS (SELECT min(score) AS lo, max(score) AS hi, arg_min(far, score) AS flo, arg_max(far, score) AS fhi FROM p),
        a AS (SELECT inj_id, loglr, p.score AS x0, p.far AS y0 FROM (SELECT * FROM inj WHERE noise_half = 1) i ASOF LEFT JOIN p ON i.loglr >= p.score),
        b AS (SELECT a.*, p.score AS x1, p.far AS y1 FROM a ASOF LEFT JOIN p ON a.loglr < p.score)
        SELECT inj_id, round(CASE WHEN loglr <= lo THEN flo WHEN loglr >= hi THEN fhi ELSE exp(ln(y0) + (loglr - x0) * ((ln(y1) - ln(y0)) / (x1 - x0))) END, {R}) AS rate, loglr <= lo AS rate_low, loglr >= hi AS rate_high FROM b, e""",
    "aligned_scores": _windows(""", g AS (SELECT det, unnest(quantile_cont(sigma, [k / 512.0::DOUBLE FOR k IN range(513)])) AS v, unnest(range(513)) AS k FROM win WHERE sigma >= 1 GROUP BY det),
        c AS MATERIALIZED (SELECT h.v AS a, min(l.v) AS b FROM g h JOIN g l ON l.k = h.k AND h.det = 'H1' AND l.det = 'L1' GROUP BY h.v), w AS (SELECT seg, idx, sigma FROM win WHERE det = 'H1'),
        x AS (SELECT w.*, c.a AS a0, c.b AS b0 FROM w ASOF LEFT JOIN c ON sigma >= c.a), y AS (SELECT x.*, c.a AS a1, c.b AS b1 FROM x ASOF LEFT JOIN c ON sigma < c.a)
        SELECT seg, idx, round(CASE WHEN a0 IS NULL THEN (SELECT arg_min(b, a) FROM c) WHEN a1 IS NULL THEN (SELECT arg_max(b, a) FROM c) ELSE b0 + (sigma - a0) * ((b1 - b0) / (a1 - a0)) END, 5) AS aligned FROM y"""),
    "veto_subtract": """WITH i AS (SELECT user_id % 8 AS seg, event_id AS s, event_id + CASE WHEN event_type = 'error' THEN user_id % 7 ELSE 40 END AS e, event_type = 'error' AS veto FROM events),
        sec AS (SELECT DISTINCT seg, unnest(range(s, e)) AS t FROM i WHERE NOT veto), bad AS (SELECT DISTINCT seg, unnest(range(s, e)) AS t FROM i WHERE veto),
        good AS (SELECT seg, t, t - row_number() OVER (PARTITION BY seg ORDER BY t) AS island FROM (SELECT * FROM sec EXCEPT SELECT * FROM bad))
        SELECT seg, min(t) AS start, max(t) + 1 AS "end" FROM good GROUP BY seg, island""",
    "source_split": """SELECT CASE WHEN m < 800 THEN 'train' WHEN m < 900 THEN 'val' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT o_custkey) AS sources
        FROM (SELECT *, (o_custkey * 7919 + 104729) % 1000 AS m FROM orders) GROUP BY 1""",
    "stratified_sample": _INJ + "SELECT inj_id, bin, noise_half FROM inj QUALIFY row_number() OVER (PARTITION BY bin, noise_half ORDER BY (inj_id * 7919) % 1000003, inj_id) <= 20",
    "poisson_bootstrap": _windows(f""", s AS (SELECT seg, sum(sigma) AS s, count(*) AS n FROM win GROUP BY seg),
        u AS (SELECT *, ((rep * 15485863 + seg * 104729 + 12345) * 7919) % 1000003 / 1000003.0::DOUBLE AS u FROM s, (SELECT unnest(range({REPS})) AS rep)),
        m AS (SELECT rep, sum(w * s) / sum(w * n) AS mean FROM (SELECT *, {" + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in POISSON)} AS w FROM u) GROUP BY rep)
        SELECT round(quantile_cont(mean, 0.05), {R}) AS p05, round(quantile_cont(mean, 0.5), {R}) AS median, round(quantile_cont(mean, 0.95), {R}) AS p95 FROM m"""),
    "quality_bits": "SELECT seg, count(*) AS n, count(*) FILTER (good) AS n_good FROM (SELECT user_id % 8 AS seg, event_id // 4 AS w, bool_and(((event_id % 11 + 5) & 7) = 7) AS good FROM events GROUP BY ALL) GROUP BY seg",
    "kernel_density": _INJ + f"""SELECT x, round(avg(exp(-pow((x - loglr) / 0.5::DOUBLE, 2) / 2)) / (0.5::DOUBLE * sqrt(2 * pi())), {R}) AS density FROM inj, (SELECT (-2 + unnest(range(9)))::DOUBLE AS x) GROUP BY x""",
}
