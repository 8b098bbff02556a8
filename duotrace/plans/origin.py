"""Queries of the probability of origin: proposal and population weights, densities, rates, bootstrap, decision, calibration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from duotrace.config import FIXTURE
from duotrace.operators import cluster, far, origin, pairing, ranking
from duotrace.plans import search
from duotrace.sources import fixtures as fx
from duotrace.sources.tables import written


@dataclass(frozen=True)
class OriginConfig:
    """Defaults are those of a whole analysis; the queries use STAND_IN."""

    #: Noise and events from this network statistic on.
    noise_net: float = 4.0
    event_net: float = 4.0
    #: Shares of the part of high masses, and the mass bins' upper edges (the last is open).
    high_shares: tuple[float, ...] = (0.01, 0.05, 0.1)
    edges: tuple[float, ...] = (50.0, 100.0, 200.0)
    tail: int = 40_000
    bulk: int = 40_000
    reps: int = 1000
    #: False alarms a year below which an injection counts as seen, and how softly in the likelihood ratio.
    seen_rate: float = 10.0
    seen_width: float = 4.0
    threshold: float = 0.9
    rate_threshold: float = 1.0
    mock: int = 150_000
    passes: int = 200
    tolerance: float = 1e-9
    population: origin.Population = origin.Population()


#: The stand-ins' analysis. Its passes are fixed, as SQL can't stop early.
STAND_IN = OriginConfig(noise_net=3.0, event_net=2.0, tail=300, bulk=300, reps=200, seen_rate=5e5, rate_threshold=5e5, mock=4000, passes=25, tolerance=0.0)
ORIGIN = STAND_IN
R = 5
KEY = ["ai", "ih", "bi", "il"]


def _bin(mtot):
    """The mass bin; a missing mass stands in the first."""
    out = F.lit(len(ORIGIN.edges))
    for k in reversed(range(len(ORIGIN.edges))):
        out = F.when(mtot < ORIGIN.edges[k], k).otherwise(out)
    return F.when(mtot.isNull(), 0).otherwise(out)


def _noise(spark, d):
    """All slid pairs loud enough, scored: fold, ai, ih, bi, il, loglr; and the livetime in years as one row."""
    _, clean = search._clean(spark, d, FIXTURE)  # slid twice, as counting slid rows is quicker than writing them
    live = written(far.livetime(clean, FIXTURE).agg(F.sum("live_yr").alias("live_yr")))
    return written(far.with_scores(clean.filter(F.col("net") >= ORIGIN.noise_net), FIXTURE).select(*KEY, "loglr")), live


def _events(spark, d):
    """Clustered zero-lag triggers with their scores and, for most, a mass."""
    trig = cluster.cluster_triggers(pairing.zero_lag(search._win(spark, d)).filter(F.col("net") > ORIGIN.event_net), FIXTURE)
    mass = F.when(F.col("idx") % 7 != 0, 10.0 + (F.col("seg") * 37 + F.col("idx") * 11) % 390)
    return written(far.with_scores(far.as_pairs(trig), FIXTURE).select("seg", "idx", F.col("loglr").alias("x"), mass.alias("mtot")).withColumn("bin", _bin(F.col("mtot"))))


def _masses(spark, d):
    second = F.col("mtot") * F.col("q") / (1 + F.col("q"))
    return fx.injections(spark, d).withColumn("m2", second).withColumn("m1", F.col("mtot") - F.col("m2")).withColumn("bin", _bin(F.col("mtot")))


def _proposal(spark, d):
    return origin.proposal_density(_masses(spark, d), F.log("m1"), F.log("m2"))


def _weights(spark, d):
    """Injections with w{k}: the population's density over the proposal's, for each share of high masses."""
    placed, grid = _proposal(spark, d)
    proposal = F.col("density") / (F.col("m1") * F.col("m2"))
    rows = placed.join(F.broadcast(grid), ["i", "j"])  # at most cells x cells rows
    p = ORIGIN.population
    return rows.select("inj_id", "bin", "gated", "noise_half", "loglr", *((p.density(F.col("m1"), F.col("m2"), f) / p.norm(f) / F.greatest(proposal, F.lit(origin.TINY))).alias(f"w{k}") for k, f in enumerate(ORIGIN.high_shares)))


def _seen(rows, noise, live):
    """rows with `seen`, a soft step at the score that noise exceeds seen_rate times a year."""
    n = live.first()[0] or 0.0
    place = int(ORIGIN.seen_rate * n)
    steps = ranking.running_total(noise, "loglr", 0.05, n=F.lit(1))  # the place grows with the livetime, so no task may hold the rows above it
    x0 = steps.filter(F.col("n_above") <= place).agg(F.min("loglr").alias("x0"))  # fewer rows give their least
    return rows.crossJoin(F.broadcast(x0)).withColumn("seen", 1.0 / (1.0 + F.exp(-(F.col("loglr") - F.col("x0")) / ORIGIN.seen_width))).drop("x0")


def _signal_sample(rows):
    """The weighted injections of every share k and mass bin, with a kernel's width each."""
    each = rows.select("bin", "loglr", F.posexplode(F.array(*(F.col(f"w{k}") * F.col("seen") for k in range(len(ORIGIN.high_shares))))).alias("k", "w"))
    return origin.weighted_sample(each, ["k", "bin"], "loglr", "w")


def _noise_sample(noise):
    mark = (F.col("ih") * 7919 + F.col("il") * 104729 + F.col("ai") * 1299709 + F.col("bi") * 15485863) % 1000003
    return origin.stratified_noise(noise, "loglr", KEY, mark, ORIGIN.tail, ORIGIN.bulk)


def _fitted(spark, d):
    """All that the analysis shares: events, noise and its livetime, kernel sums by pair of segments, weighted injections, densities at events by k, rates by k."""
    noise, live = _noise(spark, d)
    events = _events(spark, d)
    pairs = written(origin.kernel_sums(events.select("seg", "idx", "x"), _noise_sample(noise), ["seg", "idx"], "x", "loglr", "base", ["ai", "bi"]).withColumnRenamed("k", "sum"))
    injections = written(_seen(_weights(spark, d), noise, live))
    shares = len(ORIGIN.high_shares)
    wide = events.select("seg", "idx", "bin", "x", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    signal = _signal_sample(injections.filter("gated")).withColumnRenamed("k", "share")
    ps = origin.kernel_sums(wide, signal, ["seg", "idx", "share", "bin"], "x", "loglr", "base", []).select("seg", "idx", "share", F.col("k").alias("ps"))
    pn = pairs.groupBy("seg", "idx").agg(F.sum("sum").alias("pn"))
    dens = wide.join(ps, ["seg", "idx", "share"], "left").join(pn, ["seg", "idx"], "left").fillna(0.0, ["ps", "pn"])
    dens = written(dens)
    rates = origin.fit_rates(dens, "share", passes=ORIGIN.passes, tolerance=ORIGIN.tolerance)
    return noise, live, events, pairs, injections, dens, rates


def _resampled(pairs, dens, rates):
    """seg, idx, share with median, p05 and p95 of the probability over the repetitions."""
    each = dens.join(F.broadcast(rates), "share").select("seg", "idx", "share", "ps", "rate_s", "rate_n")
    return origin.resampled_shares(each, pairs.withColumnRenamed("sum", "k"), ["seg", "idx"], "ai", "bi", ORIGIN.reps, {"median": 0.5, "p05": 0.05, "p95": 0.95})


def rounded(df, *columns, digits=R):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def mass_proposal(spark, d):
    """The smoothed density of the injections' masses, by cell."""
    return rounded(_proposal(spark, d)[1], "density", digits=6)


def population_weights(spark, d):
    """Each injection's weight under three populations."""
    return rounded(_weights(spark, d), "w0", "w1", "w2", digits=6).select("inj_id", "bin", "w0", "w1", "w2")


def noise_at_events(spark, d):
    """Noise density at each event's score, from the highest scores and a weighted sample of the rest."""
    noise, _ = _noise(spark, d)
    events = _events(spark, d)
    got = origin.kernel_sums(events.select("seg", "idx", "x"), _noise_sample(noise), ["seg", "idx"], "x", "loglr", "base", [])
    return rounded(events.join(got, ["seg", "idx"], "left").select("seg", "idx", F.coalesce("k", F.lit(0.0)).alias("pn")), "pn")


def rate_fit(spark, d):
    """The two rates for each share of high masses, and the probability's mean over events."""
    *_, dens, rates = _fitted(spark, d)
    p = origin.share(F.col("rate_s"), F.col("ps"), F.col("rate_n"), F.col("pn"))
    out = dens.join(F.broadcast(rates), "share").groupBy("share").agg(F.count("*").alias("n"), F.first("rate_s").alias("rate_s"), F.first("rate_n").alias("rate_n"), F.avg(p).alias("mean_p"))
    return rounded(out, "rate_s", "rate_n", "mean_p", digits=4)


def origin_bootstrap(spark, d):
    """Every event's probability of a signal's origin with segments drawn anew: median and central 90 %, for each share of high masses."""
    _, _, _, pairs, _, dens, rates = _fitted(spark, d)
    return rounded(_resampled(pairs, dens, rates), "median", "p05", "p95")


def origin_decision(spark, d):
    """A detection: probable under every population, also at the low end, and rare enough by its false-alarm rate."""
    noise, live, events, pairs, _, dens, rates = _fitted(spark, d)
    low = _resampled(pairs, dens, rates).groupBy("seg", "idx").agg(F.min("median").alias("least"), F.max("median").alias("most"), F.min("p05").alias("lower"))
    one = lambda df: df.withColumn("all", F.lit(1))
    counted = far.count_louder(one(events), one(noise.withColumnRenamed("loglr", "x")), "x", ["all"], "n")
    rated = counted.crossJoin(F.broadcast(live)).select("seg", "idx", "mtot", ((F.col("n") + 1) / F.col("live_yr")).alias("far"))
    out = rated.join(low, ["seg", "idx"]).withColumn("probable", (F.col("least") >= ORIGIN.threshold) & (F.col("lower") >= ORIGIN.threshold))
    out = out.withColumn("detection", F.col("probable") & (F.col("far") <= ORIGIN.rate_threshold))
    return rounded(rounded(out, "least", "most", "lower"), "far", digits=1)


def _mock(spark, d):
    """The draws of a mock catalogue, in the fitted proportion: signals from one half of the noise, noise from all; and what they are judged by."""
    noise, _, _, _, injections, dens, rates = _fitted(spark, d)
    middle = len(ORIGIN.high_shares) // 2
    rate_s, rate_n = rates.filter(F.col("share") == middle).select("rate_s", "rate_n").first()
    n_s = int(rate_s / (rate_s + rate_n) * ORIGIN.mock)
    held = injections.filter("gated and noise_half = 1").withColumn("w", F.col(f"w{middle}") * F.col("seen")).select("inj_id", "bin", F.col("loglr").alias("x"), "w")
    signals = origin.weighted_draws(held, "w", F.floor(F.col("inj_id") / 1000), ["inj_id"], n_s, 12345)
    even = noise.select(*KEY, F.col("loglr").alias("x"), F.lit(1.0).alias("w"), F.lit(0).alias("bin"))
    noises = origin.weighted_draws(even, "w", F.col("ai") * 1000 + F.col("bi"), KEY, ORIGIN.mock - n_s, 54321)
    return noise, injections, middle, rate_s, rate_n, signals, noises


def weighted_draws(spark, d):
    """How often each injection is drawn for the mock catalogue."""
    return _mock(spark, d)[-2].select("inj_id", "drawn")


def calibration_test(spark, d):
    """Whether probabilities hold: among mock events of like probability, the share that are signals. Densities come from the half that no signal was drawn from."""
    noise, injections, middle, rate_s, rate_n, signals, noises = _mock(spark, d)
    mock = written(signals.select("bin", "x", "drawn", F.lit(1).alias("label")).unionByName(noises.select("bin", "x", "drawn", F.lit(0).alias("label"))).groupBy("bin", "x", "label").agg(F.sum("drawn").alias("drawn")))
    points = mock.select("bin", "x").distinct()
    half = origin.weighted_sample(injections.filter("gated and noise_half = 0").withColumn("w", F.col(f"w{middle}") * F.col("seen")), ["bin"], "loglr", "w")
    ps = origin.kernel_sums(points, half, ["bin", "x"], "x", "loglr", "base", []).withColumnRenamed("k", "ps")
    pn = origin.kernel_sums(points.select("x").distinct(), _noise_sample(noise), ["x"], "x", "loglr", "base", []).withColumnRenamed("k", "pn")
    known = mock.join(ps, ["bin", "x"], "left").join(pn, "x", "left").fillna(0.0, ["ps", "pn"])
    p = origin.share(F.lit(rate_s), F.col("ps"), F.lit(rate_n), F.col("pn"))
    out = known.groupBy(F.floor(p * 10).alias("bin")).agg(F.sum("drawn").alias("n"), F.sum(F.col("drawn") * F.col("label")).alias("signals")).filter("n >= 10 and bin between 0 and 9")
    return out.select("bin", F.round((F.col("bin") + 0.5) / 10, 2).alias("predicted"), F.round(F.col("signals") / F.col("n"), R).alias("realised"), "n")


QUERIES = {f.__name__: f for f in (mass_proposal, population_weights, noise_at_events, rate_fit, origin_bootstrap, origin_decision, weighted_draws, calibration_test)}

# SQL of the same rows.
_P = ORIGIN.population
_CLEAN = ", ".join((search._WIN, search._TRIG, search._PAIRS, search._NEAR, search._CLEAN))
_CASE = "CASE WHEN mtot IS NULL THEN 0 WHEN mtot < 50 THEN 0 WHEN mtot < 100 THEN 1 WHEN mtot < 200 THEN 2 ELSE 3 END"
_SHARES = len(ORIGIN.high_shares)


def _sql_smooth(m: str) -> str:
    over = f"({m} - {_P.low})"
    return f"(CASE WHEN {m} >= {_P.low + _P.turn_on} THEN 1.0::DOUBLE WHEN {m} >= {_P.low} THEN 1.0 / (exp(least(700.0, {_P.turn_on}::DOUBLE / greatest({over}, 1e-9) + {_P.turn_on}::DOUBLE / ({over} - {_P.turn_on}))) + 1.0) ELSE 0.0 END)"


def _sql_population(high: float) -> str:
    law = f"CASE WHEN m1 BETWEEN {_P.low} AND {_P.top} THEN pow(m1, -{_P.slope}::DOUBLE) ELSE 0.0 END"
    bell = f"exp(-0.5::DOUBLE * pow((m1 - {_P.peak}) / {_P.peak_width}::DOUBLE, 2)) / ({_P.peak_width}::DOUBLE * sqrt(2 * pi()))"
    first = f"(({1 - high}::DOUBLE) * ({1 - _P.peak_share}::DOUBLE * ({law}) + {_P.peak_share}::DOUBLE * {bell}) * {_sql_smooth('m1')} + {high}::DOUBLE * (CASE WHEN m1 > {_P.top} AND m1 <= {_P.highest} THEN 1.0 / m1 ELSE 0.0 END))"
    return f"({first} * (CASE WHEN m2 BETWEEN {_P.low} AND m1 THEN pow(m2 / m1, {_P.pair_slope}::DOUBLE) ELSE 0.0 END) * {_sql_smooth('m2')} / {_P.norm(high)!r}::DOUBLE)"


def _sql_spread(axis: str, source: str) -> str:
    """Every cell as the sum of its neighbours, seen from the receiving cell."""
    other = "j" if axis == "i" else "i"
    at = f"(g.k + d.d + 140) % 140"
    return f"(SELECT g.k AS {axis}, s.{other}, sum(s.n * w) AS n FROM (SELECT unnest(range(70)) AS k) g, kern d JOIN {source} s ON s.{axis} = CASE WHEN {at} >= 70 THEN 139 - {at} ELSE {at} END GROUP BY 1, 2)"


_KERN = "kern(d, w) AS (VALUES " + ", ".join(f"({d - 4}, {w!r}::DOUBLE)" for d, w in enumerate(origin.gaussian_weights(1.0))) + ")"
_MASS = f"""inj0 AS (SELECT o_orderkey AS inj_id, (10.0 + o_orderkey % 390)::DOUBLE AS mtot, 0.1::DOUBLE + 0.9::DOUBLE * ((o_orderkey * 37) % 1000) / 1000.0::DOUBLE AS q,
  o_totalprice::DOUBLE / 50000.0::DOUBLE - 3 AS loglr, o_orderkey % 5 <> 0 AS gated, (o_orderkey % 2)::INT AS noise_half FROM orders),
inj1 AS (SELECT *, mtot - m2 AS m1, {_CASE} AS bin FROM (SELECT *, mtot * q / (1 + q) AS m2 FROM inj0)),
ends AS (SELECT min(ln(m1)) - 1e-3 AS x0, (max(ln(m1)) - min(ln(m1)) + 2e-3) / 70 AS xw, min(ln(m2)) - 1e-3 AS y0, (max(ln(m2)) - min(ln(m2)) + 2e-3) / 70 AS yw FROM inj1),
placed AS (SELECT inj1.*, floor((ln(m1) - x0) / xw)::BIGINT AS i, floor((ln(m2) - y0) / yw)::BIGINT AS j FROM inj1, ends),
{_KERN}, hist AS (SELECT i, j, count(*)::DOUBLE AS n FROM placed GROUP BY ALL),
h1 AS {_sql_spread('i', 'hist')}, h2 AS {_sql_spread('j', 'h1')},
grid AS (SELECT i::BIGINT AS i, j::BIGINT AS j, (n + 1e-6) / (((SELECT sum(n) FROM h2) + 4900 * 1e-6) * xw * yw) AS density FROM h2, ends),
wts AS (SELECT inj_id, bin, gated, noise_half, loglr, {', '.join(f"{_sql_population(f)} / greatest(density / (m1 * m2), 1e-300) AS w{k}" for k, f in enumerate(ORIGIN.high_shares))} FROM placed JOIN grid USING (i, j))"""
_EVENTS = f"""clus AS (SELECT seg, idx FROM (SELECT *, sum(gap) OVER (PARTITION BY seg ORDER BY idx) AS c FROM
  (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY seg ORDER BY idx) > 4 THEN 1 ELSE 0 END AS gap FROM zero WHERE net > {ORIGIN.event_net}))
  QUALIFY row_number() OVER (PARTITION BY seg, c ORDER BY net DESC, idx) = 1),
ev AS MATERIALIZED (SELECT *, {_CASE} AS bin FROM (SELECT seg, idx, loglr AS x, CASE WHEN idx % 7 <> 0 THEN (10.0 + (seg * 37 + idx * 11) % 390)::DOUBLE END AS mtot FROM trig JOIN clus USING (seg, idx)))"""
_NOISE = f"""lt AS (SELECT sum(live_yr) AS live_yr FROM (SELECT fold, count(*) * ({FIXTURE.stride_s} * 0.5 / {search.YEAR_S})::DOUBLE AS live_yr FROM clean GROUP BY fold)),
noise AS MATERIALIZED (SELECT ai, ih, bi, il, {search._LR} AS loglr FROM (SELECT *, {search._STUB} FROM clean WHERE net >= {ORIGIN.noise_net})),
high AS (SELECT *, 1 AS tail FROM noise ORDER BY loglr DESC, ai, ih, bi, il LIMIT {ORIGIN.tail}),
bulk AS (SELECT *, 0 AS tail FROM noise ANTI JOIN high USING (ai, ih, bi, il) ORDER BY (ih * 7919 + il * 104729 + ai * 1299709 + bi * 15485863) % 1000003, ai, ih, bi, il LIMIT {ORIGIN.bulk}),
ns AS (SELECT count(*) AS n, 1.06::DOUBLE * stddev_pop(loglr) * pow(count(*)::DOUBLE, -0.2::DOUBLE) AS width FROM noise),
smp AS MATERIALIZED (SELECT b.*, width, CASE WHEN tail = 1 THEN 1.0::DOUBLE / n ELSE (n - {ORIGIN.tail}) / (n * (SELECT count(*) FROM bulk)::DOUBLE) END AS base FROM (SELECT * FROM high UNION ALL SELECT * FROM bulk) b, ns)"""
_KSUM = "sum(base * exp(-0.5::DOUBLE * pow((x - loglr) / width, 2)) / (width * sqrt(2 * pi())))"


def _sql_weighted(name: str, source: str, keys: str) -> str:
    """Rows of positive weight with base and width, for keys of 20 rows or more; the variance in one expression."""
    return f"""{name} AS MATERIALIZED (SELECT {keys}, loglr, w / sw AS base, sqrt(sum(w / sw * pow(loglr - mean, 2)) OVER (PARTITION BY {keys}) / (1 - share)) * pow(share, 0.2::DOUBLE) AS width
  FROM (SELECT *, sum(w) OVER p AS sw, sum(w * w) OVER p / pow(sum(w) OVER p, 2) AS share, sum(w * loglr) OVER p / sum(w) OVER p AS mean, count(*) OVER p AS c FROM {source} WHERE w > 0 WINDOW p AS (PARTITION BY {keys})) WHERE c >= 20)"""


_FIT = f"""x0 AS (SELECT min(loglr) AS x0 FROM (SELECT loglr FROM noise ORDER BY loglr DESC LIMIT (SELECT floor({ORIGIN.seen_rate} * live_yr)::BIGINT + 1 FROM lt))),
seen AS MATERIALIZED (SELECT wts.*, 1.0 / (1.0 + exp(-(loglr - x0) / {ORIGIN.seen_width}::DOUBLE)) AS seen FROM wts, x0),
sw AS ({' UNION ALL '.join(f'SELECT {k} AS share_no, bin, loglr, w{k} * seen AS w FROM seen WHERE gated' for k in range(_SHARES))}),
{_sql_weighted('sig', 'sw', 'share_no, bin')},
prs AS MATERIALIZED (SELECT seg, idx, ai, bi, {_KSUM} AS k FROM ev, smp GROUP BY ALL),
dens AS MATERIALIZED (SELECT seg, idx, share_no, greatest(coalesce((SELECT {_KSUM} FROM sig WHERE sig.share_no = s.share_no AND sig.bin = ev.bin), 0), 1e-300) AS ps,
  greatest((SELECT sum(k) FROM prs WHERE prs.seg = ev.seg AND prs.idx = ev.idx), 1e-300) AS pn FROM ev, (SELECT unnest(range({_SHARES}))::INT AS share_no) s),
fit AS (SELECT share_no, 0 AS pass, greatest(1.0, 0.3 * count(*))::DOUBLE AS rs, greatest(1.0, 0.7 * count(*))::DOUBLE AS rn FROM dens GROUP BY share_no UNION ALL
  SELECT share_no, pass + 1, sum(rs * ps / (rs * ps + rn * pn)), sum(rn * pn / (rs * ps + rn * pn)) FROM fit JOIN dens USING (share_no) WHERE pass < {ORIGIN.passes} GROUP BY share_no, pass),
rates AS MATERIALIZED (SELECT share_no, rs, rn FROM fit WHERE pass = {ORIGIN.passes})"""


def _sql_draw(seg: str, salt: int) -> str:
    return "(" + " + ".join(f"(((rep * 15485863 + {seg} * 104729 + {salt}) * 7919) % 1000003 / 1000003.0::DOUBLE >= {c!r}::DOUBLE)::INT" for c in origin.POISSON) + ")"


_BOOT = f"""drawn AS MATERIALIZED (SELECT seg AS s, rep, {_sql_draw('seg', 12345)} AS ch, {_sql_draw('seg', 67891)} AS cl FROM (SELECT unnest(range(8)) AS seg), (SELECT unnest(range({ORIGIN.reps})) AS rep)),
again AS (SELECT seg, idx, a.rep, sum(k * a.ch * b.cl) AS pn FROM prs JOIN drawn a ON a.s = ai JOIN drawn b ON b.s = bi AND b.rep = a.rep GROUP BY ALL),
boot AS (SELECT seg, idx, share_no, quantile_cont(p, 0.5) AS median, quantile_cont(p, 0.05) AS p05, quantile_cont(p, 0.95) AS p95 FROM
  (SELECT d.seg, d.idx, share_no, rs * ps / (rs * ps + rn * greatest(a.pn, 1e-300)) AS p FROM dens d JOIN rates USING (share_no) JOIN again a USING (seg, idx)) GROUP BY ALL)"""


def _sql_stretch(name: str, source: str, order: str, n: str, salt: int, keep: str) -> str:
    """Draws by a running sum over the whole table."""
    return f"""{name} AS MATERIALIZED (SELECT {keep}, (SELECT count(*) FROM {name}_u u WHERE u >= hi - w / total AND u < hi) AS drawn FROM
  (SELECT *, sum(w) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) / sum(w) OVER () AS hi, sum(w) OVER () AS total FROM {source} WHERE w > 0))""".replace(
        f"{name} AS MATERIALIZED", f"{name}_u AS MATERIALIZED (SELECT ((k * 15485863 + {salt}) * 7919 % 1000003 + 0.5::DOUBLE) / 1000003.0::DOUBLE AS u FROM (SELECT unnest(range({n})) AS k)),\n{name} AS MATERIALIZED", 1
    )


_MID = _SHARES // 2
_MOCK = f"""mid AS (SELECT rs, rn, floor(rs / (rs + rn) * {ORIGIN.mock})::BIGINT AS n_s FROM rates WHERE share_no = {_MID}),
held AS (SELECT inj_id, bin, loglr AS x, w{_MID} * seen AS w FROM seen WHERE gated AND noise_half = 1), even AS (SELECT *, loglr AS x, 1.0::DOUBLE AS w FROM noise),
{_sql_stretch('sd', 'held', 'inj_id', '(SELECT n_s FROM mid)', 12345, 'inj_id, bin, x')},
{_sql_stretch('nd', 'even', 'ai * 1000 + bi, ai, ih, bi, il', f'{ORIGIN.mock} - (SELECT n_s FROM mid)', 54321, '0 AS bin, x')}"""
_HEAD = f"WITH RECURSIVE {_CLEAN}, {_MASS}, {_EVENTS}, {_NOISE}, {_FIT}"
_LEAST_R = f"round(median, {R}) AS median, round(p05, {R}) AS p05, round(p95, {R}) AS p95"

ORACLES = {
    "mass_proposal": f"WITH {_MASS} SELECT i, j, round(density, 6) AS density FROM grid",
    "population_weights": f"WITH {_MASS} SELECT inj_id, bin, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM wts",
    "noise_at_events": f"WITH {_CLEAN}, {_EVENTS}, {_NOISE} SELECT seg, idx, round({_KSUM}, {R}) AS pn FROM ev, smp GROUP BY ALL",
    "rate_fit": f"{_HEAD} SELECT share_no AS share, count(*) AS n, round(any_value(rs), 4) AS rate_s, round(any_value(rn), 4) AS rate_n, round(avg(rs * ps / (rs * ps + rn * pn)), 4) AS mean_p FROM dens JOIN rates USING (share_no) GROUP BY share_no",
    "origin_bootstrap": f"{_HEAD}, {_BOOT} SELECT seg, idx, share_no AS share, {_LEAST_R} FROM boot",
    "origin_decision": f"""{_HEAD}, {_BOOT}, b AS (SELECT seg, idx, min(median) AS least, max(median) AS most, min(p05) AS lower FROM boot GROUP BY ALL),
        f AS (SELECT seg, idx, mtot, ((SELECT count(*) FROM noise WHERE loglr > x) + 1) / live_yr AS far FROM ev, lt)
        SELECT seg, idx, mtot, round(far, 1) AS far, round(least, {R}) AS least, round(most, {R}) AS most, round(lower, {R}) AS lower, least >= {ORIGIN.threshold} AND lower >= {ORIGIN.threshold} AS probable,
        least >= {ORIGIN.threshold} AND lower >= {ORIGIN.threshold} AND far <= {ORIGIN.rate_threshold} AS detection FROM f JOIN b USING (seg, idx)""",
    "weighted_draws": f"{_HEAD}, {_MOCK} SELECT inj_id, drawn FROM sd WHERE drawn > 0",
    "calibration_test": f"""{_HEAD}, {_MOCK}, hw AS (SELECT bin, loglr, w{_MID} * seen AS w FROM seen WHERE gated AND noise_half = 0), {_sql_weighted('half', 'hw', 'bin')},
        mock AS (SELECT bin, x, drawn, 1 AS label FROM sd WHERE drawn > 0 UNION ALL SELECT bin, x, drawn, 0 FROM nd WHERE drawn > 0), pt AS (SELECT DISTINCT bin, x FROM mock),
        pp AS MATERIALIZED (SELECT bin, x, greatest(coalesce((SELECT {_KSUM} FROM half WHERE half.bin = pt.bin), 0), 1e-300) AS ps, greatest((SELECT {_KSUM} FROM smp), 1e-300) AS pn FROM pt),
        j AS (SELECT mock.*, floor(rs * ps / (rs * ps + rn * pn) * 10)::BIGINT AS b FROM mock JOIN pp USING (bin, x), mid)
        SELECT b AS bin, round((b + 0.5) / 10, 2)::DOUBLE AS predicted, round(sum(drawn * label) / sum(drawn), {R}) AS realised, sum(drawn)::BIGINT AS n FROM j GROUP BY b HAVING sum(drawn) >= 10 AND b BETWEEN 0 AND 9""",
}
