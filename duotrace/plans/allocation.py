"""Queries of allocation and efficiency: strata with quotas, splits, efficiencies at a rate with intervals, bands over searches."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from duotrace.functions import stats
from duotrace.operators import allocation, ranking
from duotrace.plans.sensitivity import _INJ, EDGES, _bin, _horizon, _inj
from duotrace.sources import fixtures as fx

R = 5
MASSES, SHAPES = len(EDGES), 3
#: Share of the signals that is chosen; above 1, some come more than once.
SHARES = {"stratified_choice": 0.6, "stratified_fill": 1.25}
VAL, TEST = 0.15, 0.1
#: False alarms a year at which efficiencies are read off, and the years of noise.
RATE, YEARS = 1000.0, 0.5
SEARCHES = 6


def _cells(spark, d):
    """Signals by mass and mass ratio; those of a ratio below 0.15 are in no cell."""
    shape = F.when(F.col("q") >= 0.7, 2).when(F.col("q") >= 0.4, 1).when(F.col("q") >= 0.15, 0)
    return _inj(spark, d).select("inj_id", (_bin() * SHAPES + shape).alias("cell"))


def _stratified(share):
    def run(spark, d):
        rows = _cells(spark, d)
        return allocation.stratified(rows, "cell", MASSES * SHAPES, "inj_id", int(rows.count() * share))

    return run


def fraction_split(spark, d):
    """Every customer's part of a split by fractions, none of which is empty."""
    return allocation.split(fx.table(spark, d, "customer").select(F.col("c_custkey").alias("source")), "source", VAL, TEST)


def efficiency_at_rate(spark, d):
    """By mass: the share of signals found at the score whose false alarms come RATE times a year and at the loudest noise, the first with its exact 95% interval."""
    noise = _inj(spark, d).filter("noise_half = 0 and not gated").withColumn("score", F.round("loglr", 2))
    curve = ranking.running_total(noise, "score", 0.5, n=F.lit(1)).select("score", ((F.col("n") + F.col("n_above")) / YEARS).alias("far"))
    cut = curve.agg(F.max("score").alias("loudest"), F.min(F.when(F.col("far") <= RATE, F.col("score"))).alias("at_rate"))
    cut = cut.select("loudest", F.coalesce("at_rate", "loudest").alias("at_rate"))  # one row
    signals = _inj(spark, d).filter("noise_half = 1").select(_bin(), "gated", F.round("loglr", 2).alias("score")).join(F.broadcast(cut))
    found = lambda c: F.count_if(F.col("gated") & (F.col("score") >= F.col(c)))
    out = signals.groupBy("bin").agg(F.count("*").alias("n"), found("at_rate").alias("n_found"), found("loudest").alias("n_loudest"))
    share = lambda c: F.round(F.col(c) / F.col("n"), R)
    out = stats.with_share_interval(out, "n_found", "n")
    return out.select("bin", "n", "n_found", share("n_found").alias("efficiency"), F.round("low", R).alias("low"), F.round("high", R).alias("high"), share("n_loudest").alias("efficiency_loudest"))


def volume_band(spark, d):
    """By mass: the least and the greatest volume over several searches, each of which finds its own share of the signals."""
    search = (F.col("inj_id") * 31 % SEARCHES).alias("search")
    vol = F.avg(4.0 / 3.0 * math.pi * F.pow(_horizon(), F.lit(3.0))) / 1e6
    found = F.count_if(F.col("gated") & (F.col("loglr") > 1.0)) / F.count("*")
    each = _inj(spark, d).groupBy(search, _bin()).agg((found * vol).alias("v"))
    return each.groupBy("bin").agg(F.count("*").alias("searches"), F.round(F.min("v"), 4).alias("least"), F.round(F.max("v"), 4).alias("greatest"))


def mask_union(spark, d):
    """Each segment's counts by kind from two runs; where both have a kind, the later run's."""
    e = fx.table(spark, d, "events").select((F.col("user_id") % 8).alias("seg"), "event_type", (F.floor(F.col("user_id") / 8) % 2).alias("run"))
    # The first run lacks odd kinds of even segments, the second even kinds of odd ones.
    e = e.filter(~((F.length("event_type") + F.col("seg") + F.col("run")) % 4 == 1))
    per = e.groupBy("seg", "run", "event_type").agg(F.count("*").alias("n"))
    entries = lambda k: F.map_from_entries(F.collect_list(F.when(F.col("run") == k, F.struct("event_type", "n"))))
    both = per.groupBy("seg").agg(entries(0).alias("old"), entries(1).alias("new"))
    return both.select("seg", F.explode(allocation.union_right_wins(F.col("old"), F.col("new"))).alias("kind", "n"))


QUERIES = {name: _stratified(share) for name, share in SHARES.items()} | {f.__name__: f for f in (fraction_split, efficiency_at_rate, volume_band, mask_union)}

# SQL of the same rows.
_CELL = f"""{_INJ}, c AS (SELECT inj_id, bin * {SHAPES} + CASE WHEN q >= 0.7::DOUBLE THEN 2 WHEN q >= 0.4::DOUBLE THEN 1 WHEN q >= 0.15::DOUBLE THEN 0 END AS cell FROM inj)"""


def _sql(share: float) -> str:
    n = MASSES * SHAPES
    mark = lambda x, salt: f"({x} * {salt} + 1) % {allocation.MARKS}"
    return f"""{_CELL}, k AS (SELECT floor(count(*) * {share}::DOUBLE)::BIGINT AS count, count(*) AS total FROM c),
        a AS (SELECT inj_id FROM c, k WHERE cell IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cell ORDER BY {mark("inj_id", 7919)}, inj_id) <= count // {n} + (cell < count % {n})::INT),
        b AS (SELECT inj_id FROM c, k WHERE cell IS NOT NULL AND inj_id NOT IN (FROM a) QUALIFY row_number() OVER (ORDER BY {mark("inj_id", 104729)}, inj_id) <= count - (SELECT count(*) FROM a)),
        p AS (SELECT inj_id, row_number() OVER (ORDER BY {mark("inj_id", 7919)}, inj_id) - 1 AS place FROM c),
        w AS (SELECT {mark("i", 15485863)} * total // {allocation.MARKS} AS place FROM (SELECT unnest(range((SELECT count FROM k) - (SELECT count(*) FROM a) - (SELECT count(*) FROM b))) AS i), k)
        SELECT inj_id, 'cell' AS how, 1 AS times FROM a UNION ALL SELECT inj_id, 'left', 1 FROM b UNION ALL SELECT inj_id, 'fill', count(*) FROM p JOIN w USING (place) GROUP BY inj_id"""


#: A bound of an exact interval, by halving 60 times: the share at which k or fewer (or k - 1 or fewer) of n have the given chance.
def _bound(name: str, k: str, chance: float) -> str:
    cdf = f"list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(mid) + (n - i) * ln(1 - mid)) FOR i IN range({k} + 1)])"
    return f"""{name} AS (SELECT bin, n, n_found, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM e WHERE {k} BETWEEN 0 AND n - 1 UNION ALL
        SELECT bin, n, n_found, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END, step + 1 FROM
        (SELECT *, {cdf} > {chance} AS up FROM (SELECT *, (lo + hi) / 2 AS mid FROM {name} WHERE step < 60)))"""


ORACLES = {name: _sql(share) for name, share in SHARES.items()} | {
    "fraction_split": f"""SELECT c_custkey AS source, CASE WHEN place < greatest(1, floor(n * {TEST}::DOUBLE)) THEN 'test' WHEN place < greatest(1, floor(n * {TEST}::DOUBLE)) + greatest(1, floor(n * {VAL}::DOUBLE)) THEN 'val' ELSE 'train' END AS split
        FROM (SELECT c_custkey, count(*) OVER () AS n, row_number() OVER (ORDER BY (c_custkey * 7919 + 1) % {allocation.MARKS}, c_custkey) - 1 AS place FROM customer)""",
    "efficiency_at_rate": _INJ.replace("WITH ", "WITH RECURSIVE ", 1) + f""", z AS (SELECT round(loglr, 2) AS score FROM inj WHERE noise_half = 0 AND NOT gated), f AS (SELECT score, count(*) OVER (ORDER BY score DESC) / {YEARS}::DOUBLE AS far FROM z),
        t AS (SELECT max(score) AS loudest, coalesce(min(score) FILTER (far <= {RATE}), max(score)) AS at_rate FROM f),
        e AS MATERIALIZED (SELECT bin, count(*) AS n, count(*) FILTER (gated AND round(loglr, 2) >= at_rate) AS n_found, count(*) FILTER (gated AND round(loglr, 2) >= loudest) AS n_loudest FROM inj, t WHERE noise_half = 1 GROUP BY bin),
        {_bound("lows", "n_found - 1", 0.975)}, {_bound("highs", "n_found", 0.025)}
        SELECT e.bin, e.n, e.n_found, round(e.n_found / e.n, {R}) AS efficiency, round(coalesce(l.lo, 0.0), {R}) AS low, round(coalesce(h.lo, 1.0), {R}) AS high, round(n_loudest / e.n, {R}) AS efficiency_loudest
        FROM e LEFT JOIN (FROM lows WHERE step = 60) l USING (bin) LEFT JOIN (FROM highs WHERE step = 60) h USING (bin)""",
    "volume_band": _INJ + f""", v AS (SELECT inj_id * 31 % {SEARCHES} AS search, bin, count(*) FILTER (gated AND loglr > 1) / count(*) * avg(4.0::DOUBLE / 3.0::DOUBLE * pi() * pow(dh, 3)) / 1e6 AS v FROM inj GROUP BY ALL)
        SELECT bin, count(*) AS searches, round(min(v), 4) AS least, round(max(v), 4) AS greatest FROM v GROUP BY bin""",
    "mask_union": """WITH p AS (SELECT user_id % 8 AS seg, user_id // 8 % 2 AS run, event_type AS kind, count(*) AS n FROM events WHERE NOT (length(event_type) + user_id % 8 + user_id // 8 % 2) % 4 = 1 GROUP BY ALL)
        SELECT seg, kind, n FROM p QUALIFY row_number() OVER (PARTITION BY seg, kind ORDER BY run DESC) = 1""",
}
