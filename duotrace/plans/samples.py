"""Queries of raw samples: frames, spectra, centroids, coherence, and injections into noise."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from duotrace.operators import arrays, pairing
from duotrace.plans.catalog import _samples
from duotrace.plans.search import _WIN
from duotrace.sources import fixtures as fx

#: Samples in a block, in a frame, and from frame to frame.
BLOCK, LENGTH, STEP = 16, 8, 4
#: Lags of a measured coherence.
LAGS = 45
SIGNAL = 8


def _blocks(spark, d):
    return arrays.blocks(_samples(spark, d).select("seg", "at", F.col("value").cast("double").alias("value")), ["seg"], "at", "value", BLOCK)


def _frames(spark, d):
    return arrays.frames(_blocks(spark, d), ["seg"], BLOCK, LENGTH, STEP)


def _sum(x):
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def framed_samples(spark, d):
    """Windows of 8 samples every 4 from blocks of 16: where their middle lies, first and last sample, and energy."""
    return _frames(spark, d).select("seg", "w", (F.col("start") + LENGTH / 2.0).alias("middle"), F.round(F.col("s")[0], 4).alias("first"), F.round(F.col("s")[LENGTH - 1], 4).alias("last"), F.round(_sum(F.transform("s", lambda v: v * v)), 5).alias("energy"))


def segment_spectra(spark, d):
    """Each segment's power density by frequency: mean and median over its frames, the median kept off zero."""
    p = arrays.spectra(_frames(spark, d).select("seg", "s"), 1.0)
    out = arrays.by_element(p, ["seg"], "p", F.count("*").alias("n"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("middle"))
    out = arrays.floored(out, ["seg"], "middle")
    return out.select("seg", "bin", "n", F.round("mean", 3).alias("mean"), F.round("middle", 3).alias("middle"))


def frame_centroids(spark, d):
    """The mean frequency of each frame's power between an eighth and three eighths of the rate."""
    p = arrays.spectra(_frames(spark, d).select("seg", "w", "s"), 1.0)
    return p.select("seg", "w", F.round(arrays.centroid("p", 1.0, LENGTH, 0.125, 0.375), 5).alias("centroid"))


def _pairs(spark, d):
    trig = pairing.zero_lag(fx.windows(spark, d)).filter(F.col("net") > 2.0).select("seg", "idx")
    s = fx.series(spark, d, trig.select("seg", "idx", F.explode(F.array(F.lit("H1"), F.lit("L1"))).alias("det")))
    x, y = (s.filter(F.col("det") == det).select("seg", "idx", F.col("s").cast("array<double>").alias(n)) for det, n in (("H1", "x"), ("L1", "y")))
    return x.join(y, ["seg", "idx"])


def coherence_lags(spark, d):
    """Loud pairs' coherence at all lags of a search, by a transform."""
    return arrays.max_lag(_pairs(spark, d), "x", "y", LAGS, "coh").withColumn("coh", F.round("coh", 5))


def pearson_lags(spark, d):
    """The older form: the greatest correlation of deviations."""
    return arrays.max_lag(_pairs(spark, d), "x", "y", LAGS, "coh", pearson=True).withColumn("coh", F.round("coh", 5))


def injected_windows(spark, d):
    """Every signal laid over noise of its segment, scaled to its signal-to-noise ratio if it is projected: the best of three grid windows by energy."""
    samples = _samples(spark, d)
    stats = samples.groupBy("seg").agg(F.count("*").alias("n"), F.stddev_pop("value").alias("sd"))
    k = F.col("inj_id")
    sig = fx.injections(spark, d).select("inj_id", (k % 8).alias("seg"), "gated", F.transform(F.sequence(F.lit(0), F.lit(SIGNAL - 1)), lambda i: F.sin(math.pi * (i + 1) / (SIGNAL + 1)) * (1 + k % 5 / 10.0)).alias("h"))
    sig = sig.join(F.broadcast(stats), "seg")  # a row a segment
    # The middle of the series or a shift from it, kept inside.
    centre = F.floor(F.col("n") / 2) + F.when(k % 3 == 0, 0).otherwise((k * 7919) % (2 * F.col("n")) - F.col("n"))
    start = F.greatest(F.lit(2 * STEP), F.least(F.col("n") - 3 * STEP - SIGNAL, centre - SIGNAL // 2)).cast("long")
    own = F.sqrt(_sum(F.transform("h", lambda v: v * v))) / F.col("sd")
    scale = F.when(F.col("gated"), (8 + (k * 37) % 1700 / 100.0) / own).otherwise(1.0)
    placed = sig.withColumn("start", start).withColumn("scale", scale).withColumn("grid", F.floor(F.col("start") / STEP) - 1)
    placed = placed.withColumn("lo", F.col("grid") * STEP).withColumn("hi", F.col("lo") + 2 * STEP + LENGTH)
    whole = arrays.stretch(placed, _blocks(spark, d), "seg", ["inj_id"], BLOCK, "lo", "hi")
    mixed = whole.withColumn("x", arrays.laid_over("noise", "h", F.col("start") - F.col("lo"), F.col("scale")))
    three = mixed.select("inj_id", "start", "scale", "sd", "grid", F.posexplode(F.array(*(F.slice("x", 1 + j * STEP, LENGTH) for j in range(3)))).alias("j", "s"))
    three = three.withColumn("energy", _sum(F.transform("s", lambda v: v * v)) / (F.col("sd") * F.col("sd") * LENGTH))
    best = F.max(F.struct(F.round("energy", 6).alias("energy"), (-F.col("j")).alias("j"))).alias("best")
    out = three.groupBy("inj_id", "start", "scale", "grid").agg(best)
    return out.select("inj_id", "start", F.round("scale", 4).alias("scale"), (F.col("grid") - F.col("best.j")).alias("window"), F.round("best.energy", 2).alias("energy"))


QUERIES = {f.__name__: f for f in (framed_samples, segment_spectra, frame_centroids, coherence_lags, pearson_lags, injected_windows)}

# SQL of the same rows.
_S = """s AS MATERIALIZED (SELECT user_id % 8 AS seg, value::DOUBLE AS v, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) - 1 AS pos FROM events)"""
_F = f"""{_S}, f AS MATERIALIZED (SELECT a.seg, a.pos // {STEP} AS w, a.pos, array_agg(b.v ORDER BY b.pos) AS x FROM s a JOIN s b ON b.seg = a.seg AND b.pos BETWEEN a.pos AND a.pos + {LENGTH - 1}
  WHERE a.pos % {STEP} = 0 GROUP BY ALL HAVING count(*) = {LENGTH})"""
_HANN = "(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * (i - 1) / 8))"
_DFT = f"""z AS (SELECT seg, w, list_transform(range(1, 9), lambda i: (x[i] - list_avg(x)) * {_HANN}) AS z FROM f),
p AS MATERIALIZED (SELECT seg, w, k AS bin, (CASE WHEN k BETWEEN 1 AND 3 THEN 2 ELSE 1 END) * (pow(list_sum(list_transform(range(1, 9), lambda i: z[i] * cos(2 * pi() * k * (i - 1) / 8))), 2) + pow(list_sum(list_transform(range(1, 9), lambda i: z[i] * sin(2 * pi() * k * (i - 1) / 8))), 2))
  / list_sum(list_transform(range(1, 9), lambda i: pow({_HANN}, 2))) AS p FROM z, (SELECT unnest(range(5))::INT AS k))"""
_XY = """k AS (SELECT seg, idx, (seg * 131 + idx * 17) % 500 AS vh, (seg * 131 + idx * 17 + 7) % 500 AS vl FROM zero WHERE net > 2.0),
q AS (SELECT seg, idx, h.embedding::DOUBLE[] AS x, l.embedding::DOUBLE[] AS y FROM k JOIN embeddings h ON h.vec_id = vh JOIN embeddings l ON l.vec_id = vl)"""
_LAGGED = f"list_max(list_transform(range(-{LAGS}, {LAGS + 1}), lambda d: abs(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * y[((i - 1 - d + 2 * len(y)) % len(y)) + 1])))))"
_SQ = "list_sum(list_transform({v}, lambda a: a * a))"

ORACLES = {
    "framed_samples": f"WITH {_F} SELECT seg, w, (pos + 4.0)::DOUBLE AS middle, round(x[1], 4) AS first, round(x[8], 4) AS last, round(list_sum(list_transform(x, lambda v: v * v)), 5) AS energy FROM f",
    "segment_spectra": f"WITH {_F}, {_DFT}, a AS (SELECT seg, bin, count(*) AS n, avg(p) AS mean, quantile_cont(p, 0.5) AS middle FROM p GROUP BY ALL) SELECT seg, bin, n, round(mean, 3) AS mean, round(greatest(middle, 1e-10 * quantile_cont(middle, 0.5) OVER (PARTITION BY seg)), 3) AS middle FROM a",
    "frame_centroids": f"WITH {_F}, {_DFT} SELECT seg, w, round(sum(p * bin / 8.0::DOUBLE) / sum(p), 5) AS centroid FROM p WHERE bin BETWEEN 1 AND 3 GROUP BY ALL",
    "coherence_lags": f"WITH {_WIN.strip()}, {_XY} SELECT seg, idx, round(2 * {_LAGGED} / ({_SQ.format(v='x')} + {_SQ.format(v='y')} + 1e-30), 5) AS coh FROM q",
    "pearson_lags": f"""WITH {_WIN.strip()}, {_XY}, c AS (SELECT seg, idx, list_transform(x, lambda a: a - list_avg(x)) AS x, list_transform(y, lambda a: a - list_avg(y)) AS y FROM q)
        SELECT seg, idx, round({_LAGGED} / ((sqrt({_SQ.format(v='x')}) + 1e-12) * (sqrt({_SQ.format(v='y')}) + 1e-12)), 5) AS coh FROM c""",
    "injected_windows": f"""WITH {_S}, st AS (SELECT seg, count(*) AS n, stddev_pop(v) AS sd FROM s GROUP BY seg),
        i AS (SELECT o_orderkey AS inj_id, o_orderkey % 8 AS seg, o_orderkey % 5 <> 0 AS gated, n, sd, (n // 2) + CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE (o_orderkey * 7919) % (2 * n) - n END AS centre,
          list_transform(range(8), lambda j: sin(pi() * (j + 1) / 9) * (1 + (o_orderkey % 5) / 10.0::DOUBLE)) AS h FROM orders JOIN st ON st.seg = o_orderkey % 8),
        b AS (SELECT *, greatest(8, least(n - 20, centre - 4)) AS start, CASE WHEN gated THEN (8 + ((inj_id * 37) % 1700) / 100.0::DOUBLE) / (sqrt(list_sum(list_transform(h, lambda a: a * a))) / sd) ELSE 1.0 END AS scale FROM i),
        e AS (SELECT inj_id, start, scale, j, start // 4 - 1 + j AS g, sum(pow(v + CASE WHEN pos BETWEEN start AND start + 7 THEN h[pos - start + 1] * scale ELSE 0 END, 2)) / (any_value(sd) * any_value(sd) * 8) AS energy
          FROM b, (SELECT unnest(range(3)) AS j) JOIN s ON s.seg = b.seg AND s.pos BETWEEN (start // 4 - 1 + j) * 4 AND (start // 4 - 1 + j) * 4 + 7 GROUP BY ALL)
        SELECT inj_id, start, round(scale, 4) AS scale, g AS "window", round(round(energy, 6), 2) AS energy FROM e QUALIFY row_number() OVER (PARTITION BY inj_id ORDER BY round(energy, 6) DESC, j) = 1""",
}
