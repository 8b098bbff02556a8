"""Probability of origin: what share of a score's events is signal, with its uncertainty and a test of it.

Signal and noise densities are found at the events' scores, two rates are fitted to them, segments are resampled, and a
mock catalogue drawn from known labels tells whether the probabilities hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duotrace.sources.tables import written

#: A density is never less, so that its logarithm and shares exist.
TINY = 1e-300
#: Kernels are cut at this many widths: at most exp(-40.5) / (width * sqrt(2 pi)) of a density is lost, 1.1e-18 / width, so that
#: no share of origin that isn't 1 becomes 1.
RADIUS = 9.0
#: A cell's width in kernel widths, and the terms of its rows' expansion. At most RADIUS + STEP of them away from a cell's centre, and its rows STEP / 2, the
#: exponent that is expanded is at most 2.4, and what is left out 2e-15 of a row's kernel (less than a sum's rounding).
STEP, TERMS = 0.5, 24
#: Chances that a Poisson variable of mean 1 is at most 0, 1, .. 9; beyond lies less than the grid of the draws (a millionth).
POISSON = tuple(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(10))


@dataclass(frozen=True)
class Population:
    """Fixed values of the mass model: a power law with a peak, and beyond `top` a part of share `high` flat in the logarithm."""

    slope: float = 3.5
    low: float = 5.0
    top: float = 88.0
    peak_share: float = 0.038
    peak: float = 34.0
    peak_width: float = 3.6
    turn_on: float = 4.8
    pair_slope: float = 1.1
    highest: float = 350.0

    def smooth(self, m: Column) -> Column:
        """The turn-on from `low` to `low` + `turn_on`."""
        over = m - self.low
        steep = F.least(F.lit(700.0), self.turn_on / F.greatest(over, F.lit(1e-9)) + self.turn_on / (over - self.turn_on))
        return F.when(m >= self.low + self.turn_on, 1.0).when(m >= self.low, 1.0 / (F.exp(steep) + 1.0)).otherwise(0.0)

    def density(self, m1: Column, m2: Column, high: float) -> Column:
        """Of both masses, not normalised: the mix of both parts for the larger mass, times the smaller one's given it."""
        bell = F.exp(-0.5 * F.pow((m1 - self.peak) / self.peak_width, F.lit(2.0))) / (self.peak_width * math.sqrt(2 * math.pi))
        law = F.when((m1 >= self.low) & (m1 <= self.top), F.pow(m1, F.lit(-self.slope))).otherwise(0.0)
        first = (1 - high) * ((1 - self.peak_share) * law + self.peak_share * bell) * self.smooth(m1) + high * F.when((m1 > self.top) & (m1 <= self.highest), 1.0 / m1).otherwise(0.0)
        second = F.when((m2 >= self.low) & (m2 <= m1), F.pow(m2 / F.greatest(m1, F.lit(1e-9)), F.lit(self.pair_slope))).otherwise(0.0) * self.smooth(m2)
        return first * second

    def norm(self, high: float, cells: int = 400) -> float:
        """The density's sum over a grid even in the logarithms: a number of the model alone, no data."""
        m = np.exp(np.linspace(np.log(self.low), np.log(self.highest), cells))
        over = m - self.low
        with np.errstate(divide="ignore", over="ignore"):
            rise = np.where(over >= self.turn_on, 1.0, 1 / (np.exp(np.minimum(700.0, self.turn_on / np.maximum(over, 1e-9) + self.turn_on / np.where(over == self.turn_on, -1e-9, over - self.turn_on))) + 1))
        bell = np.exp(-0.5 * ((m - self.peak) / self.peak_width) ** 2) / (self.peak_width * np.sqrt(2 * np.pi))
        first = (1 - high) * ((1 - self.peak_share) * np.where(m <= self.top, m**-self.slope, 0) + self.peak_share * bell) * rise + high * np.where(m > self.top, 1 / m, 0)
        ratio = m[None, :] / m[:, None]
        side = m * np.gradient(np.log(m))
        return float(((first * side)[:, None] * np.where(ratio <= 1, ratio**self.pair_slope, 0) * (rise * side)[None, :]).sum())


def gaussian_weights(sigma: float) -> list[float]:
    """A Gaussian's weights at whole steps, out to four deviations, summing to 1."""
    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-reach, reach + 1)]
    return [w / sum(raw) for w in raw]


def _spread(grid: DataFrame, axis: str, cells: int, sigma: float) -> DataFrame:
    """One axis of the smoothing: every cell goes to its neighbours, mirrored at the borders, and they are summed."""
    weights = gaussian_weights(sigma)
    reach = len(weights) // 2
    out = grid.select("*", F.posexplode(F.array(*map(F.lit, weights))).alias("_d", "_w"))
    to = F.pmod(F.col(axis) + F.col("_d") - reach, F.lit(2 * cells))
    return out.withColumn(axis, F.when(to >= cells, 2 * cells - 1 - to).otherwise(to).cast("long")).groupBy("i", "j").agg(F.sum(F.col("n") * F.col("_w")).alias("n"))


def proposal_density(rows: DataFrame, x: Column, y: Column, cells: int = 70, sigma: float = 1.0, floor: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(rows with cell i, j; the grid i, j, density): where rows lie in the plane of x and y.

    A histogram of cells x cells over the rows' own range, smoothed by a Gaussian along either axis in turn. Each cell is
    given to its neighbours and summed again, so nothing but the grid is shuffled, however many rows there are. `floor` is
    added to every cell; the density integrates to 1. Cells that no row reaches have the floor alone and aren't listed.
    """
    ends = rows.agg(*(f(c).cast("double").alias(n) for c, k in ((x, "x"), (y, "y")) for f, n in ((F.min, f"{k}0"), (F.max, f"{k}1"))))
    ends = ends.select(*((F.col(f"{k}0") - 1e-3).alias(f"{k}0") for k in "xy"), *(((F.col(f"{k}1") - F.col(f"{k}0") + 2e-3) / cells).alias(f"{k}w") for k in "xy"))
    placed = rows.crossJoin(F.broadcast(ends))  # one row of ends
    placed = placed.withColumn("i", F.floor((x - F.col("x0")) / F.col("xw"))).withColumn("j", F.floor((y - F.col("y0")) / F.col("yw"))).drop("x0", "y0", "xw", "yw")
    grid = placed.groupBy("i", "j").agg(F.count("*").cast("double").alias("n"))
    grid = _spread(_spread(grid, "i", cells, sigma), "j", cells, sigma)
    total = grid.agg(F.sum("n").alias("total")).crossJoin(ends)
    return placed, grid.crossJoin(F.broadcast(total)).select("i", "j", ((F.col("n") + floor) / ((F.col("total") + floor * cells * cells) * F.col("xw") * F.col("yw"))).alias("density"))


def stratified_noise(noise: DataFrame, score: str, key: list[str], mark: Column, tail: int, bulk: int) -> DataFrame:
    """The `tail` highest scores, and of the rest `bulk` of least mark, each with the share `base` of all noise that it stands for; width is the kernel's.

    Two limits with partial sorts, so no task holds more than a limit's rows; the shares sum to 1.
    """
    high = written(noise.orderBy(F.desc(score), *key).limit(tail).select(*key, score))
    rest = noise.select(*key, score).join(high.select(*key), key, "left_anti").withColumn("_mark", mark).orderBy("_mark", *key).limit(bulk).select(*key, score)
    sums = noise.agg(F.count("*").alias("n"), (1.06 * F.stddev_pop(score) * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("width"))
    rest = written(rest)
    few = rest.agg(F.count("*").alias("few"))
    sample = high.withColumn("_tail", F.lit(True)).unionByName(rest.withColumn("_tail", F.lit(False)))
    base = F.when(F.col("_tail"), 1.0 / F.col("n")).otherwise((F.col("n") - tail) / (F.col("n") * F.col("few")))
    return sample.crossJoin(F.broadcast(sums.crossJoin(few))).select(*key, score, base.alias("base"), "width")  # one row of sums


def kernel_sums(points: DataFrame, sample: DataFrame, by: list[str], x: str, value: str, weight: str, groups: list[str], radius: float = RADIUS) -> DataFrame:
    """by, groups, k: the weighted Gaussian kernels of the sample's rows at each point, summed by the sample's `groups`.

    points: by (which may hold keys that the sample has too), x. sample: those keys, value, weight, width (one a key), groups. Rows
    beyond the radius are left out: see RADIUS for what that loses. A point with no row near has no row.

    Without groups, points meet `expansions`, a row a cell, so the sample's rows cost one pass, however many they are. With groups, which
    split a sample into small parts (samples of a given size), they meet rows: both are dealt to cells of `radius` widths; a point looks
    into its own and the two next to it, in an equi-join.
    """
    keys = [c for c in by if c in sample.columns]
    widths = sample.groupBy(*keys).agg(F.first("width").alias("_width")) if keys else sample.agg(F.first("width").alias("_width"))
    wide = points.join(F.broadcast(widths), keys) if keys else points.crossJoin(F.broadcast(widths))  # a row a key
    if not groups:
        step, reach = STEP * F.col("_width"), math.ceil(radius / STEP)
        here = F.floor(F.col(x) / step)
        met = wide.select(*by, x, F.explode(F.sequence(here - reach, here + reach)).alias("_cell")).join(expansions(sample, keys, value, weight), [*keys, "_cell"])
        z = (F.col(x) - F.col("_centre")) / F.col("_width")
        series = reduce(lambda above, k: F.col(f"_m{k}") + above * (z / (k + 1)), reversed(range(TERMS - 1)), F.col(f"_m{TERMS - 1}"))
        return met.groupBy(*by).agg(F.sum(series * F.exp(-0.5 * z * z) / (F.col("_width") * math.sqrt(2 * math.pi))).alias("k"))
    near = sample.withColumn("_cell", F.floor(F.col(value) / (radius * F.col("width"))))
    here = F.floor(F.col(x) / (radius * F.col("_width")))
    wide = wide.select(*by, x, F.explode(F.sequence(here - 1, here + 1)).alias("_cell"))
    met = wide.join(near, [*keys, "_cell"]).withColumn("_z", (F.col(x) - F.col(value)) / F.col("width")).filter(F.abs("_z") <= radius)
    return met.groupBy(*by, *groups).agg(F.sum(F.col(weight) * F.exp(-0.5 * F.col("_z") * F.col("_z")) / (F.col("width") * math.sqrt(2 * math.pi))).alias("k"))


def expansions(sample: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """keys, _cell, _centre, _width, _m0, _m1, ..: each cell's rows as coefficients of a series that gives the sum of their kernels anywhere near.

    A row u widths from its cell's centre has the kernel exp(-(z - u)^2 / 2) = exp(-z^2 / 2) * exp(-u^2 / 2) * exp(z u) at a point z
    widths from it, and the last factor is the sum of z^k / k! * u^k; so a cell's rows enter by the sums of weight * exp(-u^2 / 2) * u^k.
    """
    placed = sample.select(*keys, F.col(value).alias("_v"), F.col(weight).alias("_w"), F.col("width").alias("_width")).withColumn("_cell", F.floor(F.col("_v") / (STEP * F.col("_width"))))
    placed = placed.withColumn("_centre", (F.col("_cell") + 0.5) * STEP * F.col("_width"))
    placed = placed.withColumn("_u", (F.col("_v") - F.col("_centre")) / F.col("_width"))
    placed = placed.withColumn("_e", F.col("_w") * F.exp(-0.5 * F.col("_u") * F.col("_u")))
    sums = [F.sum(F.col("_e") * F.pow("_u", F.lit(float(k)))).alias(f"_m{k}") for k in range(TERMS)]
    return placed.groupBy(*keys, "_cell").agg(F.first("_centre").alias("_centre"), F.first("_width").alias("_width"), *sums)


def weighted_sample(rows: DataFrame, keys: list[str], value: str, weight: str, least: int = 20) -> DataFrame:
    """keys, value, base (weights that sum to 1 a key), width (Scott's rule for the effective count), for keys of `least` rows of positive weight."""
    rows = rows.filter(F.col(weight) > 0).select(*keys, value, weight)
    w, v = F.col(weight), F.col(value)
    mean = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum(w).alias("_w"), (F.sum(w * w) / F.pow(F.sum(w), F.lit(2.0))).alias("_share"), (F.sum(w * v) / F.sum(w)).alias("_mean")).filter(F.col("_n") >= least)
    joined = rows.join(F.broadcast(mean), keys)  # a row a key
    spread = joined.groupBy(*keys).agg((F.sum(w * F.pow(v - F.col("_mean"), F.lit(2.0))) / F.first("_w") / (1 - F.first("_share"))).alias("_spread"))
    return joined.join(F.broadcast(spread), keys).select(*keys, value, (w / F.col("_w")).alias("base"), (F.sqrt("_spread") * F.pow("_share", F.lit(0.2))).alias("width"))


def fit_rates(rows: DataFrame, key: str, signal: str = "ps", noise: str = "pn", passes: int = 25, tolerance: float = 0.0) -> DataFrame:
    """key, rate_s, rate_n: the rates of signal and noise that make each key's events likeliest, from both densities of every event.

    Expectation and maximisation: a pass adds up the events' probabilities of either origin, two sums with map-side
    combine, and these are the next rates. The likelihood has one maximum and rises with every pass. It ends after
    `passes`, or once no rate moves by more than `tolerance`. Only the keys' two numbers come to the driver.
    """
    rows = written(rows.select(key, F.greatest(F.col(signal), F.lit(TINY)).alias("_s"), F.greatest(F.col(noise), F.lit(TINY)).alias("_n")))
    spark = rows.sparkSession
    kind = rows.schema[key].dataType.simpleString()
    now = {r[0]: (max(1.0, 0.3 * r[1]), max(1.0, 0.7 * r[1])) for r in rows.groupBy(key).count().collect()}
    table = lambda: spark.createDataFrame([(k, *v) for k, v in now.items()], f"{key} {kind}, rate_s double, rate_n double")
    for _ in range(passes):
        s, n = F.col("rate_s") * F.col("_s"), F.col("rate_n") * F.col("_n")
        new = {r[0]: (r[1], r[2]) for r in rows.join(F.broadcast(table()), key).groupBy(key).agg(F.sum(s / (s + n)), F.sum(n / (s + n))).collect()}
        moved = max((abs(a - b) for k in now for a, b in zip(now[k], new[k])), default=0.0)
        now = new
        if moved <= tolerance:
            break
    return table()


def poisson_draw(rep: Column, key: Column, salt: int) -> Column:
    """A Poisson number of mean 1 that depends on repetition and key alone, so that any engine draws the same."""
    u = ((rep.cast("long") * 15485863 + key * 104729 + salt) * 7919) % 1000003 / 1000003.0
    return sum((F.when(u >= c, 1).otherwise(0) for c in POISSON), F.lit(0))


def resampled(kernels: DataFrame, by: list[str], first: str, second: str, reps: int) -> DataFrame:
    """by, rep, k: the kernel sums with both segments of every row drawn anew, their counts multiplied.

    kernels: by, first, second, k, already summed a pair of segments; so pairs are repeated, never rows.
    """
    each = kernels.select("*", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    weight = poisson_draw(F.col("rep"), F.col(first), 12345) * poisson_draw(F.col("rep"), F.col(second), 67891)
    return each.groupBy(*by, "rep").agg(F.sum(F.col("k") * weight).alias("k"))


def resampled_shares(events: DataFrame, kernels: DataFrame, by: list[str], first: str, second: str, reps: int, quantiles: dict[str, float]) -> DataFrame:
    """by, share and quantiles of the probability of a signal's origin over repetitions in which segments are drawn anew, as in `resampled`.

    events: by, share, ps, rate_s, rate_n; kernels: by, first, second, k, summed a pair of segments. An event's sums and shares become
    a row; a task takes some events at a time, multiplies their sums by the pairs' counts and keeps only the quantiles, so that
    no row a repetition is ever made. A task holds a matrix of counts of pairs by repetitions.
    """
    sums = kernels.groupBy(*by).agg(F.collect_list(F.struct(F.col(first).cast("long").alias("a"), F.col(second).cast("long").alias("b"), "k")).alias("pairs"))
    each = events.groupBy(*by).agg(F.collect_list(F.struct("share", "ps", "rate_s", "rate_n")).alias("shares")).join(sums, by, "left")
    each = each.select(*by, *(F.col(f"pairs.{c}").alias(f"_{c}") for c in "abk"), *(F.col(f"shares.{c}").alias(c) for c in ("share", "ps", "rate_s", "rate_n")))
    kind = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in [*by, "share"]) + "".join(f", {n} double" for n in quantiles)
    names = list(quantiles)

    def count(key: int, salt: int) -> np.ndarray:
        u = ((np.arange(reps, dtype=np.int64) * 15485863 + key * 104729 + salt) * 7919) % 1000003 / 1000003.0
        return (u[:, None] >= np.array(POISSON)).sum(axis=1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place: dict[tuple[int, int], int] = {}
        counts = np.zeros((0, reps))
        for frame in frames:
            for start in range(0, len(frame), 256):
                part = frame.iloc[start : start + 256]
                pairs = [[] if a is None else list(zip(a, b)) for a, b in zip(part["_a"], part["_b"])]
                new = sorted({p for row in pairs for p in row} - place.keys())
                place.update({p: len(place) + k for k, p in enumerate(new)})
                counts = np.vstack([counts, *(count(int(a), 12345) * count(int(b), 67891) for a, b in new)])
                held = np.zeros((len(part), len(place)))
                for e, (row, k) in enumerate(zip(pairs, part["_k"])):
                    if row:
                        held[e, [place[p] for p in row]] = k
                noise = np.maximum(held @ counts, TINY)
                at = np.repeat(np.arange(len(part)), [len(x) for x in part["share"]])
                ps, rate_s, rate_n = (np.concatenate(part[c].to_numpy()).astype(float)[:, None] for c in ("ps", "rate_s", "rate_n"))
                s = rate_s * np.maximum(ps, TINY)
                found = np.quantile(s / (s + rate_n * noise[at]), [quantiles[n] for n in names], axis=1)
                yield pd.DataFrame({**{c: part[c].to_numpy()[at] for c in by}, "share": np.concatenate(part["share"].to_numpy()), **dict(zip(names, found))})

    return each.mapInPandas(run, kind)


def share(rate_s: Column, ps: Column, rate_n: Column, pn: Column) -> Column:
    """The probability of a signal's origin."""
    s, n = rate_s * F.greatest(ps, F.lit(TINY)), rate_n * F.greatest(pn, F.lit(TINY))
    return s / (s + n)


def weighted_draws(rows: DataFrame, weight: str, bucket: Column, order: list[str], n: int, salt: int) -> DataFrame:
    """n draws with replacement in proportion to weight: the rows drawn, with `drawn`, how often.

    Running sums without a global window: sums of buckets first (a row each), then inside buckets, which must follow one
    another in `order`. Rows then hold stretches of 0 to 1, and draws are points there, from an arithmetic hash. Both are
    dealt to n cells. A stretch stands in every cell that it touches, so both sides meet in an equi-join whose input is at
    most rows and cells together, also where one row has most of the weight.
    """
    rows = rows.filter(F.col(weight) > 0).withColumn("_bucket", bucket)
    sums = rows.groupBy("_bucket").agg(F.sum(weight).alias("_sum"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_before"), F.sum("_sum").over(Window.partitionBy()).alias("_total"))  # a row a bucket
    inside = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cell = lambda c: F.least(F.floor(c * n), F.lit(n - 1))
    placed = rows.join(sums, "_bucket").withColumn("_hi", (F.col("_before") + F.sum(weight).over(inside)) / F.col("_total"))
    placed = placed.withColumn("_lo", F.col("_hi") - F.col(weight) / F.col("_total"))
    placed = placed.withColumn("_cell", F.explode(F.sequence(cell(F.greatest("_lo", F.lit(0.0))), cell(F.col("_hi")))))
    u = (((F.col("id") * 15485863 + salt) * 7919) % 1000003 + 0.5) / 1000003.0
    points = rows.sparkSession.range(n).select(u.alias("_u")).withColumn("_cell", cell(F.col("_u")))
    met = placed.join(points, "_cell").filter((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    return met.groupBy(*(c for c in rows.columns if c != "_bucket")).agg(F.count("*").alias("drawn"))
