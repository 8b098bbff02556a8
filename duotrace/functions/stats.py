"""Special functions that Spark lacks, and tables of them to join."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def poisson_cdf(n: int, mean: float) -> float:
    """P(X <= n); terms by recurrence from the largest, so that no factorial overflows."""
    if mean <= 0:
        return 1.0
    return math.fsum(math.exp(-mean + k * math.log(mean) - math.lgamma(k + 1)) for k in range(n + 1))


def _solve(f, low: float, high: float) -> float:
    """The zero of a falling function."""
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) > 0 else (low, mid)
    return (low + high) / 2


def poisson_upper(n: int, confidence: float = 0.90) -> float:
    """The mean at which n or fewer counts have probability 1 - confidence."""
    return _solve(lambda m: poisson_cdf(n, m) - (1 - confidence), 0.0, n + 20 + 10 * math.sqrt(n + 1))


def garwood(n: int, confidence: float = 0.90) -> tuple[float, float]:
    """Central interval of a Poisson mean; 0 below when n is 0."""
    tail = (1 - confidence) / 2
    low = _solve(lambda m: poisson_cdf(n - 1, m) - (1 - tail), 0.0, n + 1.0) if n else 0.0
    return low, poisson_upper(n, 1 - tail)


def binomial_cdf(k: int, n: int, p: float) -> float:
    if p <= 0 or k >= n:
        return 1.0
    if p >= 1 or k < 0:
        return 0.0
    base = math.lgamma(n + 1)
    return math.fsum(math.exp(base - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))


def clopper_pearson(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    """Exact interval of a share k of n."""
    tail = (1 - confidence) / 2
    low = 0.0 if k == 0 else _solve(lambda p: binomial_cdf(k - 1, n, p) - (1 - tail), 0.0, 1.0)
    high = 1.0 if k == n else _solve(lambda p: binomial_cdf(k, n, p) - tail, 0.0, 1.0)
    return low, high


def beta_cdf(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction, for 0 < x < 1 and all places together; the work doesn't grow with a and b as a sum would."""
    swap = x > (a + 1) / (a + b + 2)  # where the other tail's fraction converges faster
    x, a, b = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
    lg = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    # Numerators of the fraction, even and odd, evaluated from the front as a ratio of successive convergents.
    num, den = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    den = 1 / np.where(np.abs(den) < tiny, tiny, den)
    out = den.copy()
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            den, num = 1 + term * den, 1 + term / num
            den, num = 1 / np.where(np.abs(den) < tiny, tiny, den), np.where(np.abs(num) < tiny, tiny, num)
            step = den * num
            out = out * step
        if np.all(np.abs(step - 1) < 1e-14):
            break
    return np.where(swap, 1 - front * out, front * out)


def share_bounds(k: np.ndarray, n: np.ndarray, confidence: float = 0.95) -> tuple[np.ndarray, np.ndarray]:
    """clopper_pearson of many counts at once, of any size: quantiles of beta distributions, bisected together."""
    tail = (1 - confidence) / 2

    def quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(a)), np.ones(len(a))
        for _ in range(60):
            mid = (low + high) / 2
            below = beta_cdf(mid, a, b) < p
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        return (low + high) / 2

    low = np.where(k == 0, 0.0, quantile(tail, np.maximum(k, 1).astype(float), n - k + 1.0))
    high = np.where(k == n, 1.0, quantile(1 - tail, k + 1.0, np.maximum(n - k, 1).astype(float)))
    return low, high


def with_share_interval(rows: DataFrame, k: str, n: str, confidence: float = 0.95) -> DataFrame:
    """rows (of counts, so few) with low and high, the exact interval of the share k / n; null where n is null or 0."""

    def run(batches):
        for pdf in batches:
            ok = (pdf[n] > 0) & pdf[k].notna()
            pdf["low"], pdf["high"] = np.nan, np.nan
            if ok.any():
                pdf.loc[ok, "low"], pdf.loc[ok, "high"] = share_bounds(pdf.loc[ok, k].to_numpy(np.int64), pdf.loc[ok, n].to_numpy(np.int64), confidence)
            yield pdf

    out = rows.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", low double, high double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("low", "high")})


def poisson_uppers(counts: np.ndarray, tail: np.ndarray | float) -> np.ndarray:
    """For every count, the mean at which it or fewer has probability `tail`; all are bisected together."""
    k = np.arange(int(counts.max()) + 1)
    log_factorial = np.concatenate(([0.0], np.cumsum(np.log(k[1:]))))
    low, high = np.zeros(len(counts)), counts + 20 + 10 * np.sqrt(counts + 1.0)
    for _ in range(80):
        mid = (low + high) / 2
        terms = np.exp(k * np.log(mid)[:, None] - mid[:, None] - log_factorial)
        above = np.where(k <= counts[:, None], terms, 0.0).sum(axis=1) > tail
        low, high = np.where(above, mid, low), np.where(above, high, mid)
    return (low + high) / 2


def poisson_table(spark: SparkSession, most: int, confidence: float = 0.90) -> DataFrame:
    """(n, ul, low, high) for counts of 0 to most: a small table to join, in place of a UDF."""
    n, tail = np.arange(most + 1), (1 - confidence) / 2
    ul, high = poisson_uppers(n, 1 - confidence), poisson_uppers(n, tail)
    low = np.concatenate(([0.0], poisson_uppers(n[:-1], 1 - tail))) if most else np.zeros(1)
    return spark.createDataFrame(list(zip(n.tolist(), ul.tolist(), low.tolist(), high.tolist())), "n long, ul double, low double, high double")


def poisson_upper_large(n: Column, confidence: float = 0.90) -> Column:
    """poisson_upper of counts above some hundreds: Cornish and Fisher's expansion of the gamma quantile, within 1e-6 from 400 on."""
    z, a = NormalDist().inv_cdf(confidence), n + F.lit(1.0)
    return (
        a + z * F.sqrt(a) + (z**2 - 1) / 3 + (z**3 - 7 * z) / (36 * F.sqrt(a)) - (3 * z**4 + 7 * z**2 - 16) / (810 * a)
        + (9 * z**5 + 256 * z**3 - 433 * z) / (38880 * a * F.sqrt(a))
    )
