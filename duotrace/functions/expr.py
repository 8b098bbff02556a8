"""Scores of windows and pairs as column expressions (no UDFs, so they stay in generated code)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from duotrace.config import SearchConfig


def clip(x: Column, low: float, high: float) -> Column:
    """x kept to [low, high]; NaN stays NaN (least and greatest alone would take it for the largest number)."""
    return F.when(F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def net(sigma_h: Column, sigma_l: Column) -> Column:
    """The network statistic of two streams' scores."""
    return (sigma_h + sigma_l) / F.sqrt(F.lit(2.0))


def gate(g: Column, sigma: Column) -> Column:
    """Glitch evidence, faded in as the score goes from 0 to 3."""
    return clip(g, -6.0, 6.0) * clip(sigma / 3.0, 0.0, 1.0)


def features(sigma_h: Column, sigma_l: Column, coh: Column, c_h: Column, c_l: Column, g_h: Column, g_l: Column) -> list[Column]:
    """The seven features of a pair."""
    return [sigma_h, sigma_l, coh, c_h, c_l, gate(g_h, sigma_h), gate(g_l, sigma_l)]


def linear(values: list[Column], mean, scale, beta) -> Column:
    """Intercept and slopes over standardised features."""
    return reduce(lambda a, b: a + b, [F.lit(b) * ((v - F.lit(m)) / F.lit(s)) for v, m, s, b in zip(values, mean, scale, beta[1:])], F.lit(beta[0]))


def loglr(values: list[Column], config: SearchConfig = SearchConfig()) -> Column:
    """The log likelihood ratio of signal to noise."""
    return linear(values, config.lr_mean, config.lr_scale, config.lr_beta)


def kept_by(hm: Column, lm: Column, cut: float = 0.5) -> Column:
    """Which arms lie above the cut: HM, HM+LM, +LM (the second alone) or none."""
    label = F.concat(F.when(hm > cut, "HM").otherwise(""), F.when(lm > cut, "+LM").otherwise(""))
    return F.when(label == "", "none").otherwise(label)


def logistic(x: Column, centre: float, width: float) -> Column:
    return 1 / (1 + F.exp(-(x - centre) / width))
