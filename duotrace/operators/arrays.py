"""Sample series as arrays: blocks with halos, frames, spectra, coherence, and signals laid over noise."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks(samples: DataFrame, keys: list[str], at: str, value: str, size: int) -> DataFrame:
    """keys, block, s: samples (at counts from 0) as arrays of `size`, null where a sample is missing. Of samples at one place the least counts."""
    held = samples.groupBy(*keys, F.floor(F.col(at) / size).alias("block"), F.pmod(F.col(at), F.lit(size)).cast("int").alias("_k")).agg(F.min(value).alias("_v"))
    got = held.groupBy(*keys, "block").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("m"))
    return got.select(*keys, "block", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.col("m")[k]).alias("s"))


def haloed(table: DataFrame, keys: list[str], size: int, reach: int) -> DataFrame:
    """keys, block, s: every block followed by the next `reach` samples of its neighbours.

    Only the halo travels beside the block itself: a block sends its head to the ones before it that reach so far, and both
    meet in one shuffle by (keys, block), which a table kept by these keys doesn't need. No window runs over a whole series.
    """
    if not reach:
        return table.select(*keys, "block", "s")
    back = F.explode(F.sequence(F.lit(1), F.lit(-(-reach // size)))).alias("_d")
    heads = table.select(*keys, "block", "s", back).select(*keys, (F.col("block") - F.col("_d")).alias("block"), F.col("_d"), F.slice("s", F.lit(1), F.least(F.lit(size), reach - (F.col("_d") - 1) * size)).alias("s"))
    both = table.select(*keys, "block", F.lit(0).alias("_d"), "s").unionByName(heads)
    whole = both.groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("_d", "s"))).alias("p")).filter(F.col("p")[0]["_d"] == 0)
    # A neighbour that isn't there ends the run of parts.
    parts = F.filter("p", lambda x, i: x["_d"] == i)
    return whole.select(*keys, "block", F.flatten(F.transform(parts, lambda x: x["s"])).alias("s"))


def frames(table: DataFrame, keys: list[str], size: int, length: int, step: int) -> DataFrame:
    """keys, w, start, s: windows of `length` samples every `step`, each once and whole ones only, also across the blocks' edges."""
    wide = haloed(table, keys, size, length - 1)
    first = F.ceil(F.col("block") * size / step).cast("long")
    last = F.floor(((F.col("block") + 1) * size - 1) / step).cast("long")
    out = wide.filter(first <= last).withColumn("w", F.explode(F.sequence(first, last))).withColumn("start", F.col("w") * step)
    out = out.select(*keys, "w", "start", F.slice("s", (F.col("start") - F.col("block") * size + 1).cast("int"), length).alias("s"))
    return out.filter((F.size("s") == length) & ~F.exists("s", lambda x: x.isNull()))


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _mapped(rows: DataFrame, inputs: list[str], out: str, kind: str, function: Callable) -> DataFrame:
    """rows with `out` in place of the inputs: function of their matrices, a batch at a time. Arrays of a batch have one length."""
    rest = [c for c in rows.columns if c not in inputs]
    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rest), f"{out} {kind}"])

    def run(batches):
        for batch in batches:
            got = function(*(_matrix(batch.column(c)) for c in inputs))
            column = pa.array(list(got), pa.list_(pa.float64())) if kind.startswith("array") else pa.array(got, pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), column], names=[*rest, out])

    return rows.mapInArrow(run, schema)


def spectra(rows: DataFrame, rate: float, column: str = "s", out: str = "p") -> DataFrame:
    """rows with the one-sided power density of each frame (mean taken off, Hann window) in place of the frame."""

    def power(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
        p = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * window)) ** 2 / (rate * (window**2).sum())
        p[:, 1 : (n + 1) // 2] *= 2
        return p

    return _mapped(rows, [column], out, "array<double>", power)


def by_element(rows: DataFrame, keys: list[str], column: str, *aggregates: Column) -> DataFrame:
    """keys, bin and aggregates of `v`, the arrays' elements at each place: arrays are never gathered, and sums combine in mappers."""
    return rows.select(*keys, F.posexplode(column).alias("bin", "v")).groupBy(*keys, "bin").agg(*aggregates)


def floored(spectrum: DataFrame, keys: list[str], value: str, share: float = 1e-10) -> DataFrame:
    """A spectrum (keys, bin, value) no lower than a share of its own median, so that whitening never divides by next to nothing."""
    middle = spectrum.groupBy(*keys).agg(F.percentile(value, 0.5).alias("_middle"))  # as many values as bins
    return spectrum.join(F.broadcast(middle), keys).withColumn(value, F.greatest(F.col(value), F.col("_middle") * share)).drop("_middle")


def centroid(p: str, rate: float, length: int, low: float, high: float) -> Column:
    """The mean frequency of a spectrum's power between low and high; null without power there."""
    f = lambda k: k * (rate / length)
    kept = F.transform(p, lambda v, k: F.when((f(k) >= low) & (f(k) <= high), v).otherwise(0.0))
    total = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v)
    moment = F.aggregate(F.transform(kept, lambda v, k: v * f(k)), F.lit(0.0), lambda a, v: a + v)
    return F.when(total > 0, moment / total)


def max_lag(rows: DataFrame, x: str, y: str, lags: int, out: str, pearson: bool = False) -> DataFrame:
    """rows with the greatest absolute circular correlation of both series within `lags` in place of them: twice the product over
    both energies, or, for pearson, of deviations over both norms. All lags come from one transform, so their number costs nothing."""

    def best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = a.shape[1]
        if pearson:
            a, b = a - a.mean(1, keepdims=True), b - b.mean(1, keepdims=True)
            a, b = (v / (np.linalg.norm(v, axis=1, keepdims=True) + 1e-12) for v in (a, b))
        cross = np.fft.irfft(np.fft.rfft(a) * np.conj(np.fft.rfft(b)), n)
        near = np.abs(cross[:, sorted({k % n for k in range(-lags, lags + 1)})]).max(1)
        return near if pearson else 2 * near / ((a * a).sum(1) + (b * b).sum(1) + 1e-30)

    return _mapped(rows, [x, y], out, "double", best)


def stretch(placed: DataFrame, table: DataFrame, key: str, ident: list[str], size: int, lo: str, hi: str, out: str = "noise") -> DataFrame:
    """placed (ident, key, lo, hi) with the samples lo .. hi - 1 of its series, those with all samples there.

    Intervals are dealt to the blocks that they touch and meet them by (key, block), so a long series is cut up and many
    intervals on one block share it; Spark splits a block that very many want.
    """
    first, last = (F.floor(c / size).cast("long") for c in (F.col(lo), F.col(hi) - 1))
    touched = placed.select(*ident, key, lo, hi, F.explode(F.sequence(first, last)).alias("block"))
    cut_lo = F.greatest(F.col(lo) - F.col("block") * size, F.lit(0))
    cut_hi = F.least(F.col(hi) - F.col("block") * size, F.lit(size))
    pieces = touched.join(table, [key, "block"]).select(*ident, "block", F.slice("s", (cut_lo + 1).cast("int"), (cut_hi - cut_lo).cast("int")).alias("s"))
    whole = pieces.groupBy(*ident).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "s"))), lambda p: p["s"])).alias(out))
    return placed.join(whole, ident).filter((F.size(out) == F.col(hi) - F.col(lo)) & ~F.exists(out, lambda x: x.isNull()))


def laid_over(noise: str, signal: str, offset: Column, scale: Column) -> Column:
    """The noise with the scaled signal added from `offset` on; what of the signal lies outside is cut off."""
    return F.transform(noise, lambda v, k: v + F.when((k >= offset) & (k < offset + F.size(signal)), F.col(signal)[(k - offset).cast("int")] * scale).otherwise(0.0))
