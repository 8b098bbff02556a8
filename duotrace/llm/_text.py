"""Vectorised work on UTF-8 text inside Python workers: an Arrow batch's texts are one byte array with offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES = 1 << 21


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random odd-or-even 64-bit numbers that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every input bit over all output bits."""
    x = np.asarray(x, U)
    with np.errstate(over="ignore"):
        y = x >> U(30)
        y ^= x
        y *= U(0xBF58476D1CE4E5B9)
        t = y >> U(27)
        y ^= t
        y *= U(0x94D049BB133111EB)
        np.right_shift(y, U(31), out=t)
        y ^= t
        return y


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
WORD = ~SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUES = (splitmix(256, 11), splitmix(256, 12))
BASES = (0x9DDFEA08EB382D69, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    got = _powers.get(which)
    if got is None or len(got[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        base = BASES[which]
        tables = []
        for b in (base, pow(base, -1, 1 << 64)):
            with np.errstate(over="ignore"):
                steps = np.full(size, b, U)
                steps[0] = 1
                tables.append(np.multiply.accumulate(steps))
        got = _powers[which] = tuple(tables)
        if size > 8 * CHUNK_BYTES:
            _powers.pop(which)
    return got


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts of up to `most` bytes; a longer text is a run of its own. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, where, what = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes of a kind, never across texts), and each text's first word's number."""
    inside = kinds[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of bytes, from prefix sums of a polynomial."""
    n = len(data)
    power, inverse = _power_tables(which, n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U)
        np.cumsum(BYTE_VALUES[which][data] * power[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U))


def rolling(hashes: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive elements: len(hashes) - k + 1 of them (none if fewer)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U)
    power, inverse = _power_tables(which, n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U)
        np.cumsum(mix(hashes ^ U(which + 1)) * power[:n], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
