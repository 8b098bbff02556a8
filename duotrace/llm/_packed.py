"""Keyed exchange of numeric columns between Python workers.

A row for each word or shingle would be far too many rows to shuffle. A mapper instead deals its numbers out by a
key's hash and sends, for each partition, one row that holds each column as bytes; groupBy(part) brings the packs of a
partition together, and a reducer sees them as NumPy arrays. The packs grow with the data as rows would, but cost a
tenth of the bytes and hardly any JVM time. A mapper removes local repeats first, so a hot key arrives once a mapper.
"""

from __future__ import annotations

import ctypes
import gc
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A mapper sends what it has gathered once it holds this many entries.
FLUSH_ROWS = 2_000_000


def schema(n: int) -> str:
    return "part int, " + ", ".join(f"c{i} binary" for i in range(n))


class Packer:
    """Gathers columns of equal length and turns them into a row for each partition."""

    def __init__(self, parts: int, n: int, most: int = FLUSH_ROWS):
        self.parts, self.n, self.most = parts, n, most
        self.held: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, keys: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        """keys decide the partition (by their top bits' product, so any 64-bit hash serves)."""
        if len(keys):
            self.held.append((((keys >> np.uint64(32)) % np.uint64(self.parts)).astype(np.int32), *columns))
            self.rows += len(keys)
        if self.rows >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        part, *columns = (np.concatenate(x) for x in zip(*self.held))
        self.held, self.rows = [], 0
        order = np.argsort(part, kind="stable")
        part = part[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        lows = np.concatenate(([0], cuts))
        highs = np.concatenate((cuts, [len(part)]))
        columns = [c[order] for c in columns]
        step = 64
        for k in range(0, len(lows), step):
            spans = list(zip(lows[k : k + step], highs[k : k + step]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(part[lows[k : k + step]], pa.int32()), *(pa.array([c[a:b].tobytes() for a, b in spans], pa.binary()) for c in columns)],
                names=["part", *(f"c{i}" for i in range(self.n))],
            )


def _give_back() -> None:
    """Freed memory goes back to the system: a Python worker outlives its tasks, and what it keeps adds to the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidy(mapper: Callable) -> Callable:
    """mapper (or a group's, batch by batch), giving back memory once a task (or group) is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from mapper(batches)
        finally:
            _give_back()

    return run


def unpack(table: pa.Table, *kinds) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(x.as_buffer() for x in table.column(f"c{i}")), kind) for i, kind in enumerate(kinds)]


def exchange(df: DataFrame, mapper: Callable, n: int, reducer: Callable[[pa.Table], pa.Table], out: str) -> DataFrame:
    """mapper: batches of df to batches of schema(n); reducer: the packs of one partition to a table of `out`."""

    def reduced(table: pa.Table) -> pa.Table:
        try:
            return reducer(table)
        finally:
            _give_back()

    return df.mapInArrow(tidy(mapper), schema(n)).groupBy("part").applyInArrow(reduced, out)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal, sorted keys."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(keys)]))
