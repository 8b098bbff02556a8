"""A group of the suffix tree's runs: the same answers as all at once, in memory that hardly grows with the blocks that send them."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from duotrace.llm import suffix_tree as tree


def _sent(blocks: int, rng: np.random.Generator) -> tuple[list, list]:
    """Blocks' runs of one frequent context: most of the same ones in each, as in texts."""
    around = np.unique(rng.integers(97, 123, (6000, 3)), axis=0).astype(np.uint64)
    all_runs = np.sort((around[:, 0] << np.uint64(40)) | (around[:, 1] << np.uint64(32)) | np.uint64(0x20656E << 8) | around[:, 2])
    keys = [all_runs[rng.random(len(all_runs)) < 0.7] for _ in range(blocks)]
    return keys, [rng.integers(0, 5, len(k)).astype(np.uint32) for k in keys]


def _batches(keys, times, size=10):
    for lo in range(0, len(keys), size):
        k, t = keys[lo : lo + size], times[lo : lo + size]
        columns = [pa.array([3] * len(k), pa.int32()), pa.array(range(lo, lo + len(k)), pa.int64()), pa.array(map(tree._planes, k), pa.binary()), pa.array([x.tobytes() for x in t], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "grams", "times"])


def _short(keys, times):
    three, inverse = np.unique(tree._last(np.concatenate(keys), 3), return_inverse=True)
    return SimpleNamespace(value=tree.Short(three.astype(np.int64), np.bincount(inverse, weights=np.concatenate(times)) + 1))


def test_groups_by_batches_answer_like_one_table():
    keys, times = _sent(25, np.random.default_rng(5))
    short = _short(keys, times)
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    want = tree.gram_logs(key, np.bincount(inverse, weights=np.concatenate(times)), short.value).astype(np.float32)
    got = [r for b in tree._gram_reducer(short)(_batches(keys, times)) for r in b.to_pylist()]
    assert [(r["part"], r["block"]) for r in got] == [(3, b) for b in range(25)]
    for r, k in zip(got, keys):
        assert np.array_equal(np.frombuffer(r["logs"], np.float32), want[np.searchsorted(key, k)])


def test_memory_hardly_grows_with_blocks():
    """Sixteen times the blocks send sixteen times the runs of a context; what is held grows by less than two bytes a run."""
    peaks, runs = [], []
    for blocks in (20, 320):
        keys, times = _sent(blocks, np.random.default_rng(7))
        short = _short(keys, times)
        tracemalloc.start()
        assert sum(b.num_rows for b in tree._gram_reducer(short)(_batches(keys, times))) == blocks
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        runs.append(sum(map(len, keys)))
    assert peaks[1] - peaks[0] < 2 * (runs[1] - runs[0])
