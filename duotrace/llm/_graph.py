"""Connected components of a distributed set of links."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import drop, store

#: Links that a task merges at a time; the table of links is kept in as many tasks as that gives.
MERGE_ROWS = 200_000


def _merged(batches):
    """A task's links, MERGE_ROWS at a time, by union-find: every node with the least node that it reaches through them."""

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def flush():
        nodes = [x for x in up if find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])

    up: dict[int, int] = {}
    rows = 0
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(up.setdefault(x, x)), find(up.setdefault(y, y))
            up[max(x, y)] = min(x, y)
        rows += batch.num_rows
        if rows >= MERGE_ROWS:
            yield flush()
            up, rows = {}, 0
    if rows:
        yield flush()


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One star step: every node's neighbours are linked to the least of them instead (large: those above the node; else those below)."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        return joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a <> b")


def components(links: DataFrame) -> DataFrame:
    """(a, b) pairs of numbers to a stored (node, component): the least node that each node reaches. Only nodes with a link are listed.

    A distributed union-find: each task first merges the links it holds, a bounded run at a time, then large and small star
    steps join what different tasks found, until every node is linked to its least one alone. Each step joins and groups by
    node, so no component is held in one place. The local merging saves rounds, and no step drops a link; what one run can
    merge needs no step.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    tasks = -(-links.count() // MERGE_ROWS)
    merged = lambda df: df.coalesce(max(tasks, 1)).mapInArrow(_merged, "a long, b long")
    now, mark = store(merged(links)), None
    while tasks > 1:
        new = store(merged(_stars(_stars(now, True), False)))
        drop(now)
        now = new
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    out = store(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()))
    drop(now)
    return out
