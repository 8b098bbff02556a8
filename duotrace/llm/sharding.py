"""Minimax contiguous partition of atomic groups into shards (operator 6)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import prepare, store, text_or_empty

#: Groups are equal texts, ordered by hash. The driver first holds them summed by BITS leading bits of the hash, and splits by STEP more bits each those runs alone in which a cut may lie.
BITS, STEP = 16, 8
#: A bucket with over 1/HOT of the rows is numbered in SALTS blocks, so that no task numbers it alone.
HOT, SALTS = 1024, 64


def greedy_cuts(sizes: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Ends of the shards when each takes as many groups, in order, as its capacity holds; None if groups are left over."""
    ends = np.cumsum(sizes)
    cuts, at, done = [], 0, 0
    for _ in range(shards):
        at = int(np.searchsorted(ends, done + capacity, "right"))
        cuts.append(at)
        done = int(ends[at - 1]) if at else 0
    return cuts if at == len(sizes) else None


def minimax_cuts(sizes: np.ndarray, shards: int) -> list[int]:
    """Ends of `shards` contiguous runs of the ordered sizes whose largest sum is least: binary search of the capacity,
    each tried by greedy filling. Runs may be empty at the end (fewer groups than shards, or none at all)."""
    if not len(sizes):
        return [0] * shards
    low, high = max(int(sizes.max()), -(-int(sizes.sum()) // shards)), int(sizes.sum())
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(sizes, mid, shards):
            high = mid
        else:
            low = mid + 1
    return greedy_cuts(sizes, low, shards)


class Runs:
    """Runs of consecutive groups in order of their hashes: first and last hash, bytes, and by how many leading bits they were summed."""

    def __init__(self, low, high, size, bits):
        order = np.argsort(low)
        self.low, self.high, self.size, self.bits = (np.asarray(x, np.int64)[order] for x in (low, high, size, bits))

    def unsure(self, shards: int) -> np.ndarray:
        """Which runs of several groups may hold a cut of the best partition.

        Its capacity lies between a fair share (or the largest group) and what cuts between runs reach; so the end of shard i
        lies between i steps of the least capacity, each rounded down to a run's start, and i times the greatest.
        """
        single = self.low == self.high
        ends = np.cumsum(self.size)
        starts, total = ends - self.size, int(ends[-1])
        least = max(-(-total // shards), int(self.size[single].max()) if single.any() else 0)
        most = _load(self.size, minimax_cuts(self.size, shards))
        open_, at = np.zeros(len(self.size), bool), 0
        if most > least:
            for i in range(1, shards):
                k = int(np.searchsorted(ends, at + least, "right"))
                at = int(starts[k]) if k < len(starts) else total
                open_ |= (ends > at) & (starts < i * most)
        return open_ & ~single


def _load(sizes: np.ndarray, cuts: list[int]) -> int:
    return max(int(sizes[a:b].sum()) for a, b in zip([0, *cuts[:-1]], cuts))


def thresholds(rows: DataFrame, shards: int, bits: int = BITS, step: int = STEP) -> list[int]:
    """The first hash of each shard but the first, so that the largest shard is least: exact for groups of equal hash.

    rows: hash, size. The driver holds a sum for each run of groups; a pass over the rows splits those that may hold a cut, some
    tens a shard, until these are single groups.
    """

    def sums(df: DataFrame, n: int) -> tuple:
        got = df.groupBy(F.shiftright("hash", 64 - n).alias("k")).agg(F.min("hash").alias("low"), F.max("hash").alias("high"), F.sum("size").alias("size")).toArrow()
        return *(got.column(c).to_numpy() for c in ("low", "high", "size")), np.full(got.num_rows, n)

    runs = Runs(*sums(rows, bits))
    while len(runs.low):
        again = runs.unsure(shards)
        if not again.any():
            break
        pieces = [tuple(x[~again] for x in (runs.low, runs.high, runs.size, runs.bits))]
        for n in np.unique(runs.bits[again]).tolist():
            keys = [(k,) for k in (runs.low[again & (runs.bits == n)] >> (64 - n)).tolist()]
            wanted = F.broadcast(rows.sparkSession.createDataFrame(keys, "k long"))
            pieces.append(sums(rows.join(wanted, F.shiftright("hash", 64 - n) == wanted["k"], "left_semi"), min(n + step, 64)))
        runs = Runs(*(np.concatenate(x) for x in zip(*pieces)))
    return [int(runs.low[c]) for c in minimax_cuts(runs.size, shards)[:-1] if c < len(runs.low)]


def shard(docs: DataFrame, shards: int = 16, doc_id: str = "doc_id", text: str = "text", bits: int = BITS, step: int = STEP) -> DataFrame:
    """Every row of docs with size, text_crc32, shard and slot; shards are near equal in bytes.

    Groups are equal texts (by 64-bit hash), in order of their hashes; they are cut into shards whose largest is as small as can
    be, however many groups there are. A group larger than a fair share makes its shard that large. Null text counts as
    empty (size 1, crc32 0) and shares the group of empty texts; very long texts are groups like any other; a null
    doc_id is numbered like any other; repeated rows each get a slot; an empty table gives no rows; other columns,
    whatever their names, are ignored. Slots are 0, 1, 2 ... within a shard, by bucket, then doc_id.
    """
    prepare(docs.sparkSession)
    body = text_or_empty(text)
    rows = store(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("hash")))
    number = sum((F.when(F.col("hash") >= t, 1).otherwise(0) for t in thresholds(rows, shards, bits, step)), F.lit(0))
    rows = rows.withColumn("shard", number.cast("int")).withColumn("bucket", F.shiftright("hash", 64 - bits).cast("int"))
    counts = store(rows.groupBy("bucket").agg(F.count("*").alias("n")))  # at most 2**bits rows
    whole = counts.agg(F.sum("n")).first()[0] or 0
    salts = counts.select("bucket", F.when(F.col("n") * HOT > whole, SALTS).otherwise(1).alias("salts"))
    placed = rows.join(F.broadcast(salts), "bucket").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    blocks = placed.groupBy("shard", "bucket", "salt").count()  # at most 2**bits + shards + HOT * SALTS rows
    before = Window.partitionBy("shard").orderBy("bucket", "salt").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("shard", "bucket", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("shard", "bucket", "salt").orderBy("doc_id", "text_crc32")
    return (
        placed.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(blocks), ["shard", "bucket", "salt"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"))
    )


def op6(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
