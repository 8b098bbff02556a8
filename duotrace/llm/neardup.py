"""Near-duplicate documents by HyperMinHash registers (operator 2)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bands import all_links, candidates
from ._io import drop, parts_for, prepare, store, text_or_empty
from ._packed import tidy
from ._text import LOWER, chunks, mix, rolling, span_hashes, splitmix, word_spans
from .lines import _wanted

U = np.uint64
#: Registers of 16 bits: 6 for the leading zeros of a bucket's least hash (0: empty bucket), MANTISSA for the bits after.
REGISTERS, MANTISSA = 512, 10
#: BANDS bands of ROWS registers: a pair at similarity 0.85 misses all of them once in 10**9.
ROWS = 8
BANDS = REGISTERS // ROWS
SEEDS = splitmix(REGISTERS, 21)
BAND_SEEDS = splitmix(BANDS * 16, 22).reshape(16, BANDS)
#: A pair whose estimate lies this many standard errors below the threshold is not verified.
ERRORS = 6


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes: runs of k words, letters A to Z lower-cased; a text of fewer words is one shingle."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    runs = rolling(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(runs[a : b - k + 1]))
        else:
            out.append(rolling(words[a:b], b - a) if b > a else runs[:0])
    return out


def level(n: int) -> int:
    """log2 of the buckets for a set of n shingles: two to four shingles a bucket, up to all REGISTERS in one hash function."""
    return min(max(n.bit_length() - 2, 0), REGISTERS.bit_length() - 1)


def levels(n: int, percent: int) -> list[int]:
    """The set's own level, and that of the smallest set it can be similar to: two similar sets share one of them."""
    return sorted({level(n), level(-(-n * percent // 100))})


def registers(shingles: np.ndarray, p: int) -> np.ndarray:
    """REGISTERS registers from as many hash functions as give 2**p buckets each."""
    x = np.sort(mix(shingles[None, :] ^ SEEDS[: REGISTERS >> p, None]), axis=1)
    bucket = (x >> U(64 - p)) if p else np.zeros_like(x)
    bucket = (bucket.astype(np.int64) + (np.arange(len(x)) << p)[:, None]).ravel()
    lead = np.empty(len(bucket), bool)
    lead[0] = True
    lead[1:] = bucket[1:] != bucket[:-1]
    rest = x.ravel()[lead] << U(p)
    zeros = np.where(rest, 64 - np.frexp(rest.astype(np.float64))[1], 62).clip(0, 62).astype(np.int64)
    code = ((zeros + 1) << MANTISSA) | ((rest << (zeros + 1).astype(U)) >> U(64 - MANTISSA)).astype(np.int64)
    out = np.zeros(REGISTERS, np.uint16)
    out[bucket[lead]] = code
    return out


def band_keys(regs: np.ndarray, p: int) -> np.ndarray:
    """A 64-bit key for each band that isn't empty."""
    two = regs.view(U).reshape(BANDS, ROWS // 4)
    keys = mix(two[:, 0] ^ mix(two[:, 1] ^ BAND_SEEDS[p]))
    return keys[two.any(axis=1)]


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Similarity from registers of one level, less the registers that agree by chance, and how many registers it rests on."""
    used = int(((a > 0) | (b > 0)).sum())
    both = int(((a > 0) & (b > 0)).sum())
    same = int(((a == b) & (a > 0)).sum())
    chance = (both - same) * 2.0 ** -(MANTISSA + 1)
    return (same - chance) / max(used - chance, 1.0), used


def _signatures(k: int, percent: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            sizes, marks, tops, regs = [], [], [], [[], []]
            for _, _, data, offsets in chunks(batch.column(1)):
                for s in shingle_sets(data, offsets, k):
                    sizes.append(len(s))
                    marks.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64))
                    own = levels(len(s), percent) if len(s) else []
                    tops.append((own + [None, None])[:2])
                    for i in (0, 1):
                        regs[i].append(registers(s, own[i]).tobytes() if i < len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(sizes, pa.int64()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks], pa.int64()),
                    pa.array([t[0] for t in tops], pa.int32()), pa.array(regs[0], pa.binary()), pa.array([t[1] for t in tops], pa.int32()), pa.array(regs[1], pa.binary()),
                ],
                names=["doc_id", "n", "set_a", "set_b", "p0", "regs0", "p1", "regs1"],
            )

    return run


def _bands(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The band entries of a batch of signatures; a set that repeats in the batch is entered once."""
    rows = batch.select(["id", "set_a", "set_b", "p0", "regs0", "p1", "regs1"]).to_pydict()
    ids, keys, seen = [], [np.zeros(0, U)], set()
    for doc, set_a, set_b, *both in zip(*rows.values()):
        if (set_a, set_b) in seen:
            continue
        seen.add((set_a, set_b))
        for p, regs in (both[:2], both[2:]):
            if regs is not None:
                keys.append(band_keys(np.frombuffer(regs, np.uint16), p))
                ids.append((doc, len(keys[-1])))
    return np.repeat(np.array([d for d, _ in ids], np.int64), [n for _, n in ids]), np.concatenate(keys)


def _prune(percent: int):
    def run(batches):
        t = percent / 100
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            keep = []
            for u, v in zip(x, y):
                j, used = estimate(np.frombuffer(u, np.uint16), np.frombuffer(v, np.uint16))
                keep.append(j >= t - ERRORS * (t * (1 - t) / max(used, 1)) ** 0.5)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    return [s for _, _, data, offsets in chunks(texts) for s in shingle_sets(data, offsets, k)]


def _verify(k: int, percent: int):
    def run(batches):
        cache: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            right = _sets(batch.column(3), k)
            new = [i for i, x in enumerate(a) if x not in cache and (i == 0 or a[i - 1] != x)]
            cache = {x: cache[x] for x in set(a) if x in cache}
            got = _sets(batch.column(2).take(pa.array(new, pa.int64())), k)
            cache |= {a[i]: s for i, s in zip(new, got)}
            keep = []
            for x, s in zip(a, right):
                r = cache[x]
                both = len(np.intersect1d(r, s, assume_unique=True))
                keep.append(100 * both >= percent * (len(r) + len(s) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(pairs: DataFrame, sigs: DataFrame, texts, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, as a stored (a, b). sigs: one row an id."""
    side = lambda x: sigs.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "p0", "regs0", "p1", "regs1")))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    # Registers of a level that both have; similar sets share one.
    same = [(i, j, F.col(f"p{i}_a") == F.col(f"p{j}_b")) for i in (0, 1) for j in (0, 1)]
    pick = lambda x: F.coalesce(*(F.when(on, F.col(f"regs{i if x == 'a' else j}_{x}")) for i, j, on in same))
    rows = sized.select("a", "b", pick("a").alias("ra"), pick("b").alias("rb")).filter("ra is not null and rb is not null")
    near = store(rows.mapInArrow(_prune(percent), "a long, b long"))
    needed = store(near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct())
    body = store(texts(needed))
    text = lambda x: body.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}"))
    both = near.join(text("a"), "a").join(text("b"), "b").select("a", "b", "t_a", "t_b")
    out = store(both.mapInArrow(tidy(_verify(k, percent)), "a long, b long"))
    drop(body), drop(near), drop(needed)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a doc_id: doc_id, n_shingles, component_id, kept.

    Documents whose sets of `words`-word shingles have 100 * intersection >= percent * union are linked; component_id is
    the least doc_id reachable, and kept marks that document.

    1. Registers: each set is hashed into buckets whose least hash is kept as leading zeros and mantissa bits. Small
       sets use fewer buckets and more hash functions, so that registers are never mostly empty.
    2. Equal sets form a class (128-bit digests); one representative of each goes on.
    3. Bands of registers give candidates. Members of a band are paired with its least member only, first inside a
       mapper and then between mappers.
    4. The corrected estimate drops hopeless pairs, and the full sets of the rest decide.
    5. Bands that still hold several components are split by exact differences from a pivot (all_links), so that every pair
       that shares a band is tested or is known to be connected or too different.

    Null and empty texts, and texts of white space, have no shingles and no links. Rows that repeat a doc_id are one
    document (of equal text, as an id identifies a text). A null doc_id stays alone. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    sigs = store(docs.mapInArrow(tidy(_signatures(words, percent)), "doc_id long, n long, set_a long, set_b long, p0 int, regs0 binary, p1 int, regs1 binary"))
    full = sigs.filter("n > 0 and doc_id is not null")
    classes = full.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last")).filter("rep <> last")
    # Both sides of this join are plain shuffles, so that Spark splits the partition of a very large class.
    classes = store(classes.select("set_a", "set_b", "rep"))
    members = store(full.select("doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"]).filter("doc_id <> rep").select("doc_id", "rep").distinct())
    drop(classes)

    signed = full.select(F.col("doc_id").alias("id"), "n", "set_a", "set_b", "p0", "regs0", "p1", "regs1")
    levels_ = full.agg(F.sum(F.when(F.col("p1").isNull(), 1).otherwise(2))).first()[0] or 0
    # Entries of 17 bytes for each band of every level.
    pairs = candidates(signed, _bands, parts_for(spark, levels_ * BANDS * 17))
    for x in ("a", "b"):
        pairs = pairs.join(members.select(F.col("doc_id").alias(x), F.col("rep").alias(f"rep_{x}")), x, "left").withColumn(x, F.coalesce(f"rep_{x}", x)).drop(f"rep_{x}")
    pairs = store(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    # Only members of these pairs share a band with another set.
    needed = store(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    # A filter goes before these joins, so that they shuffle the signatures and texts of few other documents.
    items = store(_wanted(signed, needed, ["id"]).join(needed, "id", "left_semi").dropDuplicates(["id"]))
    drop(needed)
    bodies = docs.filter("doc_id is not null").withColumnRenamed("doc_id", "id")
    texts = lambda ids: _wanted(bodies, ids, ["id"]).groupBy("id").agg(F.first("text").alias("text")).join(ids, "id", "left_semi")
    verify = lambda some: _linked(some, items, texts, words, percent)
    found = all_links(items, _bands, pairs, verify(pairs), texts, lambda column: _sets(column, words), percent, verify)
    drop(items), drop(pairs)
    rows = sigs.groupBy("doc_id").agg(F.max("n").alias("n_shingles"))
    rows = rows.join(members, "doc_id", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    rows = rows.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=85)
