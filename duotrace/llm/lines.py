"""Fuzzy line deduplication by MinHash over character shingles (operator 3)."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._bands import all_links, candidates
from ._io import drop, parts_for, prepare, store, text_or_empty
from ._packed import tidy
from ._text import chunks, mix, splitmix

U = np.uint64
#: BANDS bands of ROWS of the SLOTS bucket minima: a pair at similarity 0.8 misses all of them five times in 100,000, at 0.85 four times in ten million.
SLOTS, ROWS = 128, 5
BANDS = SLOTS // ROWS
WEIGHTS = splitmix(ROWS, 31) | U(1)
BAND_SEEDS = splitmix(BANDS, 32)
STEP = U(0x9E3779B97F4A7C15)
BASE = U(0xD1342543DE82EF95)
#: A pair of lines whose minima agree this many standard errors below the threshold is not verified.
ERRORS = 6
NEWLINE, BLANKS = 10, (9, 10, 11, 12, 13, 32)
BLANK = np.isin(np.arange(33), BLANKS)
#: The filter of wanted places has 64 bits for each of these words, and words without a bit have no row, so what is broadcast never exceeds this many rows of about 50 bytes.
FILTER_WORDS_LOG2 = 21
#: Bytes of text worked on at once, so that arrays of eight bytes a character stay in the processor's cache.
PIECE = 1 << 18


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' characters as numbers, and where each text begins among them."""
    lead = (data & 0xC0) != 0x80
    counts = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=counts[1:])
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), counts[offsets]


def line_spans(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all lines: each text's, split at newlines (an empty text is one empty line)."""
    breaks = np.flatnonzero(points == NEWLINE)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    ends = np.sort(np.concatenate((offsets[1:], breaks)), kind="stable")
    return starts, ends


def runs(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit number for each run of q characters: a polynomial in a fixed base."""
    if len(points) < q:
        return np.zeros(0, U)
    points = points.astype(U)
    n = len(points) - q + 1
    with np.errstate(over="ignore"):
        h = points[:n].copy()
        for k in range(1, q):
            h *= BASE
            h += points[k : k + n]
    return h


def shingles(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, line number) of every run of q characters in a line; a shorter line is one shingle, an empty one has none."""
    every = runs(points, q)
    count = np.maximum(ends - starts - q + 1, 0)
    line = np.repeat(np.arange(len(starts)), count)
    first = np.repeat(starts - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    h = every[first + np.arange(len(line))]
    short = np.flatnonzero((count == 0) & (ends > starts))
    if len(short):
        own = np.array([runs(points[starts[k] : ends[k]], int(ends[k] - starts[k]))[0] for k in short], U)
        h, line = np.concatenate((h, own)), np.concatenate((line, short))
    return h, line


def signatures(h: np.ndarray, line: np.ndarray, lines: int) -> np.ndarray:
    """SLOTS minima a line from one hash function: buckets by its top bits, an empty one filled from the next full one and marked with the distance."""
    x = mix(h ^ STEP)
    width = SLOTS.bit_length() - 1
    out = np.full(lines * SLOTS, np.iinfo(np.uint32).max, np.uint32)
    np.minimum.at(out, line * SLOTS + (x >> U(64 - width)).astype(np.int64), ((x >> U(16)) & U(0xFFFFFFFF)).astype(np.uint32))
    out = out.reshape(lines, SLOTS)
    full = out != np.iinfo(np.uint32).max
    twice = np.concatenate((full, full), axis=1)
    place = np.where(twice, np.arange(2 * SLOTS), 4 * SLOTS)
    source = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1][:, :SLOTS]
    away = source - np.arange(SLOTS)
    values = np.take_along_axis(out, source % SLOTS, axis=1).astype(U)
    return values + away.astype(U) * STEP


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band of slots BANDS apart, as neighbours may be filled from one bucket."""
    spread = sig[:, : BANDS * ROWS].reshape(len(sig), ROWS, BANDS)
    with np.errstate(over="ignore"):
        return mix((mix(spread) * WEIGHTS[:, None]).sum(axis=1, dtype=U) ^ BAND_SEEDS)


def _bands(q: int, column: str):
    """Band entries of the lines in a text column; a line's number is the xxhash64 of its text, as Spark computes it."""

    def run(batch):
        import xxhash

        ids, keys = [np.zeros(0, np.int64)], [np.zeros(0, U)]
        for _, _, data, offsets in chunks(batch.column(column), PIECE):
            points, where = code_points(data, offsets)
            starts, ends = line_spans(points, where)
            raw = np.zeros(len(points) + 1, np.int64)
            raw[: len(points)] = np.flatnonzero((data & 0xC0) != 0x80)
            raw[len(points)] = len(data)
            solid = np.zeros(len(points) + 1, np.int32)
            np.cumsum(~BLANK[np.minimum(points, 32)] | (points > 32), out=solid[1:])
            keep = solid[ends] > solid[starts]
            starts, ends = starts[keep], ends[keep]
            if not len(starts):
                continue
            body = data.tobytes()
            node = np.array([xxhash.xxh64_intdigest(body[a:b], 42) for a, b in zip(raw[starts].tolist(), raw[ends].tolist())], U).view(np.int64)
            _, lead = np.unique(node, return_index=True)
            node, starts, ends = node[lead], starts[lead], ends[lead]
            h, line = shingles(points, starts, ends, q)
            k = band_keys(signatures(h, line, len(starts)))
            ids.append(np.repeat(node, BANDS))
            keys.append(k.ravel())
        return np.concatenate(ids), np.concatenate(keys)

    return run


def _line_sets(column: pa.Array, q: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingles, a row being one line."""
    out = []
    for _, _, data, offsets in chunks(column, PIECE):
        points, where = code_points(data, offsets)
        h, line = shingles(points, where[:-1], where[1:], q)
        order = np.argsort(line, kind="stable")
        h, line = h[order], line[order]
        cuts = np.searchsorted(line, np.arange(len(where)))
        out += [np.unique(h[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
    return out


def _signed(q: int):
    """For rows (id, line): the same with 16 bits of each of the line's bucket minima."""

    def run(batches):
        for batch in batches:
            out = [np.zeros((0, SLOTS), np.uint16)]
            for _, _, data, offsets in chunks(batch.column(1), PIECE):
                points, where = code_points(data, offsets)
                out.append((mix(signatures(*shingles(points, where[:-1], where[1:], q), len(offsets) - 1)) >> U(48)).astype(np.uint16))
            body = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in body], pa.binary())], names=["id", "line", "sig"])

    return run


def _hopeful(percent: int):
    """Pairs (a, b, s_a, s_b, n) whose minima agree in a share of at least ERRORS standard errors below the threshold; n bounds the shingles of both."""

    def run(batches):
        t = percent / 100
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, SLOTS) for k in (2, 3))
            used = np.clip(np.asarray(batch.column(4)), 1, SLOTS)
            keep = (x == y).mean(axis=1) >= t - ERRORS * np.sqrt(t * (1 - t) / used)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify(q: int, percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(_line_sets(batch.column("t_a"), q), _line_sets(batch.column("t_b"), q)):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(pairs: DataFrame, texts: DataFrame, q: int, percent: int) -> DataFrame:
    """The pairs (a, b) of similar lines, stored. texts: id, line, sig."""
    side = lambda x, c, n: texts.select(F.col("id").alias(x), F.col(c).alias(f"{n}_{x}"), F.char_length("line").alias(f"n_{x}"))
    rows = pairs.select("a", "b").join(side("a", "sig", "s"), "a").join(side("b", "sig", "s"), "b")
    rows = rows.select("a", "b", "s_a", "s_b", (F.least("n_a", "n_b") - (q - 1)).alias("n"))
    near = store(rows.mapInArrow(tidy(_hopeful(percent)), "a long, b long"))
    both = near.join(side("a", "line", "t"), "a").join(side("b", "line", "t"), "b").select("a", "b", "t_a", "t_b")
    out = store(both.mapInArrow(tidy(_verify(q, percent)), "a long, b long"))
    drop(near)
    return out


def _lines(docs: DataFrame, *more: str | Column) -> DataFrame:
    """A row for each line that isn't blank: at, line, id and more columns of its document."""
    lines = docs.select(*more, F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return lines.filter(F.col("line").rlike(r"[^\x09-\x0D\x20]")).withColumn("id", F.xxhash64("line"))


def _wanted(rows: DataFrame, some: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys may be among those of `some`: all that are, and others by chance, the more the fuller the filter.

    One bit a key, or-ed into words that are broadcast. The filter's size has a bound, so in a corpus with far more wanted keys
    than bits it lets more rows through; whoever needs these keys alone joins what is left.
    """
    h = F.xxhash64(*keys)
    word = F.shiftrightunsigned(h, 64 - FILTER_WORDS_LOG2)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    words = some.select(word.alias("_of"), bit.alias("_one")).groupBy("_of").agg(F.bit_or("_one").alias("_bits"))
    return rows.join(F.broadcast(words), (word == F.col("_of")) & (F.col("_bits").bitwiseAND(bit) != 0), "left_semi")


def repeated_lines(docs: DataFrame, characters: int = 8, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, gone): for each document with lines to remove, their numbers from 0, in order.

    Lines are what newlines separate, compared as they are. Two lines are near copies if their sets of runs of
    `characters` characters (a shorter line is one run) have 100 * intersection >= percent * union. Of every connected
    group of equal or near lines, the first stays: least doc_id, then least number. Blank lines always stay.

    Bucket minima of one hash give bands; members of a band are paired with its least line, the exact sets verify the
    pairs, and bands that still hold several components are split by differences from a pivot until no pair is left that
    could be similar (all_links). A line is known by its 64-bit hash. Rows that repeat a doc_id count as one document; a
    null doc_id comes before all others. Long lines and texts are read whole; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    where = store(_lines(docs, "doc_id").select("doc_id", "at", "id"))
    # A row for each distinct line: its first place and how often it occurs.
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "at")
    distinct = store(where.groupBy("id").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    pairs = store(candidates(docs.select("text"), _bands(characters, "text"), parts_for(spark, distinct.count() * BANDS * 17)))
    needed = store(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    # Their texts, from their first places alone, so that a common line doesn't meet in one task.
    at = distinct.join(needed, "id", "left_semi").select("id", F.col("first.doc_id").alias("_doc"), F.col("first.at").alias("_at"))
    here = _wanted(_lines(docs, F.col("doc_id").alias("_doc")).withColumnRenamed("at", "_at"), at, ["id", "_doc", "_at"])
    texts = here.groupBy("id").agg(F.min("line").alias("line")).join(needed, "id", "left_semi")
    texts = store(texts.mapInArrow(tidy(_signed(characters)), "id long, line string, sig binary"))
    drop(needed)
    verify = lambda some: _linked(some, texts, characters, percent)
    found = all_links(texts, _bands(characters, "line"), pairs, verify(pairs), lambda ids: texts.join(ids, "id", "left_semi").select("id", F.col("line").alias("text")), lambda column: _line_sets(column, characters), percent, verify)
    drop(texts), drop(pairs)
    # Groups of several occurrences; any other line is the only one of its own.
    grouped = distinct.join(found.withColumnRenamed("node", "id"), "id", "left").filter("n > 1 or component is not null").select("id", "first", F.coalesce("component", "id").alias("group"))
    grouped = store(grouped)
    first = grouped.groupBy("group").agg(F.min("first").alias("first"))
    keep = store(grouped.select("id", "group").join(first, "group").select("id", "first"))
    gone = where.join(keep, "id").filter(~place.eqNullSafe(F.col("first")))
    out = store(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("at")).alias("gone")))
    for df in (where, distinct, grouped, keep):
        drop(df)
    return out


def dedup_lines(docs: DataFrame, characters: int = 8, percent: int = 80, doc_id: str = "doc_id", text: str = "text", n_lines: str = "n_lines", n_removed: str = "n_removed") -> DataFrame:
    """docs with near and exact copies of lines taken out of `text`, and the counts n_lines and n_removed; see repeated_lines.

    Every row and every other column stays. A count whose name the table has already gets underscores after it. A text
    all of whose lines go becomes empty; null stays null with counts of 0. An empty table gives no rows.
    """
    gone = repeated_lines(docs, characters, percent, doc_id, text)
    key, lost = (f"_{n}_{uuid.uuid4().hex}" for n in ("doc", "gone"))
    out = docs.join(gone.select(F.col("doc_id").alias(key), F.col("gone").alias(lost)), F.col(doc_id).eqNullSafe(F.col(key)), "left")
    lines = F.split(F.col(text), "\n")
    # The list of lines is bound to a variable, so that it is made once and looked into by number.
    kept = F.transform(F.array(lines), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col(lost)), lambda i: x[i]), "\n"))[0]
    while n_lines in docs.columns:
        n_lines += "_"
    while n_removed in docs.columns:
        n_removed += "_"
    total = F.when(F.col(text).isNotNull(), F.size(lines)).otherwise(0).cast("long").alias(n_lines)
    removed = F.when(F.col(lost).isNotNull(), F.size(lost)).otherwise(0).cast("long").alias(n_removed)
    return out.select(*(F.when(F.col(lost).isNull(), F.col(text)).otherwise(kept).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns), total, removed)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.col("text").alias("kept_text"))
