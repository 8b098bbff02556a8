"""Exact repeats of word windows, removed by fixed-block anchors (operator 9)."""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import drop, parts_for, prepare, store, text_bytes, text_or_empty
from ._packed import Packer, exchange, groups, schema, unpack
from ._text import chunks, mix, rolling, span_hashes, word_spans

U = np.uint64
#: Bytes of probes for a byte of text: 18 for every word.
PROBE_BYTES = 3
EMPTY = pa.schema([("part", pa.int32()), ("c0", pa.binary()), ("c1", pa.binary())])


def _numbered(data, offsets):
    """Starts and ends of words, the text of each word, and its position there."""
    starts, ends, first = word_spans(data, offsets)
    counts = np.diff(first)
    of = np.repeat(np.arange(len(counts)), counts)
    return starts, ends, first, of, np.arange(len(starts)) - first[of]


def _windows(hashes, k, of, position, counts, which=0):
    """The k-word runs inside single texts: their hashes and the number of their first word."""
    at = np.flatnonzero(position + k <= counts[of])
    return rolling(hashes, k, which)[at], at


def _to_docs(n_parts: int, docs: np.ndarray, places: np.ndarray) -> pa.Table:
    """Places packed for their documents' partitions."""
    packer = Packer(n_parts, 2)
    spread = mix(docs.astype(U))
    return pa.Table.from_batches([*packer.add(spread, docs, places.astype(np.uint32)), *packer.flush()], EMPTY)


def _by_doc(table: pa.Table) -> pa.Table:
    """A row for each document with its distinct places, as uint32 bytes."""
    docs, places = unpack(table, np.int64, np.uint32)
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    lo, hi = groups(docs)
    return pa.table({"doc_id": pa.array(docs[lo], pa.int64()), "places": pa.array([np.unique(places[a:b]).tobytes() for a, b in zip(lo, hi)], pa.binary())})


def _probe_mapper(n_parts: int, window: int):
    block = window // 2

    def run(batches):
        packer = Packer(n_parts, 6)
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for lo, hi, data, offsets in chunks(batch.column(1)):
                starts, ends, first, of, position = _numbered(data, offsets)
                counts = np.diff(first)
                h, at = _windows(span_hashes(data, starts, ends), block, of, position, counts)
                enough = counts[of[at]] >= window
                h, at = h[enough], at[enough]
                doc, pos = ids[lo:hi][of[at]], position[at]
                # Blocks first among equals, so that one entry stands for a hash in this chunk; its repeats are hits already.
                order = np.lexsort((pos % block != 0, h))
                h, doc, pos = h[order], doc[order], pos[order]
                a, b = groups(h)
                size = np.repeat(b - a, b - a)
                lead = np.zeros(len(h), bool)
                lead[a] = True
                known = size > 1
                keep = np.flatnonzero(lead)
                keep = keep[np.argsort(order[keep])]  # text order again: documents then repeat, and compress
                for rows, local in ((keep, 0), (np.flatnonzero(known), 1)):
                    key = h[rows]
                    yield from packer.add(
                        key,
                        (key & U(0xFFFFFFFF)).astype(np.uint32),
                        ((key >> U(56)) & U(0xFF)).astype(np.uint8),
                        doc[rows],
                        (pos[rows] & 0xFFFF).astype(np.uint16),
                        (pos[rows] >> 16).astype(np.uint16),
                        np.full(len(rows), local, np.uint8),
                    )
        yield from packer.flush()

    return run


def _probe_reducer(n_parts: int, window: int):
    block = window // 2

    def run(table: pa.Table) -> pa.Table:
        low, high, doc, pos, more, local = unpack(table, np.uint32, np.uint8, np.int64, np.uint16, np.uint16, np.uint8)
        pos = pos.astype(np.int64) | (more.astype(np.int64) << 16)
        probe = local == 0
        key = low[probe].astype(U) | (high[probe].astype(U) << U(32))
        order = np.argsort(key)
        key, d, p = key[order], doc[probe][order], pos[probe][order]
        a, b = groups(key)
        hit = (b - a) > 1
        if len(a):
            hit &= np.logical_or.reduceat(p % block == 0, a)
        hit = np.repeat(hit, b - a)
        return _to_docs(n_parts, np.concatenate((d[hit], doc[~probe])), np.concatenate((p[hit], pos[~probe])))

    return run


def _window_mapper(n_parts: int, window: int):
    block = window // 2

    def run(batches):
        packer = Packer(n_parts, 5)
        for batch in batches:
            ids, places = np.asarray(batch.column(0)), batch.column(2).to_pylist()
            for lo, hi, data, offsets in chunks(batch.column(1)):
                starts, ends, first, of, position = _numbered(data, offsets)
                counts = np.diff(first)
                hits = [np.frombuffer(places[k], np.uint32).astype(np.int64) + first[k - lo] for k in range(lo, hi)]
                hits = np.concatenate(hits) if hits else np.zeros(0, np.int64)
                # A hit is extended to every window that holds it.
                mark = np.zeros(len(starts) + 1, np.int64)
                np.add.at(mark, np.maximum(hits - (window - block), first[:-1][of[hits]] if len(hits) else hits), 1)
                np.add.at(mark, hits + 1, -1)
                near = np.cumsum(mark[:-1]) > 0
                words = span_hashes(data, starts, ends)
                h, at = _windows(words, window, of, position, counts)
                g = rolling(span_hashes(data, starts, ends, 1), window, 1)[at]
                keep = near[at]
                h, g, at = h[keep], (g[keep] >> U(32)).astype(np.uint32), at[keep]
                doc, pos = ids[lo:hi][of[at]], position[at].astype(np.uint32)
                order = np.lexsort((pos, doc, g, h))
                h, g, doc, pos = h[order], g[order], doc[order], pos[order]
                again = np.zeros(len(h), bool)
                if len(h):
                    again[1:] = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
                yield from packer.add(h, h, g, doc, pos, again.astype(np.uint8))
        yield from packer.flush()

    return run


def _window_reducer(n_parts: int):
    def run(table: pa.Table) -> pa.Table:
        h, g, doc, pos, again = unpack(table, U, np.uint32, np.int64, np.uint32, np.uint8)
        order = np.lexsort((pos, doc, g, h))
        h, g, doc, pos = h[order], g[order], doc[order], pos[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        lead = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))
        repeat = (doc != doc[lead]) | (pos != pos[lead])
        return _to_docs(n_parts, doc[repeat], pos[repeat])

    return run


def _removal(window: int):
    def run(batches):
        for batch in batches:
            ids, texts, places = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            totals, removed, kept = [], [], []
            for text, repeats in zip(texts, places):
                words = (text or "").encode().split()
                gone = 0
                totals.append(len(words))
                if repeats:
                    mark = np.zeros(len(words) + window + 1, np.int64)
                    at = np.frombuffer(repeats, np.uint32).astype(np.int64)
                    mark[at] += 1
                    mark[at + window] -= 1
                    stay = np.cumsum(mark)[: len(words)] == 0
                    gone = len(words) - int(stay.sum())
                    words = compress(words, stay)
                removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([ids, pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, window: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, n_words, n_removed, kept_text (its words left, joined by single spaces).

    A word goes if a window of `window` words over it also starts earlier: in a smaller doc_id, or in the same
    document. Words are runs of anything but the six ASCII white-space characters.

    Every document's blocks (half a window, at multiples of their length) are indexed, and every run of that length
    probes them, whole corpus against whole corpus: a repeated window holds a whole block, so both its places are
    hit. A hit is extended to all windows that hold it; their 96-bit hashes decide, over all documents, which
    occurrence is the first. Runs of repeated windows make up the maximal repeats.

    Null and empty texts give no words. A document of fewer words than a window keeps all. A row repeated with the same
    doc_id and text is the same occurrence and is not removed against itself; rows of one doc_id must have one text. A
    null doc_id counts as the smallest one. Other columns are ignored; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    n = parts_for(spark, PROBE_BYTES * text_bytes(docs, text))
    null = -(1 << 63)
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(null)).alias("doc_id"), text_or_empty(text).alias("text"))
    gathered = "doc_id long, places binary"

    hits = exchange(docs, _probe_mapper(n, window), 6, _probe_reducer(n, window), schema(2))
    hits = store(hits.groupBy("part").applyInArrow(_by_doc, gathered))
    near = docs.join(hits, "doc_id").select("doc_id", "text", "places")
    repeats = exchange(near, _window_mapper(n, window), 5, _window_reducer(n), schema(2))
    repeats = store(repeats.groupBy("part").applyInArrow(_by_doc, gathered))
    drop(hits)
    out = docs.join(repeats, "doc_id", "left").select("doc_id", "text", "places").mapInArrow(_removal(window), "doc_id long, n_words long, n_removed long, kept_text string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != null, F.col("doc_id")))


def op9(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
