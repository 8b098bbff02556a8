"""Media columns in a deduplicated store of content-defined chunks (operator 8)."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import parts_for, prepare, store, text_bytes, text_or_empty
from ._text import mix, splitmix

UNIT = 64
#: A chunk ends after a byte where the gear hash of the last 16 has its lowest 10 bits zero; LEAST and MOST bound its bytes.
MASK, LEAST, MOST = 0x3FF, 256, 8192
GEAR = (splitmix(256, 41) >> np.uint64(32)).astype(np.uint32)
DIGEST = 16
#: Raw bytes that a mapper holds before it sends, and that a row of the store holds.
HELD_BYTES, ROW_BYTES = 32 << 20, 8 << 20
SCHEMA = "part int, kind int, a binary, b binary, c binary, d binary, body binary"
NAMES = ["part", "kind", "a", "b", "c", "d", "body"]
NULL_ID = -(1 << 63)


def _row(*values) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 5
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=NAMES)


def wav(payload: bytes, rate: int = 8000) -> bytes:
    """A mono sound file of 8-bit samples; the payload is its samples."""
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The samples of a file that wav() made; refuses any other."""
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a sound file")
    (size,) = struct.unpack("<I", media[40:44])
    if size != len(media) - 44:
        raise ValueError("the sound file is cut short")
    return media[44:]


def pad(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of UNIT."""
    return text + bytes(-len(text) % UNIT if text else UNIT)


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks. They depend on at most 16 bytes before them, and LEAST keeps those in the chunk."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    with np.errstate(over="ignore"):
        for step in (1, 2, 4, 8):
            more = h.copy()
            more[step:] += h[:-step] << np.uint32(step)
            h = more
    marks = (np.flatnonzero((h & np.uint32(MASK)) == 0) + 1).tolist()
    out, at = [], 0
    for m in [*marks, len(data)]:
        while m - at > MOST:
            at += MOST
            out.append(at)
        if m - at >= LEAST or (m == len(data) and m > at):
            out.append(m)
            at = m
    return out


def _compress(body: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=4).compress(body)


def _expand(body: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(body)


def _chunk_rows(part: int, items: list[tuple[bytes, bytes, set]]):
    """Rows of the store for (digest, bytes, partitions that want them), of about ROW_BYTES each."""
    while items:
        size = take = 0
        while take < len(items) and size < ROW_BYTES:
            size += len(items[take][1])
            take += 1
        some, items = items[:take], items[take:]
        wanted = [sorted(x[2]) for x in some]
        yield _row(
            part, 0, b"".join(x[0] for x in some), np.array([len(x[1]) for x in some], np.uint32).tobytes(), np.array([len(w) for w in wanted], np.uint32).tobytes(),
            np.array([p for w in wanted for p in w], np.uint32).tobytes(), _compress(b"".join(x[1] for x in some)),
        )


def _read_chunks(a: bytes, b: bytes, body: bytes):
    raw, at = _expand(body), 0
    for k, n in enumerate(np.frombuffer(b, np.uint32).tolist()):
        yield a[DIGEST * k : DIGEST * (k + 1)], raw[at : at + n]
        at += n


def _chunker(n_parts: int):
    """Texts to media files to chunks. Chunks go by digest, once a mapper; ordered chunk lists go by document."""

    def run(batches):
        chunks_, lists, held = {}, {}, 0

        def send():
            by_part = {}
            for digest, (body, wanted) in chunks_.items():
                by_part.setdefault(int.from_bytes(digest[:6], "little") % n_parts, []).append((digest, body, wanted))
            for part, items in by_part.items():
                yield from _chunk_rows(part, items)
            for part, docs in lists.items():
                ids, sizes, counts, order, sums = zip(*docs)
                yield _row(part, 1, np.array(ids, np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), np.array(counts, np.uint32).tobytes(), b"".join(order), b"".join(sums))

        for batch in batches:
            ids = np.asarray(batch.column(0))
            places = (mix(ids.astype(np.uint64)) % np.uint64(n_parts)).tolist()
            for doc, place, text in zip(ids.tolist(), places, batch.column(1).to_pylist()):
                raw = text.encode()
                media = wav(pad(raw))
                at, order = 0, []
                for end in cuts(media):
                    body = media[at:end]
                    digest = hashlib.blake2b(body, digest_size=DIGEST).digest()
                    order.append(digest)
                    got = chunks_.get(digest)
                    if got is None:
                        chunks_[digest] = (body, {place})
                        held += len(body)
                    else:
                        got[1].add(place)
                    at = end
                lists.setdefault(place, []).append((doc, len(raw), len(order), b"".join(order), hashlib.sha256(media).digest()))
                held += 16 * len(order)
                if held >= HELD_BYTES:
                    yield from send()
                    chunks_, lists, held = {}, {}, 0
        yield from send()

    return run


def _dedup(table: pa.Table) -> pa.Table:
    """One partition of digests: each chunk once, with all partitions that want it; lists pass through."""
    found: dict[bytes, tuple[bytes, set]] = {}
    out = []
    part = table.column("part")[0].as_py()
    for batch in table.to_batches():
        for row in batch.to_pylist():
            if row["kind"]:
                out.append(_row(*(row[n] for n in NAMES)))
                continue
            counts, wanted, at = np.frombuffer(row["c"], np.uint32).tolist(), np.frombuffer(row["d"], np.uint32).tolist(), 0
            for (digest, body), n in zip(_read_chunks(row["a"], row["b"], row["body"]), counts):
                got = found.get(digest)
                if got is None:
                    found[digest] = (body, set(wanted[at : at + n]))
                else:
                    got[1].update(wanted[at : at + n])
                at += n
    out += _chunk_rows(part, [(k, *v) for k, v in found.items()])
    return pa.Table.from_batches(out)


def _deliver(batches):
    """The store's chunks to the partitions of the documents that list them, once each."""
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"]:
                yield _row(*(row[n] for n in NAMES))
                continue
            counts, wanted, at = np.frombuffer(row["c"], np.uint32).tolist(), np.frombuffer(row["d"], np.uint32).tolist(), 0
            by_part: dict[int, list] = {}
            for (digest, body), n in zip(_read_chunks(row["a"], row["b"], row["body"]), counts):
                for p in wanted[at : at + n]:
                    by_part.setdefault(p, []).append((digest, body, ()))
                at += n
            for p, items in by_part.items():
                yield from _chunk_rows(p, items)


def feature(payload: bytes) -> str:
    """Mean, deviation, zero crossings and entropy of the samples, read as signed around 128."""
    x = np.frombuffer(payload, np.uint8)
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    high = x >= 128
    return f"mean={x.mean():.4f};std={x.std():.4f};crossings={int((high[1:] != high[:-1]).sum())};entropy={-(share * np.log2(share)).sum():.4f}"


def _assemble(table: pa.Table) -> pa.Table:
    """Media files from their ordered chunk lists, verified against their digests; then what is computed from them."""
    have: dict[bytes, bytes] = {}
    lists = []
    for batch in table.to_batches():
        for row in batch.to_pylist():
            if row["kind"]:
                lists.append(row)
            else:
                have.update(_read_chunks(row["a"], row["b"], row["body"]))
    out = [[] for _ in range(8)]
    for row in lists:
        ids, sizes, counts = np.frombuffer(row["a"], np.int64).tolist(), np.frombuffer(row["b"], np.int64).tolist(), np.frombuffer(row["c"], np.uint32).tolist()
        at = 0
        for k, (doc, size, n) in enumerate(zip(ids, sizes, counts)):
            order = row["d"][DIGEST * at : DIGEST * (at + n)]
            at += n
            media = b"".join(have[order[DIGEST * i : DIGEST * (i + 1)]] for i in range(n))
            sha = hashlib.sha256(media)
            if sha.digest() != row["body"][32 * k : 32 * (k + 1)]:
                raise ValueError(f"document {doc}: the chunks don't give back its media")
            payload = samples(media)
            values = (doc, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), sha.hexdigest(), feature(payload))
            for column, v in zip(out, values):
                column.append(v)
    kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
    return pa.table([pa.array(x, k) for x, k in zip(out, kinds)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def write_store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The chunk store: kind 0 rows hold chunks (each digest once), kind 1 rows the documents' ordered chunk lists."""
    spark = prepare(docs.sparkSession)
    n = parts_for(spark, text_bytes(docs, text))
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), text_or_empty(text).alias("text"))
    return store(docs.mapInArrow(_chunker(n), SCHEMA).groupBy("part").applyInArrow(_dedup, SCHEMA))


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of docs, from its media read back: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    A text's bytes, padded with zeros to a positive multiple of 64, are the samples of a sound file. Files are cut where
    a rolling gear hash says, so equal passages give equal chunks; chunks meet by digest in a shuffle and are stored
    once. Then each stored chunk joins the partitions of documents that list it, and the ordered lists rebuild the
    files; one that doesn't match its SHA-256 stops the job. A digest wanted by very many documents travels once to
    each partition.

    Null and empty texts are 64 zero samples. Repeated rows are stored once and returned each; a null doc_id is kept.
    Other columns are ignored; an empty table gives no rows.
    """
    kept = write_store(docs, doc_id, text)
    out = kept.mapInArrow(_deliver, SCHEMA).groupBy("part").applyInArrow(_assemble, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def op8(spark, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"))
