"""Language-model scores from a probabilistic suffix tree (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import drop, parts_for, prepare, store, text_bytes, text_or_empty
from ._packed import Packer, exchange, groups, tidy, unpack
from ._text import LOWER, chunks, mix, span_hashes, word_spans

U = np.uint64
#: Symbols are the bytes of a text's words, joined by single spaces and ended by a newline (no word holds either).
#: Contexts have up to DEPTH of them; a text begins after DEPTH newlines.
DEPTH = 5
END_WORD = U(0xE0D)  # stands for the end token among word hashes
#: A context is a candidate if it occurs this often in the training symbols, however many those are.
LEAST = 2
#: It is retained if its next-symbol distribution diverges from its suffix's by this many nats in all (count times divergence).
DIVERGENCE = 3.0
#: Bytes of runs and counts for a byte of text, at most.
GRAM_BYTES = 4
#: Words, or bytes of symbols, that a mapper encodes as one block; a longer text is a block of its own.
BLOCK_TOKENS, BLOCK_BYTES = 400_000, 5 << 19


def _streams(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    body = LOWER[data].tobytes()
    at = offsets.tolist()
    return [b"\n" * DEPTH + b" ".join(body[a:b].split()) + b"\n" for a, b in zip(at, at[1:])]


def runs(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Every text's runs of DEPTH + 1 symbols in order (a text of n symbols has n - DEPTH), packed into numbers, the next symbol lowest."""
    flat = flat.astype(U)
    two = (flat[:-1] << U(8)) | flat[1:]
    six = (two[:-4] << U(32)) | (two[2:-2] << U(16)) | two[4:]
    keep = np.ones(len(six), bool)
    ends = np.cumsum(lengths)[:-1]
    for k in range(DEPTH):  # runs that end in a later text's opening newlines predict nothing
        keep[ends + k - DEPTH] = False
    return six[keep]


def _blocks(batches, entries, size: int, names: list[str], packed):
    """Rows of texts (id, text, train) to blocks: entries() gives parts of one and how much they are; packed() the row of a full block."""
    from pyspark import TaskContext

    task, serial, held, rows = TaskContext.get().partitionId(), 0, [], 0

    def block():
        columns = [pa.array([x.tobytes()], pa.binary()) for x in packed(*zip(*held))]
        return pa.RecordBatch.from_arrays([pa.array([(task << 32) + serial], pa.int64()), *columns], names=["block", *names])

    for batch in batches:
        ids, train = np.asarray(batch.column(0)), np.asarray(batch.column(2).to_pylist(), bool)
        for lo, hi, data, offsets in chunks(batch.column(1), BLOCK_BYTES):
            *part, n = entries(data, offsets)
            held.append((ids[lo:hi], train[lo:hi], *part))
            rows += n
            if rows >= size:
                yield block()
                serial, held, rows = serial + 1, [], 0
    if held:
        yield block()


def _word_blocks(batches):
    """A block's words with their training counts, and its documents as numbers of those words."""

    def entries(data, offsets):
        low = LOWER[data]
        starts, ends, first = word_spans(low, offsets)
        h = np.insert(span_hashes(low, starts, ends), first[1:], END_WORD)
        return np.diff(first) + 1, h, len(h)

    def packed(ids, train, sizes, words):
        ids, train, sizes, words = (np.concatenate(x) for x in (ids, train, sizes, words))
        vocabulary, inverse = np.unique(words, return_inverse=True)
        counts = np.bincount(inverse, weights=np.repeat(train, sizes), minlength=len(vocabulary))
        return vocabulary, counts.astype(np.uint32), ids, sizes.astype(np.uint32), inverse.astype(np.uint32)

    return _blocks(batches, entries, BLOCK_TOKENS, ["words", "counts", "docs", "sizes", "tokens"], packed)


def _symbol_blocks(batches):
    """A block's documents as symbols."""

    def entries(data, offsets):
        streams = _streams(data, offsets)
        return streams, sum(map(len, streams))

    def packed(ids, train, streams):
        streams = [x for some in streams for x in some]
        return np.concatenate(ids), np.frombuffer(b"".join(streams), np.uint8), np.array([len(x) for x in streams], np.uint32), np.concatenate(train).astype(np.uint8)

    return _blocks(batches, entries, BLOCK_BYTES, ["docs", "symbols", "lengths", "train"], packed)


def _count_mapper(n_parts: int):
    def run(batches):
        packer = Packer(n_parts, 4)
        for batch in batches:
            for block, words, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "counts"))):
                h, n = np.frombuffer(words, U), np.frombuffer(counts, np.uint32)
                yield from packer.add(mix(h), h, n, np.full(len(h), block, np.int64), np.arange(len(h), dtype=np.uint32))
        yield from packer.flush()

    return run


def _count_reducer(table: pa.Table) -> pa.Table:
    """Each block's words of this partition with their counts over all blocks; a row of block -1 has the partition's training tokens and distinct words."""
    h, n, block, place = unpack(table, U, np.uint32, np.int64, np.uint32)
    order = np.argsort(h, kind="stable")
    lo, hi = groups(h[order])
    total = np.add.reduceat(n[order].astype(np.int64), lo)
    count = np.empty(len(h), np.int64)
    count[order] = np.repeat(total, hi - lo)
    order = np.argsort(block, kind="stable")
    block, place, count = block[order], place[order], count[order]
    a, b = groups(block)
    return pa.table(
        {
            "block": pa.array([*block[a].tolist(), -1], pa.int64()),
            "places": pa.array([*(place[x:y].tobytes() for x, y in zip(a, b)), None], pa.binary()),
            "totals": pa.array([*(count[x:y].tobytes() for x, y in zip(a, b)), None], pa.binary()),
            "tokens": pa.array([*([0] * len(a)), int(total.sum())], pa.int64()),
            "distinct": pa.array([*([0] * len(a)), int((total > 0).sum())], pa.int64()),
        }
    )


def _base(batches):
    for batch in batches:
        docs_, known_, sum_, size_ = [], [], [], []
        for docs, sizes, tokens, found in zip(*(batch.column(c).to_pylist() for c in ("docs", "sizes", "tokens", "found"))):
            docs, sizes, tokens = np.frombuffer(docs, np.int64), np.frombuffer(sizes, np.uint32).astype(np.int64), np.frombuffer(tokens, np.uint32)
            count = np.zeros(int(tokens.max()) + 1 if len(tokens) else 0, np.int64)
            for f in found:
                count[np.frombuffer(f["places"], np.uint32)] = np.frombuffer(f["totals"], np.int64)
            first = np.cumsum(sizes) - sizes
            docs_.append(docs), size_.append(sizes)
            known_.append(np.add.reduceat((count > 0).astype(np.int64)[tokens], first))
            sum_.append(np.add.reduceat(np.log10(count + 1.0)[tokens], first))
        if docs_:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(docs_), pa.int64()), pa.array(np.concatenate(size_), pa.int64()), pa.array(np.concatenate(known_), pa.int64()), pa.array(np.concatenate(sum_), pa.float64())],
                names=["doc_id", "n_tokens", "n_known", "logs"],
            )


def _texts(batch):
    """Each block's number, runs, which of them are training, and each document's count of runs."""
    for block, symbols, lengths, train in zip(*(batch.column(c).to_pylist() for c in ("block", "symbols", "lengths", "train"))):
        lengths = np.frombuffer(lengths, np.uint32).astype(np.int64)
        yield block, runs(np.frombuffer(symbols, np.uint8), lengths), np.repeat(np.frombuffer(train, np.uint8) > 0, lengths - DEPTH), lengths - DEPTH


def _sums(x: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, lo) if len(lo) else x[:0]


def _last(key: np.ndarray, symbols: int) -> np.ndarray:
    return key & U((1 << (8 * symbols)) - 1)


def _short_counts(batches):
    """How often runs of three symbols occur in training texts."""
    keys, times = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for batch in batches:
        for _, six, train, _ in _texts(batch):
            key, n = np.unique(_last(six[train], 3).astype(np.uint32), return_counts=True)
            keys.append(key), times.append(n)
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(inverse, weights=np.concatenate(times), minlength=len(key)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64), pa.int64()), pa.array(n, pa.int64())], names=["gram", "n"])


class Short:
    """Contexts of up to two symbols: the alphabet bounds their number (65,793), not the corpus.

    A distribution is smoothed towards the suffix's in proportion to the distinct symbols seen (the empty context's towards uniform).
    """

    def __init__(self, gram: np.ndarray, n: np.ndarray):
        order = np.argsort(gram)
        gram, n = gram[order].astype(U), n[order].astype(float)
        counts = np.bincount(gram.astype(np.int64) & 0xFF, weights=n, minlength=256)
        self.empty = (counts + 1) / (counts.sum() + 256)
        self.levels: list[tuple[np.ndarray, ...]] = []
        for d in (1, 2):
            g, inverse = np.unique(_last(gram, d + 1), return_inverse=True)
            times = np.bincount(inverse, weights=n, minlength=len(g))
            below, _ = self.look(g)
            lo, hi = groups(g >> U(8))
            total = _sums(times, lo)
            gain = _sums(times * np.log(times / np.repeat(total, hi - lo) / below), lo)
            self.levels.append((g, times, g[lo] >> U(8), total, (hi - lo).astype(float), (total >= LEAST) & (gain >= DIVERGENCE)))

    def look(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each run's smoothed probability by all levels so far, and the log10 that the longest retained context gives."""
        p = self.empty[(gram & U(0xFF)).astype(np.int64)]
        log = np.log10(p)
        for d, (grams, times, contexts, total, kinds, kept) in enumerate(self.levels, 1):
            if not len(grams):
                continue
            g = _last(gram, d + 1)
            at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
            n = np.where(grams[at] == g, times[at], 0.0)
            at = np.minimum(np.searchsorted(contexts, g >> U(8)), len(contexts) - 1)
            known = (contexts[at] == g >> U(8)) & (total[at] >= LEAST)
            p = np.where(known, (kinds[at] * p + n) / (total[at] + kinds[at]), p)
            log = np.where(known & kept[at], np.log10(p), log)
        return p, log


def gram_logs(key: np.ndarray, n: np.ndarray, short: Short) -> np.ndarray:
    """log10 probability of each run's last symbol after the others; sorted distinct runs with their training counts (0: only scored), all of the last three context symbols that occur."""
    three, inverse = np.unique(_last(key, 3), return_inverse=True)
    p, log = (x[inverse] for x in short.look(three))
    for d in range(3, DEPTH + 1):
        gram, inverse = np.unique(_last(key, d + 1), return_inverse=True)
        times = np.bincount(inverse, weights=n, minlength=len(gram))
        below = np.empty(len(gram))
        below[inverse] = p
        lo, hi = groups(gram >> U(8))
        total, kinds = (np.repeat(_sums(x, lo), hi - lo) for x in (times, (times > 0).astype(float)))
        known = total >= LEAST
        seen = times > 0
        parts_ = np.zeros(len(gram))
        parts_[seen] = times[seen] * np.log(times[seen] / total[seen] / below[seen])
        kept = known & (np.repeat(_sums(parts_, lo), hi - lo) >= DIVERGENCE)
        now = np.where(known, (kinds * below + times) / np.maximum(total + kinds, 1), below)
        p = now[inverse]
        log = np.where(kept[inverse], np.log10(p), log)
    return log


def _homes(key: np.ndarray, n_parts: int) -> np.ndarray:
    """Runs go by the last three symbols of their contexts."""
    return ((mix((key >> U(8)) & U(0xFFFFFF)) >> U(32)) % U(n_parts)).astype(np.int32)


def _planes(key: np.ndarray) -> bytes:
    """Six bytes a run, all first bytes before all second ones, which compresses well when sorted."""
    return np.ascontiguousarray(key.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].T).tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(6, -1).T
    return out.view(">u8").ravel().astype(U)


def _gram_mapper(n_parts: int):
    """A row for each block and partition: the block's distinct runs that belong there, sorted, with training counts."""

    def run(batches):
        for batch in batches:
            for block, six, train, _ in _texts(batch):
                seen, times = np.unique(six[train], return_counts=True)
                key = np.unique(six)
                n = np.zeros(len(key), np.uint32)
                n[np.searchsorted(key, seen)] = times
                home = _homes(key, n_parts)
                order = np.argsort(home, kind="stable")
                key, n, home = key[order], n[order], home[order]
                lo, hi = groups(home)
                spans = list(zip(lo.tolist(), hi.tolist()))
                columns = [pa.array(home[lo], pa.int32()), pa.array([block] * len(lo), pa.int64()), pa.array([_planes(key[a:b]) for a, b in spans], pa.binary()), pa.array([n[a:b].tobytes() for a, b in spans], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "block", "grams", "times"])

    return run


def _gram_reducer(short):
    """Builds the part of the tree whose contexts end here, and answers every block with its runs' logs, in the order received.

    Every block sends the runs of a frequent context, which can't be dealt to several parts. So batches are summed into one
    table as they come, and of what came only the runs are kept until it is whole, compressed: blocks repeat each other's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, held = np.zeros(0, U), np.zeros(0), []
        for batch in batches:
            grams = batch.column("grams").to_pylist()
            times = np.frombuffer(b"".join(batch.column("times").to_pylist()), np.uint32)
            key, inverse = np.unique(np.concatenate([key, *map(_unplanes, grams)]), return_inverse=True)
            n = np.bincount(inverse, weights=np.concatenate([n, times]), minlength=len(key))
            ends = np.cumsum([len(x) for x in grams]).tolist()
            held.append((batch.column("part").to_numpy(), batch.column("block").to_numpy(), ends, pa.compress(b"".join(grams), codec="zstd", asbytes=True)))
        del inverse, grams, times, batch
        logs = gram_logs(key, n, short.value).astype(np.float32)
        for part, block, ends, packed in held:
            grams = pa.decompress(packed, ends[-1], codec="zstd", asbytes=True)
            answers = [logs[np.searchsorted(key, _unplanes(grams[a:b]))].tobytes() for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(block, pa.int64()), pa.array(answers, pa.binary())], names=["part", "block", "logs"])

    return tidy(run)


def _adder(n_parts: int):
    """Documents' scores from the logs that came back for their block."""

    def run(batches):
        for batch in batches:
            for (_, six, _, counts), docs, found in zip(_texts(batch), batch.column("docs").to_pylist(), batch.column("found").to_pylist()):
                key, inverse = np.unique(six, return_inverse=True)
                home = _homes(key, n_parts)
                order = np.argsort(home, kind="stable")
                cuts = np.searchsorted(home[order], np.arange(n_parts + 1))
                logs = np.empty(len(key))
                for f in found:
                    logs[order[cuts[f["part"]] : cuts[f["part"] + 1]]] = np.frombuffer(f["logs"], np.float32)
                scores = np.add.reduceat(logs[inverse], np.cumsum(counts) - counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(docs, np.int64)), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score_texts(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a doc_id: n_tokens, n_known, train_tokens, base_score, score; learnt from the rows where `train` holds.

    base_score is the add-one unigram log10 probability over words and one end token; score is the suffix tree's
    log10 probability of the same tokens, spelled out. Word and symbol counts come from every training text; words are
    known by 64-bit hashes. A context is retained if it occurs LEAST times and passes the divergence test, so the tree
    grows with the corpus; its contexts of three symbols or more lie in partitions by their last three, to which every
    block sends its distinct runs for their log10 probabilities. Every symbol is predicted by its longest retained context.

    Null and empty texts are a single end token. With no training text, every word is unknown and the tree uniform.
    Rows that repeat a doc_id with the same text give one row; a null doc_id counts as an id. Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    n = parts_for(spark, GRAM_BYTES * text_bytes(docs, text))  # also where answers meet their blocks, so that a task gathers as few blocks' answers however many there are
    null = -(1 << 63)
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(null)).alias("doc_id"), text_or_empty(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    blocks = store(docs.mapInArrow(tidy(_word_blocks), "block long, words binary, counts binary, docs binary, sizes binary, tokens binary"))
    found = store(exchange(blocks.select("block", "words", "counts"), _count_mapper(n), 4, _count_reducer, "block long, places binary, totals binary, tokens long, distinct long"))
    tokens, distinct = (int(x or 0) for x in found.agg(F.sum("tokens"), F.sum("distinct")).first())
    per_block = found.filter("block <> -1").repartition(n, "block").groupBy("block").agg(F.collect_list(F.struct("places", "totals")).alias("found"))
    base = store(blocks.select("block", "docs", "sizes", "tokens").join(per_block, "block").mapInArrow(tidy(_base), "doc_id long, n_tokens long, n_known long, logs double"))

    drop(found), drop(blocks)
    texts = store(docs.mapInArrow(tidy(_symbol_blocks), "block long, docs binary, symbols binary, lengths binary, train binary"))
    rows = texts.mapInArrow(tidy(_short_counts), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    short = spark.sparkContext.broadcast(Short(*(rows.column(c).to_numpy() for c in ("gram", "n"))))
    packed = texts.mapInArrow(tidy(_gram_mapper(n)), "part int, block long, grams binary, times binary")
    logs = store(packed.groupBy("part").applyInArrow(_gram_reducer(short), "part int, block long, logs binary"))
    per_block = logs.repartition(n, "block").groupBy("block").agg(F.collect_list(F.struct("part", "logs")).alias("found"))
    scores = store(texts.join(per_block, "block").mapInArrow(tidy(_adder(n)), "doc_id long, score double"))
    drop(logs), drop(texts)
    joined = base.unionByName(scores, allowMissingColumns=True).groupBy("doc_id").agg(*(F.max(c).alias(c) for c in ("n_tokens", "n_known", "logs", "score")))
    return joined.select(
        F.when(F.col("doc_id") != null, F.col("doc_id")).alias("doc_id"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(tokens + distinct + 1)))).alias("base_score"),
        "score",
    )


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    out = score_texts(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
