"""Ranked lexical search by a threshold-seeded join (operator 11)."""

from __future__ import annotations

import string
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._io import drop, prepare, store, text_or_empty
from ._text import LOWER, chunks, span_hashes, word_spans

U = np.uint64
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM = np.ones(256, bool)
TERM[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
#: Items and (item, term) pairs that are broadcast at a time (24 bytes a pair); more items are searched in further blocks.
BLOCK_ITEMS, BLOCK_PAIRS = 20_000, 1_000_000
#: Numbers that a step of the scoring holds at most, if a single document doesn't exceed it.
STEP = 4_000_000
NULL_ID = (1 << 63) - 1
POSTINGS = "doc_id long, n long, terms binary, counts binary"


def terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERMS), F.lit(0)), lambda t: F.translate(t, string.ascii_uppercase, string.ascii_lowercase))


def _hashed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each term, as the mappers make them."""
    ends = np.cumsum([len(w.encode()) for w in words])
    data = np.frombuffer("".join(words).encode(), np.uint8)
    starts = np.concatenate(([0], ends[:-1]))
    return span_hashes(data, starts, ends), span_hashes(data, starts, ends, 1)


class Block:
    """The items of a block, ready for scoring: pairs (item, term) with each item's terms by falling upper bound.

    A document whose best-placed term of an item stands at some pair scores at most `suffix` there: the sum of the largest
    impacts from that pair to the item's end. Pairs whose suffix is below the item's threshold make no candidates.
    """

    def __init__(self, item: np.ndarray, term: np.ndarray, weight: np.ndarray, most: np.ndarray, kth: np.ndarray, n_items: int):
        bound = (weight * most)[term]
        order = np.lexsort((term, -bound, item))
        self.item, self.term, bound = item[order], term[order], bound[order]
        self.weight, self.n_items, self.n_terms = weight, n_items, len(weight)
        self.at = np.searchsorted(self.item, np.arange(n_items + 1))
        total = np.concatenate(([0], np.cumsum(bound)))
        self.suffix = total[self.at[self.item + 1]] - total[:-1]
        self.least = np.ones(n_items, np.int64)  # a score has to be above 0
        np.maximum.at(self.least, self.item, (weight * kth)[self.term])
        self.by_term = np.argsort(self.term, kind="stable")
        self.term_of = self.term[self.by_term]


def impacts(counts: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10**9 * tf) div (1000 * tf + 20 * m), m = 50 + (50 * n * N) div L: a term's impact without its weight."""
    return 1_000_000_000 * counts // (1000 * counts + 20 * (50 + (50 * lengths * n_docs) // n_terms))


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the ranges lo..hi, and the range of each."""
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + lo[of], of


def _read(batch: pa.RecordBatch):
    """ids, n, and the postings of a batch: the row of each, its term and its count."""
    held = [np.frombuffer(x.as_py(), np.int32) for x in batch.column(2)], [np.frombuffer(x.as_py(), np.int32) for x in batch.column(3)]
    size = np.array([len(x) for x in held[0]], np.int64)
    term, count = (np.concatenate(x).astype(np.int64) if len(x) else np.zeros(0, np.int64) for x in held)
    return np.asarray(batch.column(0)), np.asarray(batch.column(1)), np.repeat(np.arange(len(size)), size), term, count


def _postings_mapper(vocabulary):
    def run(batches):
        first, second = vocabulary.value
        order = np.argsort(first)
        first, second = first[order], second[order]
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for lo, hi, data, offsets in chunks(batch.column(1)):
                data = LOWER[data]
                starts, ends, at = word_spans(data, offsets, TERM)
                n = np.diff(at)
                h = span_hashes(data, starts, ends)
                k = np.searchsorted(first, h)
                hit = np.flatnonzero(first[np.minimum(k, len(first) - 1)] == h) if len(first) else np.zeros(0, np.int64)
                if len(hit):
                    hit = hit[second[k[hit]] == span_hashes(data, starts[hit], ends[hit], 1)]
                of = np.searchsorted(at, hit, "right") - 1
                key, count = np.unique(of * len(order) + order[k[hit]], return_counts=True) if len(hit) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                term, count = (key % max(len(order), 1)).astype(np.int32), count.astype(np.int32)
                cut = np.searchsorted(key // max(len(order), 1), np.arange(hi - lo + 1))
                rows = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi][rows], pa.int64()), pa.array(n[rows], pa.int64()), *(pa.array([x[cut[r] : cut[r + 1]].tobytes() for r in rows], pa.binary()) for x in (term, count))],
                    names=["doc_id", "n", "terms", "counts"],
                )

    return run


def _best_mapper(k: int, n_docs: int, n_terms: int):
    """A task's document frequency of each term, and the k largest impacts."""

    def run(batches):
        frequency, held = {}, {}
        for batch in batches:
            _, n, row, term, count = _read(batch)
            r = impacts(count, n[row], n_docs, n_terms)
            order = np.lexsort((-r, term))
            term, r = term[order], r[order]
            which, lo, size = np.unique(term, return_index=True, return_counts=True)
            for t, a, m in zip(which.tolist(), lo.tolist(), size.tolist()):
                frequency[t] = frequency.get(t, 0) + m
                best = r[a : a + min(m, k)]
                held[t] = np.sort(np.concatenate((held[t], best)))[::-1][:k] if t in held else best.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([frequency[t] for t in held], pa.int64()), pa.array([held[t].tolist() for t in held], pa.list_(pa.int64()))], names=["term", "df", "best"])

    return run


def _best(item, doc, score, k):
    """The k best rows of each item, sorted: larger scores first, smaller ids among equals."""
    order = np.lexsort((doc, -score, item))
    item, doc, score = item[order], doc[order], score[order]
    place = np.arange(len(item)) - np.searchsorted(item, item)
    keep = place < k
    return item[keep], doc[keep], score[keep]


def candidates(block: Block, least: np.ndarray, row: np.ndarray, term: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) pairs of documents that hold a term of the item whose suffix bound reaches the item's threshold."""
    live = block.by_term[block.suffix[block.by_term] >= least[block.item[block.by_term]]]
    of = block.term[live]
    pair, posting = _expand(np.searchsorted(of, term), np.searchsorted(of, term, "right"))
    met = np.zeros((n_rows, block.n_items), bool)
    met[row[posting], block.item[live[pair]]] = True
    return np.nonzero(met)


def _score_mapper(shared, k: int, n_docs: int, n_terms: int):
    def run(batches):
        block: Block = shared.value
        least = block.least.copy()
        held = (np.zeros(0, np.int64),) * 3
        step = max(1, STEP // max(block.n_items, block.n_terms, len(block.item), 1))
        for batch in batches:
            ids, n, row, term, count = _read(batch)
            weighed = block.weight[term] * impacts(count, n[row], n_docs, n_terms)
            for lo in range(0, len(ids), step):
                a, b = np.searchsorted(row, (lo, lo + step))
                size = min(step, len(ids) - lo)
                doc, item = candidates(block, least, row[a:b] - lo, term[a:b], size)
                if not len(doc):
                    continue
                dense = np.zeros((size, block.n_terms), np.int64)
                dense[row[a:b] - lo, term[a:b]] = weighed[a:b]
                pair, of = _expand(block.at[item], block.at[item + 1])
                score = np.add.reduceat(dense[doc[of], block.term[pair]], np.searchsorted(of, np.arange(len(doc))))
                good = score >= least[item]
                if good.any():
                    held = _best(*(np.concatenate(x) for x in zip(held, (item[good], ids[lo + doc[good]], score[good]))), k)
                    full, last = np.unique(held[0], return_counts=True)
                    ends = np.cumsum(last) - 1
                    np.maximum.at(least, full[last == k], held[2][ends[last == k]])  # k documents here reach this already
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held], names=["item", "doc_id", "score"])

    return run


def _blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """items with `block`, so that no block exceeds the bounds unless it is a single item."""
    count, pairs = items.agg(F.count("*"), F.sum(F.size("terms"))).first()
    n = max(1, -(-count // BLOCK_ITEMS), -(-(pairs or 0) // BLOCK_PAIRS))
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n)))
        over = F.sum(F.size("terms")) > BLOCK_PAIRS
        if n == 1 or not dealt.groupBy("block").agg(F.count("*").alias("c"), over.alias("over")).filter(f"c > 1 and (over or c > {BLOCK_ITEMS})").take(1):
            return dealt, n
        n *= 2


def _search_block(spark: SparkSession, docs: DataFrame, block: list, id_type, k: int) -> DataFrame:
    vocabulary = sorted({t for r in block for t in r["terms"]})
    number = {t: i for i, t in enumerate(vocabulary)}
    postings = store(docs.mapInArrow(_postings_mapper(spark.sparkContext.broadcast(_hashed(vocabulary) if vocabulary else (np.zeros(0, U),) * 2)), POSTINGS))
    n_docs, n_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    # Stored for each term: its df, its largest impacts. Two levels, so that no group holds a row of every task.
    top = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c)), asc=False), 1, k)
    best = postings.mapInArrow(_best_mapper(k, n_docs, n_terms), "term long, df long, best array<long>")
    best = best.groupBy("term", (F.spark_partition_id() % 64).alias("salt")).agg(F.sum("df").alias("df"), top("best").alias("best"))
    best = best.groupBy("term").agg(F.sum("df").alias("df"), top("best").alias("best"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    seeds = best.select("term", weight.alias("weight"), F.col("best")[0].alias("most"), F.coalesce(F.get("best", F.lit(k - 1)), F.lit(0)).alias("kth")).toPandas()  # a row a term of the block
    held = np.zeros((3, len(vocabulary)), np.int64)
    held[:, seeds["term"].to_numpy(np.int64)] = seeds[["weight", "most", "kth"]].to_numpy(np.int64).T

    item = np.repeat(np.arange(len(block)), [len(r["terms"]) for r in block])
    term = np.array([number[t] for r in block for t in r["terms"]], np.int64)
    shared = spark.sparkContext.broadcast(Block(item, term, *held, len(block)))
    found = postings.mapInArrow(_score_mapper(shared, k, n_docs, n_terms), "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(block)], f"item long, item_id {id_type}")
    out = store(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))  # as many names as the block's items
    drop(postings)
    return out


def search(docs: DataFrame, items: DataFrame, k: int = 50, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The k best documents of each item, by weighed and length-normalised term counts: item_id, rank, doc_id, score.

    One pass over the texts keeps each document's counts of the items' terms. From these come every term's weight and its
    k largest impacts. k documents reach a term's kth impact, so the largest of an item's is a lower bound of its kth
    score. An item's terms stand by falling largest impact; those whose bounds to the end sum to less than the threshold
    are pruned, as a document with no other term can't be among the k. Documents that hold an unpruned term join the item
    and are scored exactly, over all terms. A task's own k best raise its threshold as it goes.

    The items are broadcast in blocks of bounded size, each searched against all documents. Terms are told apart by 128
    bits of hash. Null or empty text has no terms: such documents count nowhere, such items find nothing. Only scores
    above 0 are listed. Equal scores go by ascending doc_id; a null doc_id comes last. Each row of docs is a document of
    its own, also where rows repeat a doc_id (they all count and are all listed). Rows that repeat an item_id make up one
    item with the terms of all; a null item_id is such an item too. Empty tables give no rows; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).alias("text"))
    kind = items.schema[item_id].dataType.simpleString()
    words = items.select(F.col(item_id).alias("item_id"), F.explode(F.array_distinct(terms(text_or_empty(text)))).alias("term")).distinct()
    dealt, n = _blocks(store(words.groupBy("item_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))))
    parts = [_search_block(spark, docs, block, kind, k) for b in range(n) if (block := dealt.filter(F.col("block") == b).select("item_id", "terms").collect())]  # bounded by BLOCK_*
    if not parts:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def op11(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
