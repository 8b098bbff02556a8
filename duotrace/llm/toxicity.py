"""Toxicity by a counterfactually regularised classifier (operator 4)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import LEAST_PARTS, prepare, store, text_or_empty
from ._packed import Packer, exchange, groups, tidy, unpack
from ._text import BYTE_VALUES, LOWER, SPACE, chunks, mix

U = np.uint64
#: The classifier is fitted on up to this many labelled rows, those with the least hash of their doc_id.
FIT_ROWS = 16_384
#: Features: runs of so many bytes of the lower-cased text, white space as spaces, one before each text. Of those in at
#: least SEEN fitted texts, the FEATURES with the greatest information gain are kept.
RUNS, SEEN, LEAST_G, FEATURES = (5, 6, 7), 5, 15.0, 4096
#: Weight of the squared change of logit under a swap of group terms, and of the squared weights.
COUNTERFACTUAL, RIDGE = 1.0, 2e-4
TABLE_BITS = 20
A, B = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
SPACED = LOWER.copy()
SPACED[SPACE] = 32

# Words for groups of people, in rows of words that can stand for one another.
GROUP_TERMS = [
    ["women", "men"], ["woman", "man"], ["girls", "boys"], ["girl", "boy"], ["she", "he"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["black", "white", "asian", "latino", "arab", "african", "european", "american"],
    ["gay", "straight", "lesbian", "bisexual", "heterosexual", "transgender"],
    ["immigrants", "refugees", "foreigners", "locals"], ["immigrant", "refugee", "foreigner", "local"],
    ["disabled", "deaf", "blind"], ["old", "young"], ["elderly", "teenagers"],
    ["frauen", "männer"], ["muslime", "christen", "juden"], ["ausländer", "einheimische"],
    ["femmes", "hommes"], ["musulmans", "chrétiens", "juifs"],
    ["mujeres", "hombres"], ["musulmanes", "cristianos", "judíos"], ["inmigrantes", "extranjeros"],
]
SWAPS = {row[i]: row[(i + 1) % len(row)] for row in GROUP_TERMS for i in range(len(row))}
TERM = re.compile(r"\b(?:" + "|".join(sorted(SWAPS, key=len, reverse=True)) + r")\b")


def swap_terms(text: str) -> str:
    """The text with each group term replaced by the next of its row."""
    return TERM.sub(lambda m: SWAPS[m[0]], text.lower())


def run_hashes(data: np.ndarray) -> dict[int, np.ndarray]:
    """For each run length, the hash of the run from each byte on (the last few run past the end and are void)."""

    def join(x, y, by):
        out = x * A
        out[: max(0, len(y) - by)] += y[by:] * B
        return out ^ (out >> U(29))

    with np.errstate(over="ignore"):
        one = BYTE_VALUES[0][data]
        two = join(one, one, 1)
        four = join(two, two, 2)
        return {5: join(four, one, 4), 6: (six := join(four, two, 4)), 7: join(six, one, 6)}


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts lower-cased, white space as spaces, with one before each."""
    return np.insert(SPACED[data], offsets[:-1], 32), offsets + np.arange(len(offsets))


def text_features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct features."""
    flat, where = _spaced(data, offsets)
    hashes = run_hashes(flat)
    return [np.unique(np.concatenate([hashes[n][a : max(a, b - n + 1)] for n in RUNS])) for a, b in zip(where[:-1], where[1:])]


class Finder:
    """Finds which of a set of features a text has."""

    def __init__(self, features: np.ndarray):
        self.features = features  # sorted
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(features >> U(64 - TABLE_BITS)).astype(np.int64)] = True

    def find(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature) numbers, each pair once, in order of texts."""
        flat, where = _spaced(data, offsets)
        texts, found = [], []
        for n, h in run_hashes(flat).items():
            at = np.flatnonzero(self.table[(h >> U(64 - TABLE_BITS)).astype(np.int64)])
            k = np.searchsorted(self.features, h[at])
            k[k == len(self.features)] = 0
            text = np.searchsorted(where, at, "right") - 1
            good = (self.features[k] == h[at]) & (at + n <= where[text + 1]) if len(self.features) else np.zeros(len(at), bool)
            texts.append(text[good])
            found.append(k[good])
        pairs = np.unique(np.concatenate(texts) * (len(self.features) + 1) + np.concatenate(found))
        return pairs // (len(self.features) + 1), pairs % (len(self.features) + 1)


def _count_mapper(n_parts: int):
    def run(batches):
        packer = Packer(n_parts, 3)
        for batch in batches:
            labels = np.asarray(batch.column(1).to_pylist(), bool)
            for lo, hi, data, offsets in chunks(batch.column(0)):
                sets = text_features(data, offsets)
                flat = np.concatenate(sets)
                toxic = np.repeat(labels[lo:hi], [len(s) for s in sets])
                order = np.argsort(flat, kind="stable")
                flat, toxic = flat[order], toxic[order]
                a, b = groups(flat)
                if len(a):
                    yield from packer.add(mix(flat[a]), flat[a], np.add.reduceat(toxic.astype(np.int32), a).astype(np.int32), (b - a).astype(np.int32))
        yield from packer.flush()

    return run


def _gain(seen: np.ndarray, toxic: np.ndarray, all_: int, all_toxic: int) -> np.ndarray:
    """Information that having the feature gives about the label, in nats a text."""

    def term(x, row, column):
        return np.where(x > 0, x / all_ * np.log(np.maximum(x, 1e-9) * all_ / np.maximum(row * column, 1e-9)), 0.0)

    rest = all_ - seen
    return term(toxic, seen, all_toxic) + term(seen - toxic, seen, all_ - all_toxic) + term(all_toxic - toxic, rest, all_toxic) + term(rest - (all_toxic - toxic), rest, all_ - all_toxic)


def _count_reducer(all_: int, all_toxic: int):
    def run(table: pa.Table) -> pa.Table:
        key, toxic, seen = unpack(table, U, np.int32, np.int32)
        order = np.argsort(key, kind="stable")
        key, toxic, seen = key[order], toxic[order].astype(np.int64), seen[order].astype(np.int64)
        a, _ = groups(key)
        key, toxic, seen = key[a], np.add.reduceat(toxic, a), np.add.reduceat(seen, a)
        often = seen >= SEEN
        key, gain = key[often], _gain(seen[often], toxic[often], all_, all_toxic)
        key, gain = key[2 * all_ * gain >= LEAST_G], gain[2 * all_ * gain >= LEAST_G]
        best = np.lexsort((key, -gain))[:FEATURES]
        return pa.table({"feature": pa.array(key[best].view(np.int64), pa.int64()), "gain": pa.array(gain[best], pa.float64())})

    return run


def _sample_rows(finder):
    """(toxic, features, features after swapping group terms) of each text."""

    def run(batches):
        f = finder.value
        for batch in batches:
            swapped = pa.array([swap_terms(t) for t in batch.column(0).to_pylist()], pa.string())
            sides = []
            for column in (batch.column(0), swapped):
                lists = []
                for lo, hi, data, offsets in chunks(column):
                    text, k = f.find(data, offsets)
                    cut = np.searchsorted(text, np.arange(hi - lo + 1))
                    lists += [k[a:b].astype(np.uint16).tobytes() for a, b in zip(cut[:-1], cut[1:])]
                sides.append(pa.array(lists, pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(batch), pa.int32()), batch.column(1), *sides], names=["one", "toxic", "plain", "swapped"])

    return run


def fit(toxic: np.ndarray, plain: list[np.ndarray], swapped: list[np.ndarray], width: int, steps: int = 400) -> np.ndarray:
    """Weights of `width` features and, last, the intercept.

    Least mean logistic loss + COUNTERFACTUAL * mean squared change of logit under the swap + RIDGE * squared weights, by
    Adam with a falling step over all rows.
    """
    n = max(len(toxic), 1)
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    w = np.zeros(width + 1)
    w[-1] = np.log(share / (1 - share))
    if not width or not len(toxic) or toxic.min() == toxic.max():
        return w
    row = np.repeat(np.arange(len(plain)), [len(x) for x in plain])
    column = np.concatenate(plain).astype(np.int64)
    changed = [k for k in range(len(plain)) if len(plain[k]) != len(swapped[k]) or (plain[k] != swapped[k]).any()]
    c_row = np.repeat(np.arange(len(changed)), [len(plain[k]) + len(swapped[k]) for k in changed])
    c_column = np.concatenate([np.concatenate((plain[k], swapped[k])) for k in changed]).astype(np.int64) if changed else np.zeros(0, np.int64)
    c_sign = np.concatenate([np.repeat((1.0, -1.0), (len(plain[k]), len(swapped[k]))) for k in changed]) if changed else np.zeros(0)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, weights=w[column], minlength=len(plain)) + w[-1]
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - toxic
        g = np.append(np.bincount(column, weights=error[row], minlength=width), error.sum()) / n
        if changed:
            shift = np.bincount(c_row, weights=c_sign * w[c_column], minlength=len(changed))
            g[:width] += 2 * COUNTERFACTUAL / n * np.bincount(c_column, weights=c_sign * shift[c_row], minlength=width)
        g[:width] += 2 * RIDGE * w[:width]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _fit_group(width: int):
    def run(table: pa.Table) -> pa.Table:
        lists = [[np.frombuffer(x, np.uint16) for x in table.column(c).to_pylist()] for c in ("plain", "swapped")]
        w = fit(np.asarray(table.column("toxic").to_pylist(), float), *lists, width)
        return pa.table({"k": pa.array(range(width + 1), pa.int32()), "w": pa.array(w, pa.float64())})

    return run


class Model:
    def __init__(self, features: np.ndarray, weights: np.ndarray):
        self.finder, self.weights = Finder(features), weights

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, k = self.finder.find(data, offsets)
        return np.bincount(text, weights=self.weights[k], minlength=len(offsets) - 1) + self.weights[-1]


def train(docs: DataFrame, labels: DataFrame, use: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A classifier from labelled texts whose labels row satisfies `use`: at most FIT_ROWS of them, whole texts.

    Null labels and ids are passed over; a doc_id that is labelled twice is toxic if any label is 1. With no rows (an empty
    table of documents or labels), or one class only, the model is the smoothed share of toxic rows. Very long texts are
    read whole. Only features that SEEN fitted texts have, with a gain of LEAST_G and among the FEATURES best, are weighted:
    rarer ones are left out, as too few labels speak for them.
    """
    spark = prepare(docs.sparkSession)
    rows = labels.filter(use & F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    rows = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)
    body = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    sample = store(body.join(F.broadcast(store(rows)), "id").select("text", "toxic"))
    all_, toxic = (int(x or 0) for x in sample.agg(F.count("*"), F.sum("toxic")).first())
    features = np.zeros(0, U)
    if toxic and toxic < all_:
        counted = exchange(sample, _count_mapper(LEAST_PARTS), 3, _count_reducer(all_, toxic), "feature long, gain double")
        best = counted.orderBy(F.desc("gain"), "feature").limit(FEATURES).collect()
        features = np.sort(np.array([r["feature"] for r in best], np.int64).view(U))
    finder = spark.sparkContext.broadcast(Finder(features))
    gathered = sample.mapInArrow(tidy(_sample_rows(finder)), "one int, toxic int, plain binary, swapped binary")
    weights = gathered.groupBy("one").applyInArrow(_fit_group(len(features)), "k int, w double").orderBy("k").collect()  # at most FIT_ROWS rows of a few numbers
    return Model(features, np.array([r["w"] for r in weights]) if weights else fit(np.zeros(0), [], [], 0))


def _score(model):
    def run(batches):
        m = model.value
        for batch in batches:
            z = [m.logits(data, offsets) for _, _, data, offsets in chunks(batch.column(1))]
            z = np.concatenate(z) if z else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))), pa.float64())], names=["doc_id", "score"])

    return run


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row of docs: the probability that label 1 holds. Only the text counts.

    Null and empty texts get the score of a text without any feature; repeated rows are scored alike; a null doc_id is
    kept; very long texts are read whole; an empty table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    m = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text")).mapInArrow(tidy(_score(m)), "doc_id long, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows whose labels are not learnt from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def op4(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scores = score_toxicity(docs, train(docs, labels, ~held_out()))
    return scores.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
