"""Licence detection by ordered signature rules (operator 13)."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._io import prepare
from ._text import LOWER, chunks, span_hashes, word_spans
from .license_rules import RULES, SPAN, Rule
from .ranked import TERM

FOUND = "array<struct<label: string, kind: string, first_word: long, end_word: long, base: boolean, confidence: double>>"
_FOUND = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("base", pa.bool_()), ("confidence", pa.float64())]))


class Gate:
    """The rules by the words that open them, and a first look that finds the anchors among all words of many texts."""

    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.by_anchor: dict[str, list[int]] = defaultdict(list)
        for k, r in enumerate(rules):
            for w in r.words[0]:
                self.by_anchor[w].append(k)
        self.known = frozenset().union(*(x for r in rules for x in r.words))
        words = sorted(self.by_anchor)
        data = np.frombuffer("".join(words).encode(), np.uint8)
        ends = np.cumsum([len(w) for w in words])
        starts = np.concatenate(([0], ends[:-1]))
        self.hashes = np.sort(span_hashes(data, starts, ends))
        self.shape = np.zeros((256, 1 + max(map(len, words))), bool)  # by first byte and length
        self.shape[data[starts], ends - starts] = True
        self.open: dict[frozenset[str], list[int]] = {}

    def anchors(self, data, starts, ends) -> np.ndarray:
        size = ends - starts
        likely = np.flatnonzero(size < self.shape.shape[1])
        likely = likely[self.shape[data[starts[likely]], size[likely]]]
        h = span_hashes(data, starts[likely], ends[likely]) if len(likely) else np.zeros(0, np.uint64)
        return likely[self.hashes[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)] == h]

    def opened(self, present: frozenset[str]) -> list[int]:
        """Rules whose needed words are all present."""
        got = self.open.get(present)
        if got is None:
            ks = {k for w in present for k in self.by_anchor.get(w, ())}
            got = sorted(k for k in ks if all(x & present for x in self.rules[k].words))
            if len(self.open) < 100_000:
                self.open[present] = got
        return got


def matches(rules: list[Rule], which, words: list[str], offset: int = 0) -> list[tuple[int, int, int]]:
    """(rule, first word, word after the last) of each match in a run of words."""
    text = " ".join(words)
    out = []
    for k in which:
        at = number = 0
        for m in rules[k].expression.finditer(text):
            number += text.count(" ", at, m.start())
            at = m.start()
            out.append((k, offset + number, offset + number + m[0].count(" ") + 1))
    return out


def suppress(rules: list[Rule], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The detections that stay, by place. One goes if it lies in the interval of one of a better priority, or of the same
    priority if that is longer or, among equals, of an earlier rule. Those of base rules always stay.

    Sorted so that whatever can hold a detection comes before it, each asks for the furthest end of every priority so far.
    """
    furthest: dict[int, int] = {}
    out = []
    for k, a, b in sorted(found, key=lambda x: (x[1], -x[2], rules[x[0]].priority, x[0])):
        p = rules[k].priority
        if rules[k].base or not any(q <= p and end >= b for q, end in furthest.items()):
            out.append((k, a, b))
        furthest[p] = max(furthest.get(p, 0), b)
    return out


def _spans(anchors: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    """The words within SPAN of an anchor, as merged runs within lo..hi."""
    cut = np.flatnonzero(np.diff(anchors) > 2 * SPAN)
    firsts, lasts = anchors[np.concatenate(([0], cut + 1))], anchors[np.concatenate((cut, [len(anchors) - 1]))]
    return list(zip(np.maximum(firsts - SPAN, lo).tolist(), np.minimum(lasts + SPAN + 1, hi).tolist()))


def _scan_mapper(rules: list[Rule]):
    def run(batches):
        gate = Gate(rules)
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                data = LOWER[data]
                starts, ends, first = word_spans(data, offsets, TERM)
                anchors = gate.anchors(data, starts, ends)
                found: list[list] = [[] for _ in range(hi - lo)]
                of = np.searchsorted(first, anchors, "right") - 1
                for doc in np.unique(of).tolist():
                    hits = []
                    for a, b in _spans(anchors[of == doc], int(first[doc]), int(first[doc + 1])):
                        words = [data[s:e].tobytes().decode() for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())]
                        hits += matches(rules, gate.opened(gate.known.intersection(words)), words, a - int(first[doc]))
                    found[doc] = [(rules[k].label, rules[k].kind, a, b, rules[k].base, rules[k].confidence) for k, a, b in suppress(rules, hits)]
                names = [f.name for f in _FOUND.value_type]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first), pa.int64()), pa.array([[dict(zip(names, x)) for x in f] for f in found], _FOUND)], names=["doc_id", "n_words", "found"]
                )

    return run


def scan(docs: DataFrame, rules: list[Rule] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a row of docs: doc_id, n_words, and its detections in order of place: label, kind, first_word and end_word
    (numbers from 0; the end is the word after the last), base, confidence.

    Words are runs of letters, digits and anything beyond ASCII, with A-Z lower-cased. Every rule names words that its
    matches hold; a first look at all words finds those anchors, and only the words around them are read by the rules
    whose needed words are all there. Each match lies whole in such a run, so whole texts are searched. Overlapping
    detections are settled by suppress(). Every row is settled by itself: nothing is shuffled.

    Null and empty texts have no words and no detections. Rows that repeat are scanned each; a null doc_id is kept; an empty
    table gives no rows; other columns are ignored.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(_scan_mapper(rules), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, found {FOUND}")


def op13(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda d: d["label"]))), ",")
    base = F.filter("found", lambda d: d["base"])
    starts = F.transform(base, lambda d: d["first_word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"),
        labels(F.col("found")).alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )
