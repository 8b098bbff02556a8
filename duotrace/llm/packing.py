"""Mixture-controlled packing of token sequences (operator 5)."""

from __future__ import annotations

import json
import re
import string
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._io import prepare, store, text_or_empty
from ._packed import tidy

LENGTH, END = 4096, 2
#: Word pieces a Python worker remembers before it starts anew.
REMEMBERED = 400_000
#: Slices of a queue whose places are found apart.
SLICES = 1024
#: The places of source queues in partitions are broadcast up to this many rows (about 60 bytes each).
BROADCAST_ROWS = 500_000
#: Texts with these are given to the tokenizer whole; any other falls apart at ASCII white space.
WHOLE = re.compile(rb"<\||[\x1c-\x1f]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The steps before the merges for which a text's ids are its words' ids: case and kinds of white space don't count, and runs of letters, digits and runs of signs stand alone.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
SIGNS = string.punctuation.encode()


class Encoder:
    """Token ids of texts; each distinct word is tokenized once where the tokenizer's own steps allow it (by_word), and texts whole otherwise."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind, self.code = np.dtype("<u4" if wide else "<u2"), "I" if wide else "H"
        own = json.loads(self.tokenizer.to_str())
        steps = [(own.get(k) or {}).get(v) for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        plain = own["model"]["type"] == "BPE" and own["model"].get("dropout") is None and all(t["content"].startswith("<|") for t in own["added_tokens"])
        self.by_word = steps == [NORMALIZERS, SPLITTERS] and plain and not any(own[k] for k in ("truncation", "padding"))
        self.known: dict[bytes, bytes] = {}

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, word: bytes) -> bytes:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        if word.isalpha():  # lower-case ASCII letters, which the steps before the merges leave as they are
            ids = array(self.code, [t.id for t in self.model.tokenize(word.decode())]).tobytes()
        else:
            stem = word.rstrip(SIGNS)
            if stem and stem != word and (stem[-1:].isalnum() or stem.decode().lower()[-1].isalpha()):
                signs = word[len(stem) :]
                ids = (known.get(stem) or self._learn(stem)) + (known.get(signs) or self._learn(signs))
            else:
                ids = self._ids(word.decode())
        known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        raw = text.encode()
        if not self.by_word or WHOLE.search(raw):
            return self._ids(text)
        get, learn = self.known.get, self._learn
        return b"".join([get(w) or learn(w) for w in raw.lower().split()])


_encoders: dict[str, Encoder] = {}


def _tokenize(path: str):
    """Rows (doc_id, source, part, first, n, ids): first counts the source's tokens earlier in this partition."""

    def run(batches):
        from pyspark import TaskContext

        encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
        part, so_far = TaskContext.get().partitionId(), {}
        end = np.array([END], encoder.kind).tobytes()
        for batch in batches:
            first, size, ids = [], [], []
            for text, source in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                ids.append(encoder.encode(text) + end)
                size.append(len(ids[-1]) // encoder.kind.itemsize)
                first.append(so_far.get(source, 0))
                so_far[source] = first[-1] + size[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([part] * len(ids), pa.int32()), pa.array(first, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "source", "part", "first", "n", "ids"],
            )

    return run


class Schedule:
    """Which tokens of which queue fill which window: deficit round-robin in closed form.

    Queue s earns weight_s / sum(weights) of every window. After w windows it has been served its earnings to within a
    token; the fraction is its deficit and goes on to the next window, so windows can be filled in any partition.
    Every window is full, save the last. A queue that cannot earn a whole window's share any more gives what is left, and
    from then on the others share its part.
    """

    def __init__(self, totals: list[int], weights: list[int], length: int = LENGTH):
        self.length, count = length, len(totals)
        self.spans = []  # (first window, end window, served before, cumulative weights) or, for a single window, (.., .., .., None, given)
        served, at, live = [0] * count, 0, [s for s in range(count) if totals[s]]
        while live:
            left = sum(totals[s] - served[s] for s in live)
            if left <= length:
                self.spans.append((at, at + 1, served, None, [totals[s] - served[s] for s in range(count)]))
                break
            cum, total = [0], sum(weights[s] for s in live)
            for s in range(count):
                cum.append(cum[-1] + (weights[s] if s in live else 0))
            # The most windows for which no queue is asked for more than it has.
            run = min((totals[s] - served[s]) * total // (length * weights[s]) for s in live) + 2
            while run and any(self._due(cum, s, run, length) > totals[s] - served[s] for s in live):
                run -= 1
            if run:
                self.spans.append((at, at + run, served, cum, None))
                served = [served[s] + (self._due(cum, s, run, length) if s in live else 0) for s in range(count)]
                at += run
            else:  # one window in which the short queues give their rest
                given, room, rest = [0] * count, length, list(live)
                while True:
                    share = sum(weights[s] for s in rest)
                    short = [s for s in rest if (totals[s] - served[s]) * share <= room * weights[s]]
                    if not short:
                        break
                    for s in short:
                        given[s] = totals[s] - served[s]
                        room -= given[s]
                    rest = [s for s in rest if s not in short]
                    if not rest:
                        break
                before, so_far = 0, 0
                for s in rest:
                    so_far += weights[s]
                    given[s] = room * so_far // share - before
                    before += given[s]
                self.spans.append((at, at + 1, served, None, given))
                served = [a + b for a, b in zip(served, given)]
                at += 1
            live = [s for s in live if totals[s] > served[s]]
        self.ends = [x[1] for x in self.spans]

    @staticmethod
    def _due(cum, s, windows, length):
        return windows * length * cum[s + 1] // cum[-1] - windows * length * cum[s] // cum[-1]

    def window(self, k: int, s: int, w: int) -> tuple[int, int, int]:
        """In span k, window w: queue s gives its tokens from .. to .., the first of them at place .. of the window."""
        first, _, served, cum, given = self.spans[k]
        if given is not None:
            return served[s], served[s] + given[s], sum(given[:s])
        n, length, total = w - first, self.length, cum[-1]
        a0, b0 = n * length * cum[s] // total, (n + 1) * length * cum[s] // total
        a1, b1 = n * length * cum[s + 1] // total, (n + 1) * length * cum[s + 1] // total
        return served[s] + a1 - a0, served[s] + b1 - b0, b0 - a0

    def find(self, s: int, token: int) -> tuple[int, int]:
        """The span and window that hold a token of queue s."""
        lo, hi = 0, len(self.spans) - 1
        while lo < hi:  # the last span before which no more than `token` tokens were served
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if self.spans[mid][2][s] <= token else (lo, mid - 1)
        first, end, served, cum, given = self.spans[lo]
        if given is not None:
            return lo, first
        w = first + min(max((token - served[s]) * cum[-1] // (self.length * (cum[s + 1] - cum[s])), 0), end - 1 - first)
        while self.window(lo, s, w)[0] > token:
            w -= 1
        while self.window(lo, s, w)[1] <= token:
            w += 1
        return lo, w

    def pieces(self, s: int, token: int, n: int):
        """(start, length, window, offset) of the pieces of n tokens of queue s from `token` on."""
        done = 0
        k, w = self.find(s, token)
        while done < n:
            low, high, offset = self.window(k, s, w)
            take = min(high - token, n - done)
            if take > 0:
                yield done, take, w, offset + token - low
                done += take
                token += take
            w += 1
            if w >= self.spans[k][1]:
                k += 1


def _cut(schedule, kind):
    def run(batches):
        plan = schedule.value
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc, n, raw, s, first in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "ids", "queue", "at"))):
                ids = np.frombuffer(raw, kind).astype("<u4").tobytes()
                for start, size, w, offset in plan.pieces(s, first, n):
                    for column, x in zip(out, (doc, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)]), n, w, offset)):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, targets: dict[str, float] | None = None, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's tokens and an end token are cut into pieces, and pieces packed into sequences of 4096 tokens, so that
    each sequence holds the sources in their target proportions (by default their shares of all tokens, so that all
    sources last to the end). Only the last sequence may be shorter. Sources whose share is under one token a sequence
    are one queue, in which their blocks (a partition's tokens of a source) come by the share of their source that has
    gone before, so each is in proportion to a block; there are at most 4096 queues, and nothing is left out.

    A partition's documents queue in its order, partitions in theirs. Null and empty texts are one end token. A null
    source is a source of its own; repeated rows are packed each; other columns are ignored; an empty table gives no rows.
    """
    spark = prepare(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"), F.concat(F.when(F.col(source).isNull(), "n").otherwise("s"), F.coalesce(F.col(source), F.lit(""))).alias("source"))
    rows = store(rows.mapInArrow(tidy(_tokenize(path)), "doc_id long, source string, part int, first long, n long, ids binary"))
    sizes = store(rows.groupBy("source", "part").agg(F.sum("n").alias("n")))
    by_source = sizes.groupBy("source").agg(F.sum("n").alias("n"))
    total = by_source.agg(F.sum("n")).first()[0] or 0
    if targets is None:
        weight = F.col("n")
        whole = total
    else:
        aims = {f"s{k}": max(1, round(v * 1_000_000)) for k, v in targets.items()}
        weight = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in aims.items() for x in kv)), F.col("source")), F.lit(0)).cast("long")
        whole = sum(aims.values())
    large = {r["source"]: (r["n"], r["w"]) for r in by_source.select("source", "n", weight.alias("w")).filter(F.col("w") * LENGTH >= whole).collect()}  # at most LENGTH rows
    names = sorted(large)
    totals, weights = [large[x][0] for x in names], [large[x][1] for x in names]
    rest = total - sum(totals)
    if rest:
        totals.append(rest)
        weights.append(max(whole - sum(weights), -(-whole // LENGTH)))
    plan = spark.sparkContext.broadcast(Schedule(totals, weights))

    queues = spark.createDataFrame([(x, k) for k, x in enumerate(names)], "source string, queue int")
    places = sizes.join(F.broadcast(queues), "source", "left").withColumn("queue", F.coalesce("queue", F.lit(len(names))))
    # A queue takes its sources' blocks (their tokens of a partition) by how much of their own source has gone before, so
    # that sources that share a queue stay in proportion to a block. Only sums of SLICES slices meet in a queue's window.
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    gone = places.withColumn("gone", ahead / F.sum("n").over(Window.partitionBy("source"))).withColumn("slice", F.floor(F.col("gone") * SLICES))
    earlier = Window.partitionBy("queue").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = gone.groupBy("queue", "slice").agg(F.sum("n").alias("m")).select("queue", "slice", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("queue", "slice").orderBy("gone", "source", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = (F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("base")
    places = store(gone.join(slices, ["queue", "slice"]).select("source", "part", "queue", base))
    few = places.count() <= BROADCAST_ROWS
    placed = rows.join(F.broadcast(places) if few else places, ["source", "part"])
    kind = "<u2" if Encoder(path).kind.itemsize == 2 else "<u4"
    out = placed.select("doc_id", "n", "ids", "queue", (F.col("base") + F.col("first")).alias("at"))
    return out.mapInArrow(_cut(plan, kind), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op5(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
