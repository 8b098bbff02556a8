"""The trie of conversations' shared beginnings, totalled by leaf peeling (operator 12)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import drop, prepare, store, text_or_empty
from ._text import BASES, mix

U = np.uint64
HEADS, BLOCK = 5, 100
CHAIN = "conv_id long, depth long, p0 long, p1 long, q0 long, q1 long, chars long, ends boolean"


def ordered(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), digest (of role and text), chars (code points): turns in order, null first; ties go by digest."""
    r, t = text_or_empty(role), text_or_empty(text)
    digest = F.unhex(F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)))
    rows = turns.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.char_length(t).cast("long").alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", F.row_number().over(order).alias("pos"), "digest", "chars")


def head_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its block of 100: 0 to HEADS."""
    return F.crc32(conv_id.cast("string")) % (HEADS + 1)


def graft(turns: DataFrame) -> DataFrame:
    """Ordered turns, each conversation's first h replaced by those of the first conversation of its block, if it has them.

    Every conversation also has a row of pos 0 without a digest, so that those left without a turn still count.
    """
    ids = turns.filter("pos = 1").select("conv_id", head_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"))
    heads = turns.filter((F.col("conv_id") % BLOCK == 0) & (F.col("pos") <= HEADS)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("head"))
    taken = ids.join(heads, "base").select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("h").cast("int"))).alias("t")).select("conv_id", "t.*")
    roots = ids.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    own = turns.filter(F.col("pos") > head_turns(F.col("conv_id")))
    return roots.unionByName(taken).unionByName(own)


def whole(turns: DataFrame) -> DataFrame:
    """Ordered turns with the rows of pos 0 that prefix_trie() needs, and no grafting."""
    return turns.unionByName(turns.filter("pos = 1").select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars")))


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    out, b, e = np.ones(len(exponent), U), U(base), exponent.astype(U)
    with np.errstate(over="ignore"):
        while e.any():
            out = np.where(e & U(1), out * b, out)
            b, e = b * b, e >> U(1)
    return out


def _chains(batches):
    """Rows sorted by conversation and pos: each with its depth and the 128-bit hashes of its own and its parent's sequence.

    Only the last row's state is carried from batch to batch, so a conversation may be of any length. A row is sent once
    the next one shows whether it ends its conversation.
    """
    last = None  # conversation, depth, both sums
    waiting = None  # columns of the row that hasn't been sent

    def sent(columns, ends):
        conv, depth, own, parent, chars = columns
        signed = [pa.array(x.view(np.int64), pa.int64()) for x in (*own, *parent)]
        return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), *signed, pa.array(chars, pa.int64()), pa.array(ends, pa.bool_())], names=[x.split()[0] for x in CHAIN.split(", ")])

    for batch in batches:
        if not batch.num_rows:
            continue
        conv, chars = np.asarray(batch.column(0)), np.asarray(batch.column(3))
        digest = np.frombuffer(b"".join(x or bytes(16) for x in batch.column(2).to_pylist()), U).reshape(-1, 2)
        new = np.concatenate(([last is None or conv[0] != last[0]], conv[1:] != conv[:-1]))
        start = np.maximum.accumulate(np.where(new, np.arange(len(conv)), 0))
        depth = np.arange(len(conv)) - start
        first = ~np.logical_or.accumulate(new)  # rows that go on with the conversation of the last batch
        if last is not None:
            depth = np.where(first, depth + last[1] + 1, depth)
        own, parent = [], []
        with np.errstate(over="ignore"):
            for lane in range(2):
                term = np.where(depth > 0, mix(digest[:, lane] ^ U(lane + 1)) * _power(BASES[lane], depth), U(0))
                total = np.cumsum(term, dtype=U)
                run = total - np.where(first, U(0), (total - term)[start]) + np.where(first, U(0) if last is None else last[2 + lane], U(0))
                own.append(run)
                parent.append(run - term)
        last = (conv[-1], depth[-1], own[0][-1], own[1][-1])
        columns = (conv, depth, own, parent, chars)
        if waiting is not None:
            conv, depth, own, parent, chars = columns = (
                np.concatenate((waiting[0], conv)), np.concatenate((waiting[1], depth)), [np.concatenate(x) for x in zip(waiting[2], own)], [np.concatenate(x) for x in zip(waiting[3], parent)], np.concatenate((waiting[4], chars)),
            )
        if len(conv) > 1:
            yield sent((conv[:-1], depth[:-1], [x[:-1] for x in own], [x[:-1] for x in parent], chars[:-1]), conv[:-1] != conv[1:])
        waiting = (conv[-1:], depth[-1:], [x[-1:] for x in own], [x[-1:] for x in parent], chars[-1:])
    if waiting is not None:
        yield sent(waiting, np.ones(1, bool))


def _end_hashes(batches):
    """Rows sorted by node and conversation: SHA-256 of each node's comma-joined ids, fed as they come."""
    node, state = None, None

    def out(done):
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in done], pa.int64()), pa.array([k[1] for k, _ in done], pa.int64()), pa.array([s.hexdigest() for _, s in done], pa.string())], names=["p0", "p1", "ends_sha256"])

    for batch in batches:
        done = []
        p0, p1, ids = (np.asarray(batch.column(i)) for i in range(3))
        cuts = np.flatnonzero((p0[1:] != p0[:-1]) | (p1[1:] != p1[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
            if lo == hi:
                continue
            said = ",".join(map(str, ids[lo:hi].tolist())).encode()
            if node == (p0[lo], p1[lo]):
                state.update(b"," + said)
            else:
                if node is not None:
                    done.append((node, state))
                node, state = (p0[lo], p1[lo]), hashlib.sha256(said)
        if done:
            yield out(done)
    if node is not None:
        yield out([(node, state)])


def peel(paths: DataFrame) -> DataFrame:
    """(path, parent, leaves, saved) to every path's totals with all paths below it: path, leaves, saved.

    Each path holds a counter of the paths that hang on it and haven't reported. Those whose counter is 0 send their totals
    to their parents, summed on the way; a parent takes them in and, once its counter is 0, sends in the next round. Only
    paths that still wait are rewritten. The root's path is the last to finish.
    """
    below = paths.filter("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("waits"))
    now = store(paths.join(below, "path", "left").withColumn("waits", F.coalesce("waits", F.lit(0))))
    rounds = [now]
    while now.filter("waits > 0").take(1):
        sent = now.filter("waits = 0 and parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n"), F.sum("leaves").alias("more"), F.sum("saved").alias("extra"))
        zero = F.lit(0)
        now = store(
            now.filter("waits > 0").join(sent, "path", "left")
            .select("path", "parent", (F.col("leaves") + F.coalesce("more", zero)).alias("leaves"), (F.col("saved") + F.coalesce("extra", zero)).alias("saved"), (F.col("waits") - F.coalesce("n", zero)).alias("waits"))
        )
        rounds.append(now)
    done = rounds[0].filter("waits = 0")
    for r in rounds[1:]:
        done = done.unionByName(r.filter("waits = 0"))
    out = store(done.select("path", "leaves", "saved"))
    for r in rounds:
        drop(r)
    return out


def prefix_trie(turns: DataFrame) -> DataFrame:
    """A row for each distinct sequence of first turns: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256. turns: as ordered() with whole() or graft() gives them.

    Sequences are told apart by 128-bit hashes, summed along each conversation. A node is named by its smallest member and
    its depth, so the nodes of one smallest member are a path without a gap; it hangs on a node of a smaller member's path.
    Leaves are peeled path by path: a conversation of any length then finishes in one round, and there are as many rounds
    as paths hang on one another. What a path's nodes get is then summed from its end upwards.

    Null role or text is the empty string. Null turns come first; turns that tie (repeated rows too) are all kept, in the
    order of their digests. Rows of null conv_id belong to no conversation and are left out. A conversation that grafting
    leaves without a turn is a member of the root alone. An empty table has no root. Further columns are ignored. One
    conversation's turns are sorted and summed in one task, as a stream; nothing else is bound to a conversation or node.
    """
    prepare(turns.sparkSession)
    rows = store(turns.select("conv_id", "pos", "digest", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "pos").mapInArrow(_chains, CHAIN))
    nodes = rows.groupBy("p0", "p1", "depth").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *(F.max(c).alias(c) for c in ("q0", "q1", "chars")))
    ends = rows.filter("ends").select("p0", "p1", "conv_id").repartition("p0", "p1").sortWithinPartitions("p0", "p1", "conv_id").mapInArrow(_end_hashes, "p0 long, p1 long, ends_sha256 string")
    nodes = store(nodes.join(ends, ["p0", "p1"], "left"))
    drop(rows)
    above = nodes.select(F.col("p0").alias("q0"), F.col("p1").alias("q1"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    linked = nodes.drop("p0", "p1").join(above, ["q0", "q1", "depth"], "left")
    linked = store(linked.select("conv_id", "depth", "parent_conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("chars")).alias("own"), "ends_sha256"))
    drop(nodes)

    hanging = linked.filter("parent_conv_id <> conv_id").select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.col("conv_id").alias("path"))
    hung = hanging.groupBy("conv_id", "depth").agg(F.count("*").alias("hung"))
    down = Window.partitionBy("conv_id").orderBy("depth")
    nodes = linked.join(hung, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("hung", F.lit(0)) + F.lead(F.lit(1), 1, 0).over(down))
    nodes = store(nodes.drop("hung"))
    leaf = (F.col("n_children") == 0).cast("long")
    paths = nodes.groupBy(F.col("conv_id").alias("path")).agg(F.min_by(F.struct("parent_conv_id"), "depth")["parent_conv_id"].alias("parent"), F.sum(leaf).alias("leaves"), F.sum("own").alias("saved"))
    totals = peel(paths)

    got = hanging.join(totals, "path").groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    up = down.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    whole_tree = lambda own, below: F.sum(own + F.coalesce(below, F.lit(0))).over(up)
    return nodes.join(got, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long"), whole_tree(leaf, "leaves").alias("n_leaves"), whole_tree(F.col("own"), "saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op12(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(graft(store(ordered(prepare(spark).read.parquet(f"{sf_dir}/conversations.parquet")))))
