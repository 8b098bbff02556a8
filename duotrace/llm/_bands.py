"""Candidate pairs from band keys, and which of them to test so that no link is lost, without all pairs of a band.

A function `bands(batch)` gives, for a batch of items, two arrays of equal length: the item's number and a 64-bit band key.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._graph import components
from ._io import drop, parts_for, store
from ._packed import Packer, exchange, groups, schema, tidy, unpack
from ._text import mix

U = np.uint64
#: Entries that a mapper lets meet before it sends.
MEET_ROWS = 1_000_000
#: Keys of bands that need a second look are broadcast this many at a time (16 bytes each).
BROADCAST_ROWS = 1_000_000
#: Bands of up to this many items are tested in pairs, and postings of differences with up to this many items that probe them.
LEAF = 16
#: Larger postings are tested against their lightest items this many times before the pairs that are left are tested.
ROUNDS = 1


def _meeting(bands: Callable, most: int = MEET_ROWS):
    """Runs of batches' entries, sorted by key and item."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            got = bands(batch)
            held.append(got)
            rows += len(got[0])
            if rows >= most:
                yield sort(held)
                held, rows = [], 0
        if rows:
            yield sort(held)

    def sort(held):
        item, key = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((item, key))
        return item[order], key[order]

    return run


PAIRS = pa.schema([("part", pa.int32()), ("c0", pa.binary()), ("c1", pa.binary())])


def _star_mapper(bands: Callable, n_parts: int):
    """Bands meet first inside a mapper: members there are paired with their least one, which alone travels on."""

    def run(batches):
        packer = Packer(n_parts, 3)
        for item, key in _meeting(bands)(batches):
            lo, hi = groups(key)
            pairs = _star(item, lo, hi)
            yield from packer.add(key[lo], key[lo], item[lo], np.zeros(len(lo), np.int8))
            yield from packer.add(_spread(pairs), pairs[:, 0].view(U), pairs[:, 1], np.ones(len(pairs), np.int8))
        yield from packer.flush()

    return run


def _star(item: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Each group's members paired with its first."""
    pivot = np.repeat(item[lo], hi - lo) if len(lo) else item[:0]
    off = pivot != item
    return np.unique(np.stack([pivot[off], item[off]], axis=1), axis=0)


def _spread(pairs: np.ndarray) -> np.ndarray:
    return mix(np.ascontiguousarray(pairs[:, 0]).view(U) ^ mix(np.ascontiguousarray(pairs[:, 1]).view(U)))


def _star_reducer(n_parts: int):
    """Pairs of the bands that end here, packed by pair: one pair may come from many bands."""

    def run(table: pa.Table) -> pa.Table:
        x, y, done = unpack(table, U, np.int64, np.int8)
        open_ = done == 0
        order = np.lexsort((y[open_], x[open_]))
        k, d = x[open_][order], y[open_][order]
        pairs = np.concatenate([_star(d, *groups(k)), np.stack([x[~open_].view(np.int64), y[~open_]], axis=1)])
        pairs = np.ascontiguousarray(np.unique(pairs, axis=0))
        packer = Packer(n_parts, 2)
        batches = [*packer.add(_spread(pairs), pairs[:, 0], pairs[:, 1]), *packer.flush()]
        return pa.Table.from_batches(batches, PAIRS)

    return run


def _pair_rows(table: pa.Table) -> pa.Table:
    pairs = np.unique(np.stack(unpack(table, np.int64, np.int64), axis=1), axis=0)
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def candidates(items: DataFrame, bands: Callable, n_parts: int) -> DataFrame:
    """(a, b), each pair once: a band's members paired with its least one (in two steps, so a hot band never meets in one task)."""
    packed = exchange(items, _star_mapper(bands, n_parts), 3, _star_reducer(n_parts), schema(2))
    return packed.groupBy("part").applyInArrow(_pair_rows, "a long, b long")


def _looked_up(batch, item: np.ndarray, column: str) -> np.ndarray:
    ids = np.asarray(batch.column("id"))
    order = np.argsort(ids, kind="stable")
    return np.asarray(batch.column(column))[order[np.searchsorted(ids[order], item)]]


def _mixed_mapper(bands: Callable, n_parts: int):
    """A mapper sends a band's count of items, and its least and greatest component, not the items."""

    def run(batches):
        packer = Packer(n_parts, 4)
        for comp, key in _meeting(bands)(batches):
            lo, hi = groups(key)
            yield from packer.add(key[lo], key[lo], comp[lo], comp[hi - 1], hi - lo)
        yield from packer.flush()

    return run


def _mixed_reducer(table: pa.Table) -> pa.Table:
    key, low, high, n = unpack(table, U, np.int64, np.int64, np.int64)
    order = np.argsort(key, kind="stable")
    key, low, high, n = key[order], low[order], high[order], n[order]
    lo, _ = groups(key)
    if not len(lo):
        return pa.table({"key": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    n = np.add.reduceat(n, lo)
    keep = (n > 2) & (np.minimum.reduceat(low, lo) != np.maximum.reduceat(high, lo))
    return pa.table({"key": pa.array(key[lo][keep].view(np.int64), pa.int64()), "n": pa.array(n[keep], pa.int64())})


class _Table:
    """Numbers by key, broadcast."""

    def __init__(self, df: DataFrame, column: str):
        got = df.toArrow()
        key = got.column("key").to_numpy()
        order = np.argsort(key)
        self.held = df.sparkSession.sparkContext.broadcast((key[order], got.column(column).to_numpy()[order]))

    def of(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys have a number, and those numbers."""
        keys, numbers = self.held.value
        at = np.searchsorted(keys, key)
        at[at == len(keys)] = 0
        known = keys[at] == key
        return known, numbers[at[known]]


def _entries(bands: Callable, sizes: _Table):
    """A row an item that lies in bands of `sizes`: item, component, its small bands' keys, its larger ones' keys, and the sum of their sizes."""

    def run(batches):
        for batch in batches:
            item, key = bands(batch)
            key = key.view(np.int64)
            known, n = sizes.of(key)
            item, key = item[known], key[known]
            order = np.argsort(item, kind="stable")
            item, key, n = item[order], key[order], n[order]
            lo, hi = groups(item)
            few = n <= LEAF
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(kind)))[np.append(lo, len(item))], pa.int32()), pa.array(key[kind], pa.int64())) for kind in (few, ~few)]
            full = np.concatenate(([0], np.cumsum(np.where(few, 0, n))))
            columns = [pa.array(item[lo], pa.int64()), pa.array(_looked_up(batch, item[lo], "component"), pa.int64()), *lists, pa.array(full[hi] - full[lo], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["item", "component", "small", "large", "full"])

    return run


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The row number and key of every larger band of a batch of entries."""
    lists = batch.column("large")
    return np.asarray(lists.value_parent_indices()), np.asarray(lists.flatten(), np.int64)


def _fullest(batches):
    """(key, full, item): of a batch's items in a band, that whose bands are fullest, the least of several."""
    for batch in batches:
        row, key = _flat(batch)
        full, item = (np.asarray(batch.column(c))[row] for c in ("full", "item"))
        order = np.lexsort((item, -full, key))
        lo, _ = groups(key[order])
        first = order[lo]
        yield pa.RecordBatch.from_arrays([pa.array(x[first], pa.int64()) for x in (key, full, item)], names=["key", "full", "item"])


def _favoured(pivots: _Table):
    """(key, p, k): how many of a batch's items in a band have p as the pivot of most of their bands (the greatest of several)."""

    def run(batches):
        for batch in batches:
            row, key = _flat(batch)
            p = pivots.of(key)[1]
            order = np.lexsort((p, row))
            both = np.stack((row, p))[:, order]
            lo = np.flatnonzero(np.append(True, (both[:, 1:] != both[:, :-1]).any(axis=0))) if len(row) else row
            own, p, k = both[0][lo], both[1][lo], np.diff(np.append(lo, len(row)))
            order = np.lexsort((p, k, own))
            last = order[groups(own[order])[1] - 1] if len(own) else order
            best = np.zeros(batch.num_rows, np.int64)
            best[own[last]] = p[last]
            met, k = np.unique(np.stack((key, best[row])), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*met, k)], names=["key", "p", "k"])

    return run


def _met(pivots: _Table):
    """(p, item) for each pivot of an item's bands, and the pivots themselves."""

    def run(batches):
        for batch in batches:
            row, key = _flat(batch)
            p = pivots.of(key)[1]
            both = np.stack((p, np.asarray(batch.column("item"))[row]))
            both = np.unique(np.concatenate((both, np.stack((p, p))), axis=1), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in both], names=["p", "item"])

    return run


def _mixed(items: DataFrame, bands: Callable) -> list[tuple[DataFrame, DataFrame]]:
    """The bands that hold three items or more and several components: stored (item, component, small: keys of bands of up to LEAF items), and
    stored (p, item), the pivots that the item's larger bands have. items: stored, with `id` and `component`.

    A band's size and pivot are looked up by the items, BROADCAST_ROWS bands at a time, so no row is made for an item of a band.
    """
    n_parts = parts_for(items.sparkSession, items.count() * 64 * 32)

    def by_component(batch):
        item, key = bands(batch)
        return _looked_up(batch, item, "component"), key

    mixed = store(exchange(items, _mixed_mapper(by_component, n_parts), 4, _mixed_reducer, "key long, n long"))
    out = []
    blocks = -(-mixed.count() // BROADCAST_ROWS)
    for block in range(blocks):
        sizes = _Table(mixed.filter(F.pmod("key", F.lit(blocks)) == block), "n")
        entries = store(items.mapInArrow(tidy(_entries(bands, sizes)), "item long, component long, small array<long>, large array<long>, full long"))
        of = entries.select("item", "large", "full")
        per = of.mapInArrow(_fullest, "key long, full long, item long").groupBy("key").agg(F.max(F.struct("full", (-F.col("item")).alias("item"))).alias("m"))
        pivots = _Table(per.select("key", (-F.col("m.item")).alias("p")), "p")
        # Bands of one group of copies take one pivot: what most members' bands have, a member of this band or not.
        votes = of.mapInArrow(_favoured(pivots), "key long, p long, k long").groupBy("key", "p").agg(F.sum("k").alias("k"))
        pivots = _Table(votes.groupBy("key").agg(F.max(F.struct("k", "p")).alias("m")).select("key", "m.p"), "p")
        out.append((entries, store(of.mapInArrow(_met(pivots), "p long, item long").distinct())))
    drop(mixed)
    return out


def _diffs(sets: Callable):
    """For rows (p, item, t_p, t_item): sizes of both sets, and the elements that the item's has beyond p's, then those it lacks."""

    def run(batches):
        known: dict[int, np.ndarray] = {}
        for batch in batches:
            p, texts = batch.column(0).to_pylist(), batch.column(2)
            new = [i for i, x in enumerate(p) if x not in known and (i == 0 or p[i - 1] != x)]
            known = {x: known[x] for x in set(p) if x in known}
            known |= {p[i]: s for i, s in zip(new, sets(texts.take(pa.array(new, pa.int64()))))}
            n, added, lacking = [], [], []
            for x, s in zip(p, sets(batch.column(3))):
                base = known[x]
                n.append(len(s))
                added.append(np.setdiff1d(s, base, assume_unique=True).view(np.int64)), lacking.append(np.setdiff1d(base, s, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), _lists(added), _lists(lacking)], names=["p", "item", "n", "added", "lacking"])

    return run


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array(arrays, pa.list_(pa.int64()))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x.values if x.is_valid else [], np.int64) for x in column]


#: A set of differences as 1024 bits; `lost` are the differences that share a bit with another.
BITS = [f"b{k}" for k in range(16)]


def _centred(percent: int):
    """For rows (p, item, n, added, lacking, more, less): the item's differences from the group's centre (p's set with `more` and without `less`), their weight, and their places among 1024 bits."""

    def run(batches):
        for batch in batches:
            out, bits, lost = [[], [], []], np.zeros((batch.num_rows, len(BITS)), U), []
            for k, (n, *some) in enumerate(zip(batch.column("n").to_pylist(), *(_arrays(batch.column(c)) for c in ("added", "lacking", "more", "less")))):
                added, lacking, more, less = some
                beyond = np.concatenate((np.setdiff1d(added, more), np.setdiff1d(less, lacking)))
                short = np.concatenate((np.setdiff1d(lacking, less), np.setdiff1d(more, added)))
                out[0].append((100 + percent) * (len(beyond) + len(short)) - (100 - percent) * n), out[1].append(np.sort(beyond)), out[2].append(np.sort(short))
                place = np.unique(mix(np.concatenate((beyond, short)).view(U)) >> U(54))
                np.bitwise_or.at(bits[k], (place >> U(6)).astype(np.int64), U(1) << (place & U(63)))
                lost.append(len(beyond) + len(short) - len(place))
            columns = [batch.column(0), batch.column(1), pa.array(out[0], pa.int64()), _lists(out[1]), _lists(out[2]), *(pa.array(bits[:, i].view(np.int64)) for i in range(len(BITS))), pa.array(lost, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["p", "item", "weight", "beyond", "short", *BITS, "lost"])

    return run


def _postings(percent: int):
    """For rows (p, item, weight, ranked, low, high): (key, item, p, weight, probe), a row for each difference that a partner must share one of.

    Two items are similar if and only if they share (weight + weight) / (2 * (100 + percent)) differences at least. Of `need` shared
    ones, one lies among the first size - need + 1 of either item's in any common order. `ranked` has them rarest in the
    group first, with how many items have each; what one item alone has takes its place in the order, but makes no row.
    A link not yet found has a misfit on one side; the heavier item probes, and the lighter lists itself once
    for its own class of weights and each heavier one (by powers of two of what such an item needs of the one nearest the
    centre), as a heavier one needs more of it.
    """
    unit = 2 * (100 + percent)

    def run(batches):
        for batch in batches:
            keys, items, pivots, weights, probes = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            columns = (batch.column(c).to_pylist() for c in ("p", "item", "weight", "low", "high"))
            for p, item, weight, low, high, ranked in zip(*columns, batch.column("ranked")):
                held, many = (np.asarray(ranked.values.field(c), np.int64) if ranked.is_valid else np.zeros(0, np.int64) for c in ("e", "k"))
                h = mix(held.view(U) ^ mix(np.array([p], np.int64).view(U)))

                def add(n, kind, probe):
                    some = mix(h[:n][many[:n] > 1] + U(kind))  # noqa: B023
                    m = len(some)
                    keys.append(some), items.append(np.full(m, item)), pivots.append(np.full(m, p)), weights.append(np.full(m, weight)), probes.append(np.full(m, probe))  # noqa: B023

                if weight + low > 0:
                    need = -(-(weight + low) // unit)
                    add(max(len(h) - need + 1, 0), need.bit_length(), True)
                own = max(-(-(weight + low) // unit), 0).bit_length()
                for kind in range(max(own, 1), (-(-(high + low) // unit)).bit_length() + 1):
                    least = weight if kind == own else ((1 << (kind - 1)) - 1) * unit + 1 - low  # of the weights that probe
                    need = max(1, -(-(least + weight) // unit))
                    if len(h) >= need:
                        add(len(h) - need + 1, kind, False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (items, pivots, weights, probes))],
                names=["key", "item", "p", "weight", "probe"],
            )

    return run


def _by_rarity(rows: DataFrame) -> DataFrame:
    """rows (p, item, beyond, short and more) with `ranked`, the item's differences (k, e): e, and the k items of the group that have it; rarest first."""
    each = store(rows.select("p", "item", F.explode(F.concat("beyond", "short")).alias("e")))
    often = each.groupBy("p", "e").agg(F.count("*").alias("k"))
    ranked = each.join(often, ["p", "e"]).groupBy("p", "item").agg(F.sort_array(F.collect_list(F.struct("k", "e"))).alias("ranked"))
    return rows.drop("beyond", "short").join(ranked, ["p", "item"], "left")


def _labelled(rows: DataFrame, found: DataFrame, column: str = "item") -> DataFrame:
    """rows with the component of the item (its own number, if it has no link)."""
    return rows.join(found.withColumnRenamed("node", column), column, "left").withColumn("component", F.coalesce("component", column))


def _across(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) of rows (key, item, component) that meet by key and differ in component."""
    x, y = (df.select("key", F.col("item").alias(n), F.col("component").alias(f"c_{n}")) for df, n in ((left, "x"), (right, "y")))
    met = x.join(y.withColumnRenamed("key", "_key"), (F.col("key") == F.col("_key")) & (F.col("c_x") != F.col("c_y")) & (F.col("x") < F.col("y")))
    return met.select(F.col("x").alias("a"), F.col("y").alias("b"))


def _enough(left: DataFrame, right: DataFrame, percent: int, exactly: bool = False) -> DataFrame:
    """(a, b) of rows (key, item, component, weight and bits) that meet by key, differ in component and may share enough differences: their bits in common, and what shares a bit, bound how many. exactly: the differences themselves are counted too."""
    lists = ["beyond", "short"] if exactly else []
    sides = (df.select("key", *(F.col(c).alias(f"{c}_{n}") for c in ("item", "component", "weight", "lost", *BITS, *lists))) for df, n in ((left, "x"), (right, "y")))
    both = sum((F.bit_count(F.col(f"{b}_x").bitwiseAND(F.col(f"{b}_y"))) for b in BITS), F.least("lost_x", "lost_y"))
    x, y = sides
    right_, on = y.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key")
    enough = lambda shared: 2 * (100 + percent) * shared >= F.col("weight_x") + F.col("weight_y")
    on = on & (F.col("component_x") != F.col("component_y")) & enough(both)
    if exactly:
        on &= enough(sum((F.size(F.array_intersect(f"{c}_x", f"{c}_y")) for c in lists), F.lit(0)))
    met = x.join(right_, on)
    return met.select(F.least("item_x", "item_y").alias("a"), F.greatest("item_x", "item_y").alias("b"))


def _open(rows: DataFrame) -> DataFrame:
    """rows (key, item, component, weight, probe) of the keys under which a probe may meet another component; with m, the key's probes."""
    per = rows.groupBy("key").agg(F.count_if("probe").alias("m"), F.count_if(~F.col("probe")).alias("n"), F.min("component").alias("c"), F.max("component").alias("d"))
    return rows.join(per.filter("m > 0 and n > 0 and c <> d").select("key", "m"), "key")


def _posted(met: DataFrame, texts: Callable, sets: Callable, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b) links to the items nearest the centres, the stored postings of all differences, and these differences, also as bits, for rows (p, item) of large bands, the pivots themselves included."""
    body = store(texts(met.select(F.col("item").alias("id")).distinct()))
    side = lambda x: body.select(F.col("id").alias(x), F.col("text").alias(f"t_{x}"))
    both = met.join(side("item"), "item").join(side("p"), "p").select("p", "item", "t_p", "t_item")
    diffs = store(both.mapInArrow(tidy(_diffs(sets)), "p long, item long, n long, added array<long>, lacking array<long>"))
    drop(body)
    # What most of a group's members have, or lack, against the pivot, its centre has or lacks.
    each = lambda c: diffs.select("p", F.explode(c).alias("e")).groupBy("p", "e").agg(F.count("*").alias("k")).withColumn("kind", F.lit(c))
    size = diffs.groupBy("p").agg(F.count("*").alias("size"))
    # (A group holds its pivot, so what one item alone has is never in most.)
    shared = each("added").unionByName(each("lacking")).filter("k > 1").join(size, "p").filter(2 * F.col("k") > F.col("size"))
    centre = shared.groupBy("p").agg(F.collect_list(F.when(F.col("kind") == "added", F.col("e"))).alias("more"), F.collect_list(F.when(F.col("kind") == "lacking", F.col("e"))).alias("less"))
    out = store(diffs.join(centre, "p", "left").mapInArrow(tidy(_centred(percent)), "p long, item long, weight long, beyond array<long>, short array<long>, " + ", ".join(f"{b} long" for b in BITS) + ", lost long"))
    drop(diffs)
    ends = out.groupBy("p").agg(F.min(F.struct("weight", "item")).alias("least"), F.max("weight").alias("high"))
    ends = ends.select("p", F.col("least.weight").alias("low"), F.col("least.item").alias("near"), "high")
    near = out.join(ends, "p").filter((F.col("weight") + F.col("low") <= 0) & (F.col("item") != F.col("near")))
    links = store(near.select(F.least("item", "near").alias("a"), F.greatest("item", "near").alias("b")).distinct())
    rows = _by_rarity(out.join(ends.filter("high + low > 0").drop("near"), "p").select("p", "item", "weight", "beyond", "short", "low", "high"))
    posted = store(rows.mapInArrow(tidy(_postings(percent)), "key long, item long, p long, weight long, probe boolean"))
    return links, posted, out


def all_links(items: DataFrame, bands: Callable, tested: DataFrame, links: DataFrame, texts: Callable[[DataFrame], DataFrame], sets: Callable, percent: int, verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) of all items with a link: components as if every pair of every band had been tested.

    items: stored, with `id` and what bands() reads; those of `tested`, the stored pairs (a, b) of each band with its least member,
    of which `links` are similar. texts(ids) joins `id` to the text that sets() makes sets of; verify(pairs) keeps similar pairs.

    Bands of up to LEAF items that hold several components have their pairs across components tested. In a larger one every
    member's exact differences from a centre are found: the set of an item whose bands are fullest, corrected to what
    most members have. Members near enough to the centre are similar for sure, and linked. Any other is similar to a member if and
    only if they share enough differences, so these meet by the rarer of their differences, not by the band, and pairs
    whose differences as bits can't overlap enough go. Where many still meet under one, they are tested against the
    lightest member there, up to ROUNDS times, and what is then neither connected nor alone in pairs. So the work goes with the members and their differences, save in groups where many
    members share rare differences and yet are not similar.
    """
    found = components(links)
    labelled = store(_labelled(items, found, "id"))
    mixed = _mixed(labelled, bands)
    drop(labelled)
    if not mixed:
        return found

    def tested_too(pairs: DataFrame) -> None:
        nonlocal found, links, tested
        pairs = store(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
        new = verify(pairs)
        tested = tested.unionByName(pairs)
        if not new.isEmpty():
            links = links.unionByName(new)
            found = components(links)

    entries, met = (reduce(DataFrame.unionByName, x) for x in zip(*mixed))
    small = entries.select("item", "component", F.explode("small").alias("key"))
    pairs = _across(small, small)
    met = met.distinct()
    if met.isEmpty():
        tested_too(pairs)
        return found
    near, posted, differences = _posted(met, texts, sets, percent)
    links = links.unionByName(near)
    found = components(links)
    for turn in range(ROUNDS + 1):
        now = store(_open(_labelled(posted, found)))
        drop(posted)
        few = F.lit(True) if turn == ROUNDS else F.col("m") <= LEAF
        probes, listed = now.filter("probe"), now.filter("not probe")
        last = turn == ROUNDS
        drawn = lambda df: df.join(differences.drop("weight") if last else differences.select("p", "item", "lost", *BITS), ["p", "item"])  # noqa: B023, E731
        pairs = pairs.unionByName(_enough(drawn(probes.filter(few)), drawn(listed.filter(few)), percent, last))
        hot = now.filter(~few).select("key", "item", "p", "component", "weight", "probe")
        if turn == ROUNDS or hot.isEmpty():
            break
        lightest = store(hot.filter("not probe").groupBy("key").agg(F.min(F.struct("weight", "item", "component", "p")).alias("y")).select("key", "y.*"))
        star = _enough(drawn(hot.filter("probe")), drawn(lightest), percent)
        left = hot.join(lightest.select("key", F.struct("weight", "item").alias("y")), "key").filter(F.col("probe") | (F.struct("weight", "item") > F.col("y")))
        posted = store(left.select("key", "item", "p", "weight", "probe"))
        tested_too(pairs.unionByName(star))
        pairs = pairs.limit(0)
    tested_too(pairs)
    drop(now), drop(differences)
    for parts in mixed:
        drop(parts[0]), drop(parts[1])
    return found
