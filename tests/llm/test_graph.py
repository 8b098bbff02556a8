from __future__ import annotations

import random

import pytest

from duotrace.llm import _graph


def plain(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in up}


CHAIN = [(k, k + 1) for k in range(60)]
STAR = [(1000, 2000 + k) for k in range(200)]
rng = random.Random(5)
MIXED = [(rng.randrange(300) - 150, rng.randrange(300) - 150) for _ in range(130)]


@pytest.mark.parametrize("links", [[], [(4, 4)], [(3, 1), (1, 3), (3, 1)], CHAIN + STAR + MIXED], ids=["none", "loop", "repeated", "chain, star and others"])
@pytest.mark.parametrize("rows", [_graph.MERGE_ROWS, 7])
def test_components_are_those_of_a_plain_union_find(spark, monkeypatch, links, rows):
    monkeypatch.setattr(_graph, "MERGE_ROWS", rows)
    links = links[:]
    random.Random(rows).shuffle(links)
    got = _graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len(set(got))
    assert {(r["node"], r["component"]) for r in got} == plain(links)


def test_few_pairs_meet_in_a_group_of_near_copies(spark, monkeypatch):
    """Members that differ in own words and in shared variants, all below the threshold: what meets under rare differences is a small part of all pairs."""
    import random

    from pyspark.sql import functions as F

    from duotrace.llm import _bands
    from duotrace.llm.neardup import near_duplicates

    seen = []
    real = _bands._open

    def counted(rows):
        out = real(rows)
        per = out.groupBy("key").agg(F.count_if("probe").alias("m"), F.count_if(~F.col("probe")).alias("n"))
        seen.append(per.agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0))).first()[0])
        return out

    monkeypatch.setattr(_bands, "_open", counted)
    n, r = 300, random.Random(300)
    variants = [(r.randrange(0, 297), [f"v{k}_{j}" for j in range(3)]) for k in range(5)]
    docs = []
    for i in range(n):
        words = [f"w{k}" for k in range(300)]
        at, own = variants[i % 5]
        words[at : at + 3] = own
        for j in range(6):
            words[r.randrange(300)] = f"o{i}_{j}"
        docs.append((i, " ".join(words)))
    near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), words=3, percent=85).count()
    assert seen and seen[-1] < n * n // 8  # 137,372 in order of hash, before rarity decided


@pytest.mark.parametrize("block", [1_000_000, 9])
def test_members_of_large_bands_make_no_row_a_band(spark, monkeypatch, block):
    """Items find a band's pivot by looking it up: two members of a large mixed band share a pivot, and an item has a row a pivot, not a band."""
    import numpy as np

    from duotrace.llm import _bands
    from duotrace.llm._io import store

    monkeypatch.setattr(_bands, "BROADCAST_ROWS", block)
    r = random.Random(1)
    held = {i: {100 + k for k in range(30) if r.random() < 0.8} | {1000 + i // 5} for i in range(60)}
    component = {i: i // 2 for i in held}

    def bands(batch):
        pairs = [(i, k) for i, keys in zip(batch.column("id").to_pylist(), batch.column("keys").to_pylist()) for k in keys]
        x, y = np.array(pairs, np.int64).reshape(-1, 2).T
        return x, np.ascontiguousarray(y).view(np.uint64)

    items = store(spark.createDataFrame([(i, component[i], sorted(k)) for i, k in held.items()], "id long, component long, keys array<long>").repartition(3))
    got = _bands._mixed(items, bands)
    small = {(row["item"], k) for entries, _ in got for row in entries.collect() for k in row["small"]}
    assert small == {(i, 1000 + i // 5) for i in held}
    met = [(row["p"], row["item"]) for _, rows in got for row in rows.collect()]
    pivots = {i: {p for p, j in met if j == i} for i in held}
    assert all(pivots[i] & pivots[j] for i in held for j in held if held[i] & held[j] & set(range(100, 130)))
    assert len(set(met)) < sum(map(len, held.values())) // 3
    assert len(got) == (1 if block > 9 else 5)


def test_few_signatures_reach_the_join_with_candidates(spark, monkeypatch):
    from duotrace.llm import neardup

    seen, real = [], neardup._wanted

    def counted(rows, some, keys):
        out = real(rows, some, keys)
        seen.append((out.select("id").count(), rows.select("id").count()))
        return out

    monkeypatch.setattr(neardup, "_wanted", counted)
    r = random.Random(2)
    docs = [(d, " ".join(f"w{r.randrange(10**6)}" for _ in range(60))) for d in range(200)]
    docs += [(500, docs[7][1] + " more"), (None, docs[7][1])]
    got = {x["doc_id"]: x["component_id"] for x in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=3, percent=85).collect()}
    assert got[500] == got[7] == 7 and got[8] == 8
    assert seen[0] == (2, 201) and seen[1] == (2, 201)


def test_a_centre_has_what_most_of_its_group_has(spark, monkeypatch):
    """Differences from a centre are no more than those from the pivot."""
    from pyspark.sql import functions as F

    from duotrace.llm import _bands
    from duotrace.llm.neardup import near_duplicates

    seen, real = {}, _bands.store

    def kept(df):
        out = real(df)
        for x, y in (("added", "lacking"), ("beyond", "short")):
            if x in out.columns and y in out.columns:
                seen[x] = out.agg(F.sum(F.size(x) + F.size(y))).first()[0]
        return out

    monkeypatch.setattr(_bands, "store", kept)
    r = random.Random(4)
    docs = []
    for i in range(60):
        words = [f"w{k}" for k in range(150)]
        for j in range(4):
            words[r.randrange(150)] = f"o{i}_{j}"
        docs.append((i, " ".join(words)))
    near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=3, percent=85).count()
    assert 0 < seen["beyond"] < seen["added"]
