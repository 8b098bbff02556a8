"""The queries with the reference's caps: against SQL where they have it, else by brute force."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest
from test_queries import plain

from duotrace.config import FULL
from duotrace.operators.pairing import pairings
from duotrace.plans import registry, search

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")


def test_400_offsets_a_pair(spark):
    sizes = {0: 4000, 2: 3500, 4: 100}
    got = defaultdict(set)
    for r in pairings(spark.createDataFrame([(s, 0, n) for s, n in sizes.items()], "seg long, fold int, n long"), FULL).collect():
        got[r["ai"], r["bi"]].add(r["off"])
    for a, na in sizes.items():
        for b, nb in sizes.items():
            reach = min(na, nb) - 16
            offs = [*range(64, na - 15, 16), *range(-64, -(na - 15), -16)] if a == b else [*range(-reach, reach + 1, 16)]
            offs.sort(key=lambda o: (((o + 1000000) * 7919 + a * 104729 + b * 1299709) % 1000003, o))
            assert got[a, b] == set(offs[:400])
    assert max(map(len, got.values())) == 400


@needs_data
@pytest.mark.parametrize("name", sorted(registry.FULL_ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    df = registry.FULL_QUERIES[name](spark, SF)
    got = con.execute(registry.FULL_ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(df.collect(), df.columns) == plain(got.fetchall(), names)


@needs_data
def test_rates_by_brute_force(spark):
    clean = search._clean(spark, SF, FULL)[1]
    trig = search._trig(spark, SF).select("seg", "idx", "fold", "loglr", "net", "hm", "lm").collect()
    loud, nets, rows = defaultdict(dict), defaultdict(list), defaultdict(list)
    for r in search.far.bounded_prune(clean, FULL).select("fold", "ai", "bi", "gps_l", "loglr", "hm", "lm").collect():
        key = r["bi"], r["gps_l"] // 4
        loud[r["fold"]][key] = max(loud[r["fold"]].get(key, -99.0), r["loglr"])
        rows[r["fold"]].append((r["loglr"], r["ai"], r["bi"], key, r["hm"], r["lm"]))
    loud = {f: sorted(x.values()) for f, x in loud.items()}
    for r in search.cluster.family_max(clean, FULL).select("fold", "net").collect():
        nets[r["fold"]].append(r["net"])
    nets = {f: sorted(x) for f, x in nets.items()}
    n_loud = {(r["seg"], r["idx"]): len(loud[r["fold"]]) - bisect_right(loud[r["fold"]], r["loglr"]) for r in trig}
    n_net = {(r["seg"], r["idx"]): len(nets[r["fold"]]) - bisect_left(nets[r["fold"]], r["net"]) for r in trig}
    assert {(r["seg"], r["idx"]): r["n_louder"] for r in registry.FULL_QUERIES["louder_families_full"](spark, SF).collect()} == n_loud
    assert {(r["seg"], r["idx"]): r["n_net"] for r in registry.FULL_QUERIES["net_channel_far_full"](spark, SF).collect()} == n_net
    arms = {}
    for t in trig:
        if t["net"] > 4:
            met = [r for r in rows[t["fold"]] if r[0] > t["loglr"] and t["seg"] not in r[1:3]]
            arms[t["seg"], t["idx"]] = len({r[3] for r in met if r[4] >= t["hm"]}), len({r[3] for r in met if r[5] >= t["lm"]})
    assert {(r["seg"], r["idx"]): (r["n_hm"], r["n_lm"]) for r in registry.FULL_QUERIES["per_arm_far_full"](spark, SF).collect()} == arms
