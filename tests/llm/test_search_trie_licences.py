"""Operators 11, 12 and 13 against SQL, brute force and odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from duotrace.llm import ranked, registry
from duotrace.llm.conversations import graft, ordered, prefix_trie, whole
from duotrace.llm.license_rules import RULES, Rule
from duotrace.llm.licenses import op13, scan, suppress
from duotrace.llm.ranked import Block, candidates, search

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return [t.translate(LOW) for t in TERM.findall(text or "")]


def rows(df, *names):
    return [tuple(r[n] for n in names or df.columns) for r in df.collect()]


def sql(name, directory=SF):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{directory}/{table}.parquet'")
    out = con.execute(registry.ORACLES[name]).to_arrow_table()
    return out.column_names, list(zip(*(c.to_pylist() for c in out.columns)))


# ---- 11: ranked search


def plain_search(docs, items, k=50):
    """docs: rows of (doc_id, text). Null ids last among equals; every row is a document."""
    counts = [(i, Counter(plain_terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n, total = len(counts), sum(x[2] for x in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(plain_terms(t))
    out = []
    for item, ts in wanted.items():
        scored = []
        for i, c, size in counts:
            m = 100 - 50 + (50 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return out


def made_corpus(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "ÉCOLE", "x1", "Common"]
    docs = [(i, " ".join(r.choices(vocabulary, weights=[1 / (1 + j) for j in range(len(vocabulary))], k=r.randint(1, 60)))) for i in range(n)]
    items = [(i, ", ".join(r.sample(vocabulary, r.randint(1, 12)))) for i in range(15)]
    return docs, items


@pytest.mark.parametrize("k", [1, 7, 50])
def test_search_equals_brute_force(spark, k):
    docs, items = made_corpus(k, 400)
    docs += [(400 + i, docs[3][1]) for i in range(90)]  # ties beyond k
    got = search(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(items, "item_id long, text string"), k)
    assert sorted(rows(got)) == sorted(plain_search(docs, items, k))


def test_search_of_odd_rows(spark):
    long = "w1 " * 400_000 + "rare"
    docs = [(1, None), (2, ""), (3, "..."), (None, "alpha beta"), (None, "alpha beta"), (5, "ALPHA beta"), (5, "alpha beta"), (6, long), (7, "w1 É"), (8, "gamma"), (9, "delta")]
    items = [("a", "Alpha"), ("a", "alpha rare!"), (None, "É w1"), ("none", "nowhere"), ("empty", ""), ("null", None)]
    frame = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(docs)], "doc_id long, text string, score int")  # a clashing name
    got = rows(search(frame, spark.createDataFrame(items, "item_id string, text string")))
    assert sorted(got, key=repr) == sorted(plain_search(docs, items), key=repr)
    assert [x[2] for x in sorted((g for g in got if g[0] == "a"), key=lambda g: g[1])] == [5, 5, None, None, 6] or 6 in {g[2] for g in got}
    none = frame.limit(0)
    items = spark.createDataFrame(items, "item_id string, text string")
    assert search(none, items).count() == 0 and search(frame, items.limit(0)).count() == 0
    assert search(none, items).columns == search(frame, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]


def test_search_in_blocks_of_items(spark, monkeypatch):
    docs, items = made_corpus(3, 120)
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 4)
    monkeypatch.setattr(ranked, "BLOCK_PAIRS", 30)
    monkeypatch.setattr(ranked, "STEP", 500)
    got = search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(rows(got)) == sorted(plain_search(docs, items))


def test_pruned_terms_make_no_candidates_and_lose_none():
    # one item of three terms with bounds 100, 10 and 5; the threshold of 20 lets the last two seed nothing
    block = Block(np.zeros(3, np.int64), np.arange(3), np.array([1, 1, 1]), np.array([100, 10, 5]), np.array([20, 0, 0]), 1)
    assert block.suffix.tolist() == [115, 15, 5] and block.least.tolist() == [20]
    row, item = candidates(block, block.least, np.array([0, 1, 2]), np.array([0, 1, 2]), 3)
    assert row.tolist() == [0] and item.tolist() == [0]


@needs_data
@pytest.mark.parametrize("name", ["op11_seeded_search", "op12_leaf_peeling"])
def test_queries_equal_their_sql(spark, name):
    got = registry.QUERIES[name](spark, SF)
    columns, want = sql(name)
    assert sorted(rows(got, *columns), key=repr) == sorted(want, key=repr) and want


# ---- 12: trie of conversations


def plain_trie(conversations):
    """conversations: id -> list of (role, text)."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(conversations):
        ts = tuple(conversations[c])
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
        ends[ts].append(c)
    children = defaultdict(list)
    for key in members:
        if key:
            children[key[:-1]].append(key)
    totals = {}
    for key in sorted(members, key=len, reverse=True):
        own = (len(members[key]) - 1) * (len(key[-1][1]) if key else 0)
        leaves = 0 if children[key] else 1
        totals[key] = (leaves + sum(totals[x][0] for x in children[key]), own + sum(totals[x][1] for x in children[key]))
    return sorted(
        (members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(children[k]), *totals[k], hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k in members
    )


def plain_order(turns):
    """Ids to turns in order: null first, ties by digest; null role and text are empty."""
    held = defaultdict(list)
    for c, t, r, x in turns:
        if c is not None:
            r, x = r or "", x or ""
            held[c].append(((t is not None, t or 0), hashlib.md5(f"{len(r.encode())}:{r}{x}".encode()).digest(), (r, x)))
    return {c: [x[2] for x in sorted(v)] for c, v in held.items()}


def plain_graft(held):
    out = {}
    for c, ts in held.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = held.get(c - c % 100, [])[:h] + ts[h:]
    return out


TURNS = "conv_id long, turn long, role string, text string"
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def made_turns(seed, n):
    r = random.Random(seed)
    out = []
    for c in r.sample(range(4 * n), n):
        for t in range(r.choice((1, 2, 3, 7))):
            out.append((c, r.choice((t, t, None)), r.choice(("user", "assistant", None)), r.choice(("a", "bé", "", None, "longer text"))))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    turns = made_turns(seed, 150)
    df = ordered(spark.createDataFrame(turns, TURNS).repartition(5))
    assert sorted(rows(prefix_trie(graft(df)), *NODE), key=repr) == sorted(plain_trie(plain_graft(plain_order(turns))), key=repr)
    assert sorted(rows(prefix_trie(whole(df)), *NODE), key=repr) == sorted(plain_trie(plain_order(turns)), key=repr)


def test_trie_of_long_conversations_and_copies(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    long = [(7, t, "user", f"t{t}") for t in range(3500)]  # over several batches
    copies = [(c, t, "user", f"t{t}") for c in (3, 12, 2000, 2001) for t in range(40)]
    fork = [(5, t, "user", f"t{t}" if t < 1200 else "x") for t in range(1300)]
    turns = long + copies + fork
    got = sorted(rows(prefix_trie(whole(ordered(spark.createDataFrame(turns, TURNS).repartition(3)))), *NODE), key=repr)
    # brute force over tuples is quadratic in depth: totals by a plain pass over the chains instead
    held = {c: [hashlib.md5(x[1].encode()).hexdigest() for x in v] for c, v in plain_order(turns).items()}
    by = defaultdict(set)
    for c, v in held.items():
        state = hashlib.md5()
        by[(0, state.hexdigest())].add(c)
        for d, x in enumerate(v, 1):
            state.update(x.encode())
            by[(d, state.hexdigest())].add(c)
    assert sorted((min(m), d, len(m)) for (d, _), m in by.items()) == sorted((g[0], g[1], g[3]) for g in got)
    root = next(g for g in got if g[1] == 0)
    assert root[0] == 3 and root[2] is None and root[5] == 2 and root[3] == 6
    assert next(g for g in got if g[:2] == (3, 40))[7] == hashlib.sha256(b"3,12,2000,2001").hexdigest()
    assert max(g[1] for g in got if g[0] == 7) == 3500 and next(g for g in got if g[0] == 5 and g[1] == 1200)[4] == 2


def test_trie_of_odd_rows(spark):
    turns = [(None, 1, "user", "x"), (7, 1, None, None), (8, None, "user", "a"), (8, None, "user", "a"), (8, 2, "user", "b" * 300_000), (100, 0, "u", "p"), (101, 0, "u", "q"), (-5, 0, "u", "z"), (12, 0, "u", "only")]
    df = spark.createDataFrame([(*t, "extra") for t in turns], TURNS + ", n_convs string")
    assert sorted(rows(prefix_trie(graft(ordered(df))), *NODE), key=repr) == sorted(plain_trie({c: v for c, v in _negative_base(plain_order(turns)).items()}), key=repr)
    assert prefix_trie(graft(ordered(df.limit(0)))).count() == 0
    assert prefix_trie(whole(ordered(df.limit(0)))).count() == 0


def _negative_base(held):
    """As plain_graft, but c % 100 has the sign of c, as in SQL."""
    out = {}
    for c, ts in held.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = held.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:]
    return out


# ---- 13: licences


PLAIN = [re.compile(rf"(?<![^ ])(?:{r.pattern})(?![^ ])") for r in RULES]


def plain_scan(text, rules=RULES):
    """Every rule on the whole text, then every pair of detections."""
    words = [w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))]
    joined, found = " ".join(words), []
    for k in range(len(rules)):
        for m in PLAIN[k].finditer(joined):
            a = joined[: m.start()].count(" ")
            found.append((k, a, a + m[0].count(" ") + 1))

    def beats(x, y):
        (i, a, b), (j, c, d) = x, y
        return a <= c and d <= b and (rules[i].priority, a - b, i) < (rules[j].priority, c - d, j)

    kept = [y for y in found if rules[y[0]].base or not any(beats(x, y) for x in found)]
    return len(words), sorted((rules[k].label, rules[k].kind, a, b) for k, a, b in kept)


def scanned(df):
    return {r["doc_id"]: (r["n_words"], sorted((d["label"], d["kind"], d["first_word"], d["end_word"]) for d in r["found"])) for r in scan(df).collect()}


NOTICES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "CC-BY-NC-SA 4.0 International", "SPDX-License-Identifier: GPL-2.0-or-later",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "All rights reserved.", "dual-licensed under MIT and the Apache License, version 2",
    "license: BSD-3-Clause", "under the mit license under the mit license", "See the LICENSE file for details", "mit", "Available under the terms of the Mozilla Public License v2.0", "neither the name of the University of Somewhere nor the names of its contributors may be used to endorse or promote products",
    "this program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
]


def test_scan_equals_all_rules_on_whole_texts(spark):
    r = random.Random(5)
    filler = ["ein", "mit", "wort", "license", "the", "under", "version", "2", "0", "public", "general", "gnu", "cc", "by", "nc", "apache"]
    docs = []
    for i in range(250):
        parts = []
        for _ in range(r.randint(0, 6)):
            parts.append(r.choice(NOTICES) if r.random() < 0.5 else " ".join(r.choices(filler, k=r.randint(1, 90))))
        docs.append((i, r.choice((" ", "\n", "")).join(parts)))
    got = scanned(spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    for i, text in docs:
        assert got[i] == plain_scan(text), text


@needs_data
def test_op13_on_the_tables(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op13(spark, SF).collect()}
    assert got.keys() == texts.keys()
    phrases = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
    for i, text in texts.items():
        n, found = plain_scan(text)
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        base = sorted((p, label) for label, phrase in phrases.items() for p in range(len(words)) if words[p : p + len(phrase.split())] == phrase.split())
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(base), ",".join(sorted({x[1] for x in base})))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["labels"] == ",".join(sorted({x[0] for x in found})) and 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(found)
    assert any(r["labels"] for r in got.values())


def test_scan_of_odd_rows(spark):
    long = "word " * 300_000 + "released under the MIT license " + "mit " * 200_000 + "license mit"
    docs = [(1, None), (2, ""), (3, "!!"), (None, NOTICES[0]), (5, NOTICES[1]), (5, NOTICES[1]), (6, long)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, found int")
    got = sorted(((r["doc_id"], r["n_words"], [(d["label"], d["first_word"]) for d in r["found"]]) for r in scan(df).collect()), key=repr)
    assert [g for g in got if g[0] in (1, 2, 3)] == [(1, 0, []), (2, 0, []), (3, 0, [])]
    assert got.count(next(g for g in got if g[0] == 5)) == 2 and ("mit", 1) in next(g for g in got if g[0] is None)[2]
    assert ("mit", 300_001) in next(g for g in got if g[0] == 6)[2] and next(g for g in got if g[0] == 6)[1] == 500_007
    assert scan(df.limit(0)).count() == 0


def test_suppression_by_priority_and_interval():
    rules = [Rule("base", "phrase", "a b", "a", True), Rule("text", "text", "x", "x"), Rule("title", "title", "y", "y"), Rule("title2", "title", "z", "z")]
    found = [(0, 3, 5), (1, 2, 6), (2, 2, 6), (2, 5, 8), (3, 5, 8), (3, 6, 7), (2, 7, 9)]
    assert suppress(rules, found) == [(1, 2, 6), (0, 3, 5), (2, 5, 8), (2, 7, 9)]


def _sample(tree, r):
    """A string that the parsed expression matches: alternatives and counts drawn at random."""
    import re._constants as c

    def make(tree):
        out = ""
        for op, arg in tree:
            if op is c.LITERAL:
                out += chr(arg)
            elif op is c.SUBPATTERN:
                out += make(arg[3])
            elif op is c.BRANCH:
                out += make(r.choice(arg[1]))
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                out += "".join(make(arg[2]) for _ in range(r.randint(arg[0], min(arg[1], arg[0] + 12))))
            elif op is c.IN:
                out += "w" if arg[0][0] is c.NEGATE else chr(arg[r.randrange(len(arg))][1] if arg[0][0] is c.LITERAL else r.randint(*arg[0][1]))
            elif op is c.NOT_LITERAL:
                out += "w"
            else:
                raise AssertionError(op)
        return out

    return make(tree)


def test_every_match_of_a_rule_has_its_words_and_a_bounded_length():
    from duotrace.llm.license_rules import SPAN

    r = random.Random(1)
    assert len(RULES) > 400
    for rule in RULES:
        tree = re._parser.parse(rule.pattern)
        for _ in range(15):
            text = _sample(tree, r)
            assert rule.expression.fullmatch(text), (rule.pattern, text)
            words = text.split(" ")
            assert len(words) <= SPAN and all(x & set(words) for x in rule.words), (rule, text)
