"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from test_operators import SF, WORD, needs_data, roots, shingles, similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_removed int, gone string"


def frame(spark, texts):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 77, "x") for d, t in texts], SCHEMA)


def some_texts():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(60) for _ in range(12)]
    rows = [(d, "\n".join((t, text(20)))) for d, t in enumerate(base)]
    for d, t in rows[:6]:  # near copies, of one word in eighty
        w = t.split()
        w[d * 7 % 80] = "changed"
        rows.append((100 + d, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \n\t"), (None, base[0]), (203, text(9000)), (204, base[3]), (204, base[3]), (205, "one")]
    return rows


def plain_lines(rows):
    """Texts without lines whose group began earlier (null ids first)."""
    places = [((d is not None, d or 0, k), x) for d, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\x0b\x0c\r")]
    lines = list(dict.fromkeys(x for _, x in places))
    sets = {k: {x[i : i + 8] for i in range(max(1, len(x) - 7))} for k, x in enumerate(lines)}
    group, number = roots(sets, similar(sets, 80)), {x: k for k, x in enumerate(lines)}
    first = {}
    for place, x in sorted(places):
        first.setdefault(group[number[x]], place)
    gone = {p for p, x in places if first[group[number[x]]] != p}
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        keep = [x for k, x in enumerate(parts) if ((d is not None), d or 0, k) not in gone]
        if t is None or len(keep) == len(parts):
            out.append((d, t))
        elif "".join(keep).strip(" \t\n\x0b\x0c\r"):
            out.append((d, "\n".join(keep)))
    return out


def kept(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_line_dedup(spark):
    rows = some_texts()
    docs = frame(spark, rows)
    out = pipeline.line_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(plain_lines(rows))
    assert all(r["n_removed"] == 77 and r["gone"] == "x" and r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    assert pipeline.line_dedup(spark, docs.limit(0), "").count() == 0


def test_near_dedup(spark):
    rows = some_texts()
    docs = frame(spark, rows)
    sets = {d: shingles(t, 5) for d, t in rows if d is not None}
    root = roots(sets, similar(sets, 80))
    out = pipeline.near_dedup(spark, docs, "")
    assert out.columns == docs.columns
    assert kept(out) == Counter((d, t) for d, t in rows if d is None or root[d] == d)
    assert sum(root[d] != d for d in root) >= 6
    assert pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_decontamination(spark, tmp_path):
    rng = random.Random(2)
    words = [f"w{chr(97 + k % 26)}{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(words) for _ in range(30))) for k in range(5)] + [(8, None), (9, "only three words")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(d, " ".join(rng.choice(words) for _ in range(80))) for d in range(10)]
    dirty = [(100 + k, clean[k][1] + " " + items[k][1].upper()) for k in range(5)] + [(120, "Only, three; words!")]
    little = [(130, " ".join(rng.choice(words) for _ in range(600)) + " " + items[0][1])]  # under a twentieth
    long = (150, " ".join(rng.choice(words) for _ in range(300_000)) + " " + items[1][1])
    odd = [(140, None), (141, ""), (None, clean[0][1]), (None, None), long]
    rows = clean + dirty + little + odd + [(None, items[2][1]), (None, "only three words")]  # rows without an id, each by its own text
    docs = frame(spark, rows)
    out = pipeline.decontamination(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and kept(out) == Counter(clean + little + odd)
    assert pipeline.decontamination(spark, docs.limit(0), str(tmp_path)).count() == 0


@needs_data
def test_toxicity_rejects_by_score(spark):
    from duotrace.llm.toxicity import held_out, score_toxicity, train

    directory = "/root/testdata/sf0.01"  # the smallest table has too few labels for a score of 0.7
    docs = spark.read.parquet(f"{directory}/documents.parquet")
    out = pipeline.toxicity(spark, docs, directory)
    scores = score_toxicity(docs, train(docs, spark.read.parquet(f"{directory}/labels.parquet"), ~held_out()))
    low = {r["doc_id"] for r in scores.filter(F.col("score") < 0.7).select("doc_id").collect()}
    assert out.columns == docs.columns and {r["doc_id"] for r in out.select("doc_id").collect()} == low
    ends = [scores.orderBy(order).first() for order in (F.desc("score"), F.asc("score"))]
    odd = docs.filter(F.col("doc_id").isin([r["doc_id"] for r in ends]))
    text = {r["doc_id"]: r["text"] for r in odd.collect()}
    odd = odd.withColumn("doc_id", F.lit(None).cast("long"))
    more = docs.unionByName(odd).unionByName(odd.limit(1).withColumn("text", F.lit(None).cast("string")))
    kept_texts = [r["text"] for r in pipeline.toxicity(spark, more, directory).filter("doc_id is null").collect()]
    assert ends[0]["score"] >= 0.7 > ends[1]["score"] and sorted(kept_texts, key=str) == sorted([text[ends[1]["doc_id"]], None], key=str)


@needs_data
def test_packing_keeps_every_token(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    total, pieces = defaultdict(int), {}
    for r in pipeline.packing(spark, docs, SF).collect():
        total[r["doc_id"]] += r["length"]
        pieces[r["doc_id"]] = r["doc_tokens"]
    assert total == pieces and len(total) == docs.count()


@needs_data
def test_run_is_all_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = docs.sparkSession.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
    want = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in pipeline.run(spark, SF).select("doc_id").collect()} == want
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
