"""Benchmark decontamination by winnowing (operator 7): DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._io import prepare, row_key, store, text_or_empty

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A window of WINDOW words; its fingerprint is the least hash of the GRAM-word grams in it, so winnowing keeps one
#: fingerprint for every WINDOW words, and any shared window shows as a shared fingerprint.
WINDOW, GRAM = 13, 6
#: The benchmark's fingerprints are broadcast up to this many (16 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Words of a text whose letters A to Z are lower-cased, other letters left as they are."""
    plain = F.octet_length(text) == F.char_length(text)
    lower = F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0))


def _ahead(a: Column, by: int) -> Column:
    return F.slice(a, F.lit(1 + by), F.size(a))


def _pair(a: str, b: str, by: int) -> Column:
    return F.zip_with(F.col(a), _ahead(F.col(b), by), lambda x, y: F.xxhash64(x, y))


def _gram(df: DataFrame, n: int) -> DataFrame:
    """Adds g{n}: the hash of the n words from each word on (past the end it is of fewer words; callers cut it off)."""
    if f"g{n}" in df.columns:
        return df
    half = 1 << ((n - 1).bit_length() - 1)
    df = _gram(_gram(df, half), n - half)
    return df.withColumn(f"g{n}", _pair(f"g{half}", f"g{n - half}", half))


def _least(df: DataFrame, name: str, of: str, by: int) -> DataFrame:
    return df.withColumn(name, F.zip_with(F.col(of), _ahead(F.col(of), by), lambda x, y: F.least(x, y)))


def _hashed(df: DataFrame) -> DataFrame:
    """df with `words` gains n_words and g1, the words' hashes, in place of the words."""
    return df.withColumn("n_words", F.size("words").cast("long")).withColumn("g1", F.transform("words", lambda w: F.xxhash64(w))).drop("words")


def _windows(df: DataFrame) -> DataFrame:
    """A row for each window of 13 words: pos, fp (its winnowed fingerprint), key (its hash); texts without one keep a row with null pos."""
    df = _gram(_gram(_hashed(df), GRAM), WINDOW)
    df = _least(_least(_least(df, "m2", f"g{GRAM}", 1), "m4", "m2", 2), "m8", "m4", 4)  # 8 grams of 6 words span 13 words
    n = F.greatest(F.col("n_words").cast("int") - (WINDOW - 1), F.lit(0))
    both = F.arrays_zip(F.slice("m8", F.lit(1), n).alias("fp"), F.slice(f"g{WINDOW}", F.lit(1), n).alias("key"))
    keep = [c for c in df.columns if c[0] not in "gm"]
    return df.select(*keep, F.posexplode_outer(both).alias("pos", "w")).select(*keep, "pos", "w.fp", "w.key")


def _short_windows(df: DataFrame, n: int) -> DataFrame:
    df = _gram(_hashed(df), n)
    count = F.greatest(F.col("n_words").cast("int") - (n - 1), F.lit(0))
    keep = [c for c in df.columns if c[0] != "g"]
    return df.select(*keep, F.posexplode(F.slice(f"g{n}", F.lit(1), count)).alias("pos", "key"))


def overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row a doc_id: n_words, n_hit, n_items, items_sha256, contaminated.

    Winnowed fingerprints of documents meet those of the benchmark in one join; each hit is extended to the windows of
    13 words that selected the fingerprint, and those whose 64-bit hash is also a benchmark window's count (a chance
    agreement of both hashes is below one in 10**19 for a pair). Items of 1 to 12 words are a single window of their
    own length. Equal items are looked up once and all listed.

    Null or empty text has no words and is clean; so is every document when the benchmark is empty. Rows that repeat a
    doc_id count as one document with the hits of all (n_words is the longest's). A null item_id is not listed. Other
    columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), words(text_or_empty(text)).alias("words"))
    items = benchmark.select(F.col(item_id).alias("item_id"), words(text_or_empty(text)).alias("words")).filter(F.size("words") > 0)
    items = items.withColumn("same", F.sha2(F.array_join("words", " "), 256))
    members = store(items.select("same", F.col("item_id").cast("string").alias("item_id")).filter("item_id is not null").distinct())
    classes = items.groupBy("same").agg(F.first("words").alias("words"))
    lengths = [r[0] for r in classes.filter(F.size("words") < WINDOW).select(F.size("words")).distinct().collect()]  # at most 12
    known = _windows(classes).filter("pos is not null").select("same", F.lit(WINDOW).alias("len"), "fp", "key")
    for n in lengths:
        known = known.unionByName(_short_windows(classes.filter(F.size("words") == n), n).select("same", F.lit(n).alias("len"), F.lit(None).cast("long").alias("fp"), "key"))
    known = store(known)

    prints = known.filter("fp is not null").select("fp").distinct()
    prints = store(prints.withColumn("hit", F.lit(True)))
    if prints.count() <= BROADCAST_ROWS:
        prints = F.broadcast(prints)
    # Each document's first row is kept as the bearer of its n_words.
    found = _windows(docs).join(prints, "fp", "left").filter("hit or pos is null or pos = 0")
    found = store(found.select("doc_id", "n_words", "pos", "key", F.lit(WINDOW).alias("len"), F.coalesce("hit", F.lit(False)).alias("hit")))
    hits = found.filter("hit").select("doc_id", "pos", "len", "key")
    for n in lengths:
        hits = hits.unionByName(_short_windows(docs, n).select("doc_id", "pos", F.lit(n).alias("len"), "key"))
    keys = known.select("len", "key").distinct()
    hits = store(hits.join(keys, ["len", "key"], "left_semi").distinct())

    by_doc = Window.partitionBy("doc_id").orderBy("pos", "len").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("pos") + F.col("len")
    fresh = F.greatest(F.lit(0), end - F.greatest(F.col("pos"), F.coalesce(F.max(end).over(by_doc), F.lit(0))))
    covered = hits.withColumn("fresh", fresh).groupBy("doc_id").agg(F.sum("fresh").alias("n_hit"))
    listed = (
        hits.select("doc_id", "len", "key").distinct().join(known.select("len", "key", "same").distinct(), ["len", "key"])
        .select("doc_id", "same").distinct().join(members, "same").select("doc_id", "item_id").distinct()
        .groupBy("doc_id").agg(F.count("*").alias("n_items"), F.sha2(F.array_join(F.array_sort(F.collect_list("item_id")), ","), 256).alias("items_sha256"))
    )
    rows = (
        found.select("doc_id", "n_words")
        .unionByName(covered, allowMissingColumns=True)
        .unionByName(listed, allowMissingColumns=True)
        .groupBy("doc_id")
        .agg(*(F.max(c).alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256")))
    )
    rows = rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
    )
    return rows.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The rows of docs that are not contaminated, with their own columns. A row without an id is judged by its own text alone."""
    key = row_key(names.get("doc_id", "doc_id"), names.get("text", "text"))
    keyed = docs.select(key.alias("doc_id"), F.col(names.get("text", "text")).alias("text"))
    bad = store(overlaps(keyed, benchmark, item_id=names.get("item_id", "item_id")).filter("contaminated").select(F.col("doc_id").alias("_bad")))
    return docs.join(bad, key == bad["_bad"], "left_anti")


def op7(spark, sf_dir: str) -> DataFrame:
    return overlaps(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
