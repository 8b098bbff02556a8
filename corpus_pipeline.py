"""From raw documents to packed token sequences: five stages, each written as Parquet and read by the next.

Every stage takes null, empty and very long texts, repeated rows, null ids, empty tables and further columns, and keeps the
columns it was given: null and empty texts are never near copies, contaminated or without a line, and are kept as they are;
a row without a doc_id is judged by its own text in every stage (and always kept by near_dedup); repeated rows of one doc_id
stay or go together; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duotrace.llm._io import prepare, row_key, store
from duotrace.llm.decontamination import decontaminate
from duotrace.llm.lines import dedup_lines
from duotrace.llm.neardup import near_duplicates
from duotrace.llm.packing import pack
from duotrace.llm.toxicity import held_out, score_toxicity, train

TOXIC = 0.7


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score of 0.7 or more) go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = score_toxicity(docs.select(row_key().alias("doc_id"), "text"), train(docs, labels, ~held_out()))
    bad = store(scores.filter(F.col("score") >= TOXIC).select(F.col("doc_id").alias("_bad")).distinct())
    return docs.join(bad, row_key() == bad["_bad"], "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and near lines the first stays. n_chars follows the text; documents left without a line that isn't blank go, those that had none stay."""
    total, removed = (name + "_" * max(len(c) for c in docs.columns) for name in ("lines", "removed"))  # names that no column has
    out = dedup_lines(docs, n_lines=total, n_removed=removed)
    lost = (F.col(removed) > 0) & ~F.col("text").rlike(r"[^\x09-\x0D\x20]")
    out = out.filter(~F.coalesce(lost, F.lit(False))).withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the least doc_id (shingles of five words, similarity 0.8)."""
    groups = near_duplicates(docs, words=5, percent=80)
    gone = store(groups.filter("not kept and doc_id is not null").select(F.col("doc_id").alias("_gone")))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark text go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens, sources mixed evenly."""
    return pack(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: A classifier, tokenizers and iterated components are beyond SQL; tests/llm/test_pipeline.py compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; the last stage's rows."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
