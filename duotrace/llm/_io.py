"""Tables written between the phases of an operator, and skew-safe small joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch. Texts are long, so a batch is kept to a few MB; this bounds a Python worker's memory.
BATCH_ROWS = 1000
#: Bytes in an Arrow batch, and in a part of an exchange; the least number of parts.
BATCH_BYTES, PART_BYTES, LEAST_PARTS = 16 << 20, 32 << 20, 8
#: Spark removes a query's shuffle files at its end, so that the phases of an operator don't add up on disk.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that every operator here relies on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share. Where that is unset, a local master
    (tests on one machine) gets a temporary folder as its checkpoint folder, and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def store(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")  # nothing executes this plan again
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what store() wrote, once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def parts_for(spark: SparkSession, size: int) -> int:
    """Parts for keyed packs of `size` bytes in all: PART_BYTES each, so that what a task holds doesn't grow with the input."""
    return max(LEAST_PARTS, -(-int(size) // PART_BYTES))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, in one scan of the column."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The doc_id, or for a row without one a 64-bit hash of its text, so that such rows are judged each by its own text."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.lit("no id"), text_or_empty(text)))


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
