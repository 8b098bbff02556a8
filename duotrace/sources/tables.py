"""Tables written once and read by several branches of a plan, and result tables as sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """df, computed once: as Parquet in the shared folder that spark.checkpoint.dir names, so that lost executors cost nothing; where that is unset, kept by Spark."""
    root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not root:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary one, and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def write_streams(win: DataFrame, path: str) -> None:
    """Windows as Parquet, a folder for each stream and segment, so that a reader of one stream or segment skips the others."""
    win.repartition("det", "seg").sortWithinPartitions("idx").write.partitionBy("det", "seg").mode("overwrite").parquet(path)


def write_results(df: DataFrame, path: str, order: list[str]) -> None:
    """Result rows (triggers, survivors, detections) as JSON lines in order, nulls kept out of the rows; sorted by range, not in one task."""
    df.orderBy(*(F.col(c).asc_nulls_last() for c in order)).write.mode("overwrite").json(path)
