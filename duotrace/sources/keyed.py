"""A table that is kept for the parameters it was made with, and grows by what is absent."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ParameterTable:
    """Parquet under `path`, a folder for each set of parameters and each unit (a segment, say), and a manifest of the finished ones.

    The parameters' canonical JSON is hashed; another value of any of them is another folder, so stale rows are never read.
    A unit counts as present once the manifest, written after its rows, names it; rows of a run that was lost are
    overwritten by the next, partition by partition.
    """

    def __init__(self, spark: SparkSession, path: str, parameters: dict, unit: str):
        self.spark, self.path, self.unit = spark, path.rstrip("/"), unit
        self.text = json.dumps(parameters, sort_keys=True)
        self.key = hashlib.sha256(self.text.encode()).hexdigest()[:24]
        self.data, self.manifest = f"{self.path}/{self.key}/rows", f"{self.path}/{self.key}/manifest"

    def _there(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def present(self) -> DataFrame:
        """The units that are finished, with the parameters' text."""
        if not self._there(self.manifest):
            return self.spark.createDataFrame([], f"{self.unit} long, parameters string")
        return self.spark.read.parquet(self.manifest).distinct()

    def absent(self, units: DataFrame) -> DataFrame:
        return units.select(self.unit).distinct().join(self.present(), self.unit, "left_anti")

    def add(self, units: DataFrame, make: Callable[[DataFrame], DataFrame]) -> int:
        """Make the rows of those units that are absent, and only theirs; how many units that were. make: units to rows that have the unit's column."""
        new = [r[0] for r in self.absent(units).collect()]  # a value a unit
        if new:
            todo = self.spark.createDataFrame([(u,) for u in new], f"{self.unit} long")
            make(todo).repartition(self.unit).write.partitionBy(self.unit).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self.data)
            todo.withColumn("parameters", F.lit(self.text)).coalesce(1).write.mode("append").parquet(self.manifest)
        return len(new)

    def read(self) -> DataFrame:
        """Rows of the finished units. A filter on the unit prunes folders."""
        done = self.present().select(F.col(self.unit).alias("_unit"))
        rows = self.spark.read.parquet(self.data)
        return rows.join(F.broadcast(done), rows[self.unit] == done["_unit"], "left_semi")  # a row a unit
