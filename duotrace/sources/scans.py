"""Catalogues as files: segment lists in JSON, metadata in CSV, banks of signals in nested folders with side files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def json_list(spark: SparkSession, path: str, field: str, schema: str, lines: bool = False) -> DataFrame:
    """The rows that documents at `path` hold in a list `field`, with the document's other fields of the schema. A file is one document that may span lines, or has one a line. One that can't be read fails the job."""
    got = spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    rest = [c for c in got.columns if c != field]
    return got.select(*rest, F.explode(field).alias("_row")).select(*rest, "_row.*")


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Metadata with a header, every column a string, with `_file` and `line` (from 0 in the order of files' names and their lines)."""
    got = spark.read.option("header", True).csv(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    order = Window.partitionBy("_file").orderBy("_start", "_id")
    numbered = got.withColumn("_k", F.row_number().over(order) - 1)
    sizes = numbered.groupBy("_file").agg(F.count("*").alias("_n"))
    before = sizes.select("_file", F.coalesce(F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a file
    return numbered.join(F.broadcast(before), "_file").withColumn("line", F.col("_before") + F.col("_k")).drop("_start", "_id", "_k", "_before")


def _listed(spark: SparkSession, root: str, suffix: str) -> list[str]:
    """Folders and files named signals_* with the suffix, at any depth, sorted by path."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, todo = [], [top]
    while todo:
        for s in fs.listStatus(todo.pop()):
            name = s.getPath().getName()
            if name.startswith("signals_") and name.endswith(suffix):
                found.append(s.getPath().toString())
            elif s.isDirectory() and not name.startswith("signals_"):
                todo.append(s.getPath())
    return sorted(found)


def signal_bank(spark: SparkSession, root: str) -> tuple[DataFrame, str]:
    """(source_id, total_mass, distance_mpc, file and the signals' own columns; the projection mode) of all signals_*.parquet under root.

    A file's rows (k counts them) take their parameters from the lines of signals_*.csv beside it: source_id, distance_mpc,
    total_mass, or mass1 + mass2 where that column is missing, or NaN. Without such a file ids go on counting from the
    rows before, parameters are NaN, and the mode is told by the name. Side files may have different columns. All files
    must be of one mode, else the scan fails; with no sign of it the mode is "unknown". No file, or a file without a
    detector's column, is an error.
    """
    files = _listed(spark, root, ".parquet")
    if not files:
        raise FileNotFoundError(f"no signals under {root}")
    sides = {p.removesuffix(".csv"): p for p in _listed(spark, root, ".csv")}
    modes, parts, before = set(), [], 0
    for path in files:  # a plan a file; rows stay where they are
        rows = spark.read.parquet(path)
        if missing := {"H1", "L1"} - set(rows.columns):
            raise KeyError(f"no {', '.join(sorted(missing))} in {path}")
        count = rows.count()
        nan = F.lit(float("nan"))
        if (stem := path.removesuffix(".parquet")) in sides:
            side = csv_strings(spark, sides[stem])
            number = lambda c: F.col(c).cast("double")
            if "projection_mode" in side.columns:
                modes |= {r[0] for r in side.select("projection_mode").distinct().limit(3).collect()}
            mass = number("total_mass") if "total_mass" in side.columns else number("mass1") + number("mass2") if {"mass1", "mass2"} <= set(side.columns) else nan
            side = side.select(F.col("line").alias("k"), F.col("source_id").cast("long").alias("source_id"), mass.alias("total_mass"), number("distance_mpc").alias("distance_mpc"))
            rows = rows.join(side, "k")
        else:
            name = path.lower()
            modes |= {"projected"} if "projectedbank" in name or "projbank" in name else {"intrinsic"} if "intrinsicbank" in name else set()
            rows = rows.withColumn("source_id", F.col("k") + before).withColumn("total_mass", nan).withColumn("distance_mpc", nan)
        before += count
        parts.append(rows.withColumn("file", F.lit(path.rsplit("/", 1)[-1])))
    if len(modes) > 1:
        raise ValueError(f"mixed projection modes under {root}: {', '.join(sorted(modes))}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out, next(iter(modes), "unknown")
