"""Where tables between jobs are written, and how small ones are read."""

from __future__ import annotations

import re
import tempfile

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes a core below which a table is dealt out anew, if it has fewer files than cores: so small a file may be one row group,
#: which one task would read alone.
SMALL = 8 << 20
#: The temporary folder of a local run without a shared one.
_local: list[str] = []


def dealt(df: DataFrame) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < SMALL * cores and len(df.inputFiles()) < cores else df


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where it is unset and all tasks run in the driver's own process (local runs,
    tests) a temporary one is made: on a cluster each executor would write to a disk of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not _local:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
        _local.append(tempfile.mkdtemp(prefix="inkwell-"))
    return (folder or _local[0]).rstrip("/")


def numbered(df: DataFrame, order: list[Column], path: str, name: str = "position") -> DataFrame:
    """Writes df to path in the given order and reads it with each row's place (long, from 0): dealt out by ranges and sorted
    there, so that only one count a range reaches the driver. Give an order that tells rows apart."""
    spark = df.sparkSession
    df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    return read_numbered(spark, path, name)


def read_numbered(spark: SparkSession, path: str, name: str = "position") -> DataFrame:
    """What numbered() wrote. A row's range is in the upper bits of its number, its place there in the lower 33."""
    rows = spark.read.parquet(path)
    part = F.shiftright("_at", 33)
    counts = sorted((r[0], r[1]) for r in rows.groupBy(part.alias("part")).count().collect())
    starts = spark.createDataFrame(list(zip((p for p, _ in counts), accumulate((n for _, n in counts), initial=0), strict=False)), "_part long, _start long")
    placed = rows.withColumn("_part", part.cast("long")).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_start", "_at")
