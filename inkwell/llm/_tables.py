"""Tables between jobs: written where all executors can read them, and numbered without a global window."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: monotonically_increasing_id keeps the row of a partition in the lower 33 bits.
ROW_BITS = 33


#: Bytes a core below which a table is dealt out anew, if it has fewer files than cores: so small a file may be one row group, which one task would read alone.
SMALL = 8 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < SMALL * cores and len(df.inputFiles()) < cores else df


def text_hash(column: str) -> Column:
    """A 64-bit hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(column).cast("string"), F.lit("")))


#: The temporary folder of a local run without a shared one.
_local: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only where it is unset and all tasks run in the driver's own process (local runs,
    tests) a temporary one is made: on a cluster each executor would write to a disk of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and _local:
        return _local[0]
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="inkwell-")
        _local.append(folder)
    return folder.rstrip("/")


#: Folders of the tables written within each open scratch().
_open: list[list] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that stash() writes within are deleted at its end: what is still needed has to be written elsewhere by then."""
    own: list = []
    _open.append(own)
    try:
        yield
    finally:
        _open.pop()
        for folder in own:
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows and bytes of a batch that goes to Python, at most (a longer row is taken whole).
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs within send rows to Python in small batches: a batch of whole texts is held several times, by the JVM while its
    buffer grows and by the worker. Settings of the session are as before at its end; smaller ones stay."""
    limits = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {name: spark.conf.get(name, None) for name in limits}
    for name, limit in limits.items():
        if not before[name] or not re.fullmatch(r"\d+", before[name]) or not 0 < int(before[name]) <= limit:
            spark.conf.set(name, limit)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def stash(df: DataFrame, name: str, keep: bool = False, options: dict[str, int] | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: later jobs don't repeat its work, a lost executor
    costs nothing that was written, and ids that depend on the order of evaluation are fixed. Gone when the
    application ends, or (unless keep is set) the scratch() around it. options: of the Parquet writer."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/inkwell-{uuid.uuid4().hex}/{name}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    with small_batches(spark):
        df.write.options(**(options or {})).parquet(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    if _open and not keep:
        _open[-1].append(folder)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_ranges(df: DataFrame, order: list[Column], name: str = "_part") -> DataFrame:
    """Writes df dealt out by ranges of a total order, with the number of each row's range: a running sum in the order
    is then one within the range and one over ranges, whatever the sizes of groups."""
    return stash(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn(name, F.spark_partition_id()), "ranges")


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Adds each row's place (long, from 0) in the given order over all rows.

    Rows are dealt out by range and sorted there, so no task holds more than its share; only one count a partition
    reaches the driver. Ties in the order get places in any order, so give a total one where it matters. The result
    reads a written table: the places don't change when it is evaluated again."""
    spark = df.sparkSession
    placed = stash(df.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_at", ROW_BITS)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("part")).count().collect())
    starts = [0, *accumulate(n for _, n in counts)]
    # One row a partition: a size that is known.
    before = spark.createDataFrame([(p, s) for (p, _), s in zip(counts, starts, strict=False)], "_part long, _start long")
    return placed.withColumn("_part", part.cast("long")).join(F.broadcast(before), "_part").withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))).drop("_part", "_start", "_at")


def running_sum(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str = "before") -> DataFrame:
    """Adds the sum of value (long) over the rows before each one in its group; nulls in group are one.

    Ranges of (group, order) hold the rows, so that a group of any size is split; a window sees one range of one group, and
    another the sums of a group's ranges. The order has to tell a group's rows apart."""
    rows = in_ranges(df, [*(F.col(g).asc_nulls_last() for g in group), *order])
    up_to = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*group, "_part").agg(F.sum(value).alias("_sum"))
    start = F.coalesce(F.sum("_sum").over(up_to(Window.partitionBy(*group).orderBy("_part"))), F.lit(0))
    starts = sums.select(*(F.col(g).alias(f"_of_{g}") for g in group), F.col("_part").alias("_in"), start.alias("_start"))
    within = F.coalesce(F.sum(value).over(up_to(Window.partitionBy(*group, "_part").orderBy(*order))), F.lit(0))
    same = F.col("_part") == F.col("_in")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    rows = rows.withColumn("_within", within).join(starts, same)
    return rows.withColumn(name, (F.col("_start") + F.col("_within")).cast("long")).select(*df.columns, name)
