"""A stream of file events applied to an index: the last event of each path counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkwell.plans.ingest import Embedding, ingest, ingest_files
from inkwell.sources.index import Index
from inkwell.sources.markdown import Parsing, read_vault
from inkwell.streaming.events import EVENTS, EventSource
from inkwell.streaming.settle import rocks, settled


def vault_events(spark: SparkSession, root: str, state: str) -> DataFrame:
    """A stream of what changes in a vault from now on; state: a folder of the driver's, one for each stream."""
    spark.dataSource.register(EventSource)
    return spark.readStream.format("vault_events").option("state", state).load(root)


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of JSON event files."""
    return spark.readStream.schema(EVENTS).json(folder)


def actions(events: DataFrame) -> DataFrame:
    """ts, seq, action (upsert, delete or scan), path. A move is a delete and an upsert; other files are ignored."""
    move = F.array(F.struct(F.lit("delete").alias("action"), F.col("path").alias("path")), F.struct(F.lit("upsert").alias("action"), F.col("destination").alias("path")))
    one = lambda action: F.array(F.struct(F.lit(action).alias("action"), F.col("path").alias("path")))
    each = F.when(F.col("is_directory"), one("scan")).when(F.col("kind") == "moved", move).when(F.col("kind") == "deleted", one("delete")).otherwise(one("upsert"))
    rows = events.select("ts", "seq", F.explode(each).alias("a")).select("ts", "seq", "a.*")
    return rows.filter((F.col("action") == "scan") | F.lower("path").endswith(".md")).withColumn("path", F.when(F.col("action") == "scan", F.lit("")).otherwise(F.col("path")))


def latest(rows: DataFrame, key: str = "path", value: str = "action", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The last value of each key."""
    return rows.groupBy(key).agg(F.max_by(value, F.struct(*order)).alias(value))


def debounced(rows: DataFrame, quiet: str = "200 milliseconds", late: str = "1 second") -> DataFrame:
    """On a stream of actions: one row a path for each burst that a quiet time ended, with its last action."""
    return rows.withWatermark("ts", late).groupBy("path", F.session_window("ts", quiet)).agg(F.max_by("action", F.struct("ts", "seq")).alias("action"), F.count(F.lit(1)).alias("events"))


#: Paths of a batch that are read by name; beyond, the vault is read and joined.
DUE = 10_000


def apply_batch(index: Index, root: str, due: DataFrame, parsing: Parsing | None = None, embedding: Embedding | None = None) -> dict:
    """Applies actions (path, action; one a path). Of few paths only these files are opened."""
    due = due.persist()
    try:
        if not due.filter("action = 'scan'").isEmpty():
            return ingest(index, root, parsing, embedding)
        new = due.filter("action = 'upsert'").select("path")
        paths = [r[0] for r in new.limit(DUE + 1).collect()]
        files = read_vault(index.spark, root, paths) if len(paths) <= DUE else read_vault(index.spark, root).join(new, "path", "left_semi")
        return ingest_files(index, files, parsing, embedding, deleted=due.filter("action = 'delete'").select("path"))
    finally:
        due.unpersist()


def watch(
    index: Index, root: str, events: DataFrame, checkpoint: str, parsing: Parsing | None = None, embedding: Embedding | None = None, interval: str | None = None, attempts: int = 3,
    wait: Callable[[float], None] | None = None, quiet: float | None = 0.2, reconcile: float | None = None, scan_first: bool = False,
) -> StreamingQuery:
    """Starts the stream: it applies what each trigger brings, retrying with growing pauses.

    interval None: what there is, then it stops; the last event of a path in a batch counts. Else triggers go on, with or
    without events, and quiet holds a path's events, as state of the stream, until it had none for so many seconds (None: the
    last event of a batch counts). reconcile: seconds after which a trigger ingests the whole vault, which catches what
    events missed. scan_first: the first batch of this run ingests the whole vault. As the stream alone commits, a scan and
    events don't collide; events are observed from before the scan on."""
    import time

    pause, clock = wait or time.sleep, {"scanned": None if scan_first else time.monotonic()}
    held = quiet is not None and interval is not None
    rows = settled(actions(events), quiet) if held else events

    def batch(rows: DataFrame, _: int) -> None:
        rows = rows.persist()
        try:
            apply(rows, rows.count())  # all partitions of a state are worked on once, whatever becomes of the rows
        finally:
            rows.unpersist()

    def apply(rows: DataFrame, count: int) -> None:
        for attempt in range(attempts):
            try:
                scanned = clock["scanned"]
                if scanned is None or reconcile is not None and time.monotonic() - scanned >= reconcile:
                    ingest(index, root, parsing, embedding)  # finds what this batch's events tell as well
                    clock["scanned"] = time.monotonic()
                elif count:
                    apply_batch(index, root, rows.select("path", "action") if held else latest(actions(rows)), parsing, embedding)
                return
            except Exception:
                if attempt + 1 == attempts:
                    raise
                pause(min(30.0, 2.0**attempt))

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    if held:
        with rocks(index.spark):
            return writer.outputMode("update").trigger(processingTime=interval).start()
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
