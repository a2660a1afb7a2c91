"""The walk of a vault in tasks: folders are rows, listed round by round; paths never come to the driver."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.markdown import FILES, read_note

LISTED = "path string, folder boolean, error string"
#: Folders of a task in a round, and bytes of notes that a task reads before it gives them on.
FOLDERS, HELD = 64, 16 << 20


def entries(root: str, folder: str) -> list[tuple[str, bool, str | None]]:
    """What is in a folder: notes and folders, without links. A folder that can't be listed has a row with its error."""
    found = []
    try:
        with os.scandir(os.path.join(root, folder)) as own:
            for e in own:
                path = f"{folder}/{e.name}" if folder else e.name
                if e.is_dir(follow_symlinks=False):
                    found.append((path, True, None))
                elif e.name.lower().endswith(".md") and e.is_file(follow_symlinks=False):
                    found.append((path, False, None))
    except OSError as e:
        found.append((folder or ".", True, type(e).__name__))
    return found


def walk(spark: SparkSession, root: str, staged: str) -> tuple[DataFrame, DataFrame]:
    """Notes (path) under root, and folders that couldn't be listed (path, error). Every node mounts root; staged: a folder
    that all of them share, where each round's listing is written, so that each folder is listed once.

    There are as many rounds as folders are deep. An empty or absent vault has no notes (an absent one an error)."""
    root = os.path.realpath(root)

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                yield pd.DataFrame(entries(root, folder), columns=["path", "folder", "error"])

    frontier, count, rounds = spark.createDataFrame([("",)], "path string"), 1, []
    while count:
        place = f"{staged}/round-{len(rounds)}"
        tasks = min(-(-count // FOLDERS), 4 * spark.sparkContext.defaultParallelism)
        frontier.repartition(tasks).mapInPandas(listed, LISTED).write.parquet(place)
        rounds.append(place)
        frontier = spark.read.schema(LISTED).parquet(place).filter("folder and error is null").select("path")
        count = frontier.count()
    whole = spark.read.schema(LISTED).parquet(*rounds)
    return whole.filter("not folder").select("path"), whole.filter("folder and error is not null").select("path", "error")


def contents(paths: DataFrame, root: str) -> DataFrame:
    """path, content, error of notes, read in tasks: rows go on whenever so many bytes are held."""
    root = os.path.realpath(root)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, size = [], 0
            for path in batch["path"]:
                rows.append(read_note(root, path))
                size += len(rows[-1][1] or b"")
                if size > HELD:
                    yield pd.DataFrame(rows, columns=["path", "content", "error"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["path", "content", "error"])

    return paths.select("path").mapInPandas(read, FILES)


def hashed(paths: DataFrame, root: str, staged: str) -> DataFrame:
    """path, sha256 (null for what can't be read) of notes, written: their bytes don't leave the tasks that read them."""
    contents(paths, root).select("path", F.sha2("content", 256).alias("sha256")).write.parquet(f"{staged}/hashes")
    return paths.sparkSession.read.schema("path string, sha256 string").parquet(f"{staged}/hashes")
