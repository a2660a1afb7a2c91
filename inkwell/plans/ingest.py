"""Incremental ingestion: what changed is parsed, chunked and embedded; what failed keeps its last good version."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.text import content_hash, error_text, tokens
from inkwell.sources.index import Change, Index
from inkwell.sources.markdown import PARSED, Parsing, hashing_embedding, parse
from inkwell.sources.walk import contents, hashed, walk


def changed(files: DataFrame, documents: DataFrame, fingerprint: Column | str) -> DataFrame:
    """Files (path, sha256, ...) that aren't in documents with the same bytes and processing."""
    known = documents.select("path", "sha256", F.col("processing_fingerprint").alias("_print"))
    same = known.filter(F.col("_print") == (F.lit(fingerprint) if isinstance(fingerprint, str) else fingerprint)).drop("_print")
    return files.join(same, ["path", "sha256"], "left_anti")


def vanished(documents: DataFrame, present: DataFrame) -> DataFrame:
    """Paths of documents that aren't present any more."""
    return documents.select("path").join(present.select("path"), "path", "left_anti")


def ledger(errors: DataFrame, outcomes: DataFrame, removed: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """Errors after outcomes (path, source_hash, stage and error, null for success; one a path) and removed paths.

    A failure counts an attempt of its (path, hash, stage) and opens it; its path's errors of other bytes are
    superseded, those of other stages resolved (which counts as an attempt's time, too). A success resolves its bytes' errors and supersedes others'. A removed
    path's are superseded. Only open errors change."""
    now = F.current_timestamp() if now is None else now
    own = outcomes.select(F.col("path").alias("source_path"), F.col("source_hash").alias("_hash"), F.col("stage").alias("_stage"), error_text(F.col("error")).alias("_error"))
    rows = errors.join(own, "source_path", "left")
    if removed is not None:
        rows = rows.join(removed.select(F.col("path").alias("source_path")).distinct().withColumn("_gone", F.lit(True)), "source_path", "left")
    else:
        rows = rows.withColumn("_gone", F.lit(None).cast("boolean"))
    same = F.col("_hash") == F.col("source_hash")
    again = F.coalesce(same & (F.col("_stage") == F.col("stage")), F.lit(False))
    is_open = F.col("status") == "unresolved"
    status = (
        F.when(again, "unresolved")
        .when(is_open & F.coalesce("_gone", F.lit(False)), "superseded")
        .when(is_open & F.col("_hash").isNotNull(), F.when(same, "resolved").otherwise("superseded"))
        .otherwise(F.col("status"))
    )
    kept = rows.select(
        "source_path", "source_hash", "stage", F.when(again, F.col("_error")).otherwise(F.col("error_details")).alias("error_details"), (F.col("attempt_count") + again.cast("int")).alias("attempt_count"),
        "first_seen_at", F.when(again | (status != F.col("status")), now).otherwise(F.col("last_attempt_at")).alias("last_attempt_at"), status.alias("status"),
    )
    failed = own.filter("_stage is not null").select("source_path", F.col("_hash").alias("source_hash"), F.col("_stage").alias("stage"), F.col("_error").alias("error_details"))
    new = failed.join(errors.select("source_path", "source_hash", "stage"), ["source_path", "source_hash", "stage"], "left_anti")
    return kept.unionByName(new.select("source_path", "source_hash", "stage", "error_details", F.lit(1).alias("attempt_count"), now.alias("first_seen_at"), now.alias("last_attempt_at"), F.lit("unresolved").alias("status")))


@dataclass
class Embedding:
    """The vectors of chunks. embed(texts) -> one finite vector of so many dimensions a text, in order, run in Arrow batches
    within tasks; None: the hashing embedder."""

    dimensions: int = 384
    model: str = "hashing"
    version: str = "1"
    embed: Callable[[list[str]], list[list[float]]] | None = None

    def column(self, text: str) -> Column:
        if self.embed is None:
            return hashing_embedding(self.dimensions)[1](text)
        embed, size = self.embed, self.dimensions

        @F.pandas_udf("array<float>")
        def vectors(texts: pd.Series) -> pd.Series:
            found = np.asarray(embed(texts.tolist()), dtype=np.float64).reshape(-1, size) if len(texts) else np.zeros((0, size))
            if len(found) != len(texts) or not np.isfinite(found.astype(np.float32)).all():
                raise ValueError("an embedder gives one finite vector a text")
            return pd.Series(list(found.astype(np.float32)))

        return vectors(text)


def new_rows(parsed: DataFrame, fingerprint: str, embedding: Embedding) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks of parsed files without an error."""
    good = parsed.filter("stage is null")
    documents = good.select(
        "path", "sha256", F.lit(fingerprint).alias("processing_fingerprint"), "metadata_json", F.lit(embedding.model).alias("embedding_model"), F.lit(embedding.version).alias("embedding_version"),
        F.current_timestamp().alias("ingested_at"), "body", content_hash("body").alias("body_sha256"),
    )
    each = good.select(F.col("path").alias("source_path"), F.explode("chunks").alias("c")).select("source_path", "c.*")
    chunks = each.select("chunk_id", "source_path", "ordinal", "content", content_hash("content").alias("content_sha256"), tokens("content").alias("tokens"), embedding.column("content").alias("embedding"))
    return documents, chunks


def ingest_files(index: Index, files: DataFrame, parsing: Parsing | None = None, embedding: Embedding | None = None, deleted: DataFrame | None = None) -> dict[str, Any]:
    """Ingests files (path, content, error) and commits. deleted: paths that are known to be gone."""
    parsing, embedding = parsing or Parsing(), embedding or Embedding()
    base, old = index.version(), index.tables()
    todo = changed(files.withColumn("sha256", F.sha2("content", 256)), old["documents"], fingerprint_of(parsing, embedding))
    return _commit(index, base, old, todo, files.count(), parsing, embedding, deleted)


def fingerprint_of(parsing: Parsing, embedding: Embedding) -> str:
    return parsing.fingerprint() + f"/{embedding.model}/{embedding.version}/{embedding.dimensions}"


def _commit(index: Index, base: int, old: dict[str, DataFrame], todo: DataFrame, seen: int, parsing: Parsing, embedding: Embedding, removed: DataFrame | None, failed: DataFrame | None = None) -> dict[str, Any]:
    """Parses todo (path, content, error) and publishes the version after base. failed: outcomes of what couldn't be listed."""
    index.check_dimensions(embedding.dimensions)
    staged = f"{index.root.rstrip('/')}/staged/{uuid.uuid4().hex}"
    parse(todo, parsing).write.parquet(staged)  # parsed once, used by three tables
    parsed = index.spark.read.schema(PARSED).parquet(staged)
    documents, chunks = new_rows(parsed, fingerprint_of(parsing, embedding), embedding)
    gone = documents.select("path") if removed is None else documents.select("path").union(removed.select("path"))
    outcomes = parsed.select("path", F.col("sha256").alias("source_hash"), "stage", "error")
    outcomes = outcomes if failed is None else outcomes.unionByName(failed)
    told = outcomes.select("path") if removed is None else outcomes.select("path").union(removed.select("path"))
    open_before = old["errors"].join(told.select(F.col("path").alias("source_path")).distinct(), "source_path", "left_semi").select(*old["errors"].columns)
    changes = {"documents": Change(gone, documents), "chunks": Change(gone, chunks), "errors": Change(told, ledger(open_before, outcomes, removed))}
    index.commit(changes, base, embedding.dimensions)
    done = parsed.agg(F.count_if(F.col("stage").isNull()), F.count_if(F.col("stage").isNotNull())).first()
    return {
        "discovered": seen, "ingested": done[0], "failures": done[1], "skipped": seen - done[0] - done[1], "removed": 0 if removed is None else old["documents"].join(removed, "path", "left_semi").count(),
        "unresolved_errors": index.table("errors").filter("status = 'unresolved'").count(),
    }


def ingest(index: Index, root: str, parsing: Parsing | None = None, embedding: Embedding | None = None) -> dict[str, Any]:
    """A whole vault: listed once, in tasks, and hashed there; only notes that changed are read again, parsed and stored. If a
    folder couldn't be listed, nothing is removed and the ledger has it as a failure to discover."""
    parsing, embedding = parsing or Parsing(), embedding or Embedding()
    staged = f"{index.root.rstrip('/')}/staged/walk-{uuid.uuid4().hex}"
    present, unread = walk(index.spark, root, staged)
    hashes = hashed(present, root, staged)
    base, old = index.version(), index.tables()
    todo = contents(changed(hashes, old["documents"], fingerprint_of(parsing, embedding)), root)
    complete = unread.isEmpty()
    removed = failed = None
    if complete:
        lost = old["errors"].select(F.col("source_path").alias("path")).join(present, "path", "left_anti")
        removed = vanished(old["documents"], present).union(lost).distinct()
    else:
        failed = unread.select("path", F.lit("").alias("source_hash"), F.lit("discover").alias("stage"), "error")
    return _commit(index, base, old, todo, hashes.count(), parsing, embedding, removed, failed) | {"discovery_complete": complete}


def backoff(attempt: Column, base: float = 1.0, most: float = 30.0) -> Column:
    """Seconds to wait after the attempt of that number (from 0)."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))
