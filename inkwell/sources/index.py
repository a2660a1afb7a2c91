"""An index in Parquet: rows in buckets of their key's hash, and a small manifest that names the folders of a version.

A commit writes the buckets that it touches to new folders, then publishes a manifest under the next version's name, which
fails if there is one: of two writers one loses, and a reader sees the whole of one version or of another. Readers take the
highest version and keep its folders until vacuum() removes them. A change of one note costs one bucket of a table."""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "documents": "path string, sha256 string, processing_fingerprint string, metadata_json string, embedding_model string, embedding_version string, ingested_at timestamp, body string, body_sha256 string",
    "chunks": "chunk_id string, source_path string, ordinal int, content string, content_sha256 string, tokens array<string>, embedding array<float>",
    "attributes": "domain string, sha256 string, attributes_json string, updated_at timestamp",
    "errors": "source_path string, source_hash string, stage string, error_details string, attempt_count int, first_seen_at timestamp, last_attempt_at timestamp, status string",
}
#: Tables that each commit of chunks derives from them, in the same buckets: where each word stands, and how many chunks of a
#: bucket hold it.
DERIVED = {
    "postings": "term string, source_path string, ordinal int, place int, n_words int",
    "terms": "term string, chunks long",
}
SCHEMAS = TABLES | DERIVED
#: The column whose hash says a row's bucket, and the number of buckets of a new index if none is given.
KEYS = {"documents": "path", "chunks": "source_path", "attributes": "sha256", "errors": "source_path"}
BUCKETS = 64
#: The order of rows within a file: a reader's condition on the first column skips row groups and pages.
SORTED = {"documents": ("path",), "chunks": ("source_path", "ordinal"), "attributes": ("sha256",), "errors": ("source_path",), "postings": ("term", "source_path", "ordinal", "place"), "terms": ("term",)}


class IndexSchemaError(Exception):
    """A table or a column is missing, or vectors have other dimensions."""


@dataclass
class Change:
    """New rows for some keys of a table: all rows of the keys (one column) go, rows come."""

    keys: DataFrame
    rows: DataFrame


@dataclass(frozen=True)
class Statistics:
    """Counts over all chunks, from the manifest: no table is read. filled: chunks that aren't null, over which an average is."""

    chunks: int
    words: int
    filled: int

    @property
    def average(self) -> float | None:
        return self.words / self.filled if self.filled else None


def bucket_of(key: Column | str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def postings_of(chunks: DataFrame) -> DataFrame:
    """A row for each word of each chunk: term, source_path, ordinal, place (from 0), n_words (of the chunk)."""
    return chunks.select("*", F.posexplode("tokens").alias("place", "term")).withColumn("n_words", F.size("tokens"))


@dataclass
class Index:
    """buckets: of a new index, the more the larger it will be: a commit rewrites the buckets that it touches."""

    spark: SparkSession
    root: str
    buckets: int = BUCKETS

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.root.rstrip("/"), *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return [s.getPath().getName() for s in self._files().listStatus(path)] if self._files().exists(path) else []

    # Versions --------------------------------------------------------------------------------------------------------

    def version(self) -> int:
        """0 if there is no index yet."""
        found = (re.fullmatch(r"v(\d{12})\.json", n) for n in self._names("manifests"))
        return max((int(m[1]) for m in found if m), default=0)

    def manifest(self, version: int | None = None) -> dict[str, Any]:
        version = self.version() if version is None else version
        if not version:
            return {"tables": {name: {} for name in SCHEMAS}, "dimensions": None, "buckets": self.buckets, "statistics": {}}
        try:
            return json.loads(self.spark.read.text(str(self._path("manifests", f"v{version:012d}.json")), wholetext=True).first()[0])
        except Exception as e:
            raise IndexSchemaError(f"version {version} can't be read") from e

    def _publish(self, version: int, manifest: dict[str, Any]) -> None:
        """Writes beside and renames without overwriting."""
        jvm = self.spark.sparkContext._jvm
        beside, there = self._path("manifests", f".{uuid.uuid4().hex}"), self._path("manifests", f"v{version:012d}.json")
        out = self._files().create(beside, True)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files().getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._files().makeQualified(beside), self._files().makeQualified(there), options)
        except Exception as e:
            self._files().delete(beside, False)
            raise RuntimeError("another writer has committed") from e

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what no one of the last `keep` versions names: older manifests, folders of data, staged tables."""
        last = self.version()
        kept = {n.split("/")[2] for v in range(max(1, last - keep + 1), last + 1) for t in self.manifest(v)["tables"].values() for n in t.values()}
        old = [("manifests", n) for n in self._names("manifests") if not n.startswith("v") or int(n[1:13]) <= last - keep]
        old += [("data", name, n) for name in SCHEMAS for n in self._names("data", name) if n not in kept] + [("staged", n) for n in self._names("staged")]
        for parts in old:
            self._files().delete(self._path(*parts), True)
        return len(old)

    # Tables ----------------------------------------------------------------------------------------------------------

    def _read(self, name: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMAS[name])
        try:
            rows = self.spark.read.parquet(*(str(self._path(f)) for f in folders))
        except Exception as e:
            raise IndexSchemaError(f"{name} can't be read") from e
        wanted = {f.name: f.dataType for f in self.spark.createDataFrame([], SCHEMAS[name]).schema}
        if any(k not in rows.columns or rows.schema[k].dataType != v for k, v in wanted.items()):
            raise IndexSchemaError(f"{name} lacks a column")
        return rows.select(*wanted)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self._read(name, sorted(self.manifest(version)["tables"].get(name, {}).values()))

    def tables(self, manifest: dict[str, Any] | None = None) -> dict[str, DataFrame]:
        """All tables of one commit."""
        manifest = manifest or self.manifest()
        return {name: self._read(name, sorted(manifest["tables"].get(name, {}).values())) for name in SCHEMAS}

    def statistics(self, manifest: dict[str, Any] | None = None) -> Statistics | None:
        """Of all chunks; None for an index whose commits didn't count them."""
        counts = (manifest or self.manifest()).get("statistics")
        # Commits before the third number counted chunks and words alone.
        return None if counts is None else Statistics(*(sum(c[i] if i < len(c) else c[0] for c in counts.values()) for i in range(3)))

    def _of_key(self, name: str, key: str) -> DataFrame:
        """Rows of one key: its bucket is all that is read."""
        manifest = self.manifest()
        bucket = self.spark.range(1).select(bucket_of(F.lit(key), manifest.get("buckets", BUCKETS))).first()[0]
        folder = manifest["tables"][name].get(str(bucket))
        return self._read(name, [folder] if folder else []).filter(F.col(KEYS[name]) == key)

    def document(self, path: str) -> DataFrame:
        return self._of_key("documents", path)

    def chunks_of(self, path: str) -> DataFrame:
        return self._of_key("chunks", path).orderBy("ordinal")

    # Commits ---------------------------------------------------------------------------------------------------------

    def check_dimensions(self, dimensions: int) -> None:
        known = self.manifest()["dimensions"]
        if known is not None and known != dimensions:
            raise IndexSchemaError(f"vectors have {known} dimensions, not {dimensions}")

    def commit(self, changes: dict[str, DataFrame | Change], base: int | None = None, dimensions: int | None = None) -> int:
        """Publishes a version with new tables (all rows) or changed ones; others stay. base: the version they derive from."""
        base = self.version() if base is None else base
        if base != self.version():
            raise RuntimeError("another writer has committed")
        manifest = self.manifest(base)
        buckets = manifest.get("buckets", BUCKETS)
        for name, change in changes.items():
            before = manifest["tables"][name]
            after, touched = self._written(name, change, before, buckets)
            manifest["tables"][name] = after
            if name == "chunks":
                self._derive(manifest, {b: f for b, f in after.items() if before.get(b) != f}, touched)
        if dimensions is not None:
            manifest["dimensions"] = dimensions
        self._publish(base + 1, manifest)
        return base + 1

    def _derive(self, manifest: dict[str, Any], new: dict[str, str], touched: set[str] | None) -> None:
        """Postings, terms and counts of the buckets of chunks that were written; those of other buckets stay."""
        left = lambda old: {} if touched is None else {b: v for b, v in old.items() if b not in touched}
        for name in DERIVED:
            manifest["tables"][name] = left(manifest["tables"].get(name, {}))
        if "statistics" in manifest or touched is None:
            manifest["statistics"] = left(manifest.get("statistics", {}))
        if not new:
            return
        folder = next(iter(new.values())).rsplit("/", 1)[0]
        chunks = self.spark.read.parquet(str(self._path(folder))).select("bucket", "source_path", "ordinal", "tokens")
        if "statistics" in manifest:
            counts = chunks.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("words"), F.count("tokens").alias("filled")).collect()  # one row a bucket
            manifest["statistics"] |= {str(r["bucket"]): [r["n"], r["words"], r["filled"]] for r in counts}
        manifest["tables"]["postings"] |= self._put("postings", postings_of(chunks))
        each = chunks.select("bucket", F.explode(F.array_distinct("tokens")).alias("term")).groupBy("bucket", "term").agg(F.count(F.lit(1)).alias("chunks"))
        manifest["tables"]["terms"] |= self._put("terms", each)

    def _put(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Writes rows with their bucket to a new folder; gives the folders of buckets."""
        folder, columns = f"data/{name}/{uuid.uuid4().hex}", [f.name for f in self.spark.createDataFrame([], SCHEMAS[name]).schema]
        # Buckets of any size: large ones are split, small ones share a task.
        dealt = rows.select("bucket", *columns).hint("rebalance", "bucket")
        dealt.sortWithinPartitions("bucket", *SORTED[name]).write.partitionBy("bucket").parquet(str(self._path(folder)))
        return {n.removeprefix("bucket="): f"{folder}/{n}" for n in self._names(folder) if n.startswith("bucket=")}

    def _written(self, name: str, change: DataFrame | Change, folders: dict[str, str], buckets: int) -> tuple[dict[str, str], set[str] | None]:
        """Folders of a table's buckets after a change, and which buckets were written (None: all)."""
        key, columns = KEYS[name], [f.name for f in self.spark.createDataFrame([], TABLES[name]).schema]
        touched = None
        if isinstance(change, Change):
            keys = change.keys.toDF(key).distinct()
            found = keys.select(bucket_of(key, buckets)).union(change.rows.select(bucket_of(key, buckets))).distinct().collect()  # at most one row a bucket
            touched = {str(r[0]) for r in found}
            old = self._read(name, [f for b, f in folders.items() if b in touched])
            rows = old.join(keys, key, "left_anti").select(*columns).unionByName(change.rows.select(*columns))
        else:
            rows = change.select(*columns)
        kept = {b: f for b, f in folders.items() if touched is not None and b not in touched}
        if touched is not None and not touched:
            return kept, touched
        return kept | self._put(name, rows.withColumn("bucket", bucket_of(key, buckets))), touched
