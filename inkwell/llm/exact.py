"""Exact deduplication by content-defined chunk recipes.

A normalised text is cut where a rolling hash of its bytes says so. Distinct chunks get verified identifiers: chunks
with the same short key but another SHA-256 digest or length are told apart. A document is then the ordered list of its
chunks' identifiers, and equal lists are equal texts; no text leaves the task that read it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import _text
from inkwell.llm._tables import stash, text_hash

WHITE = b" \t\n\x0b\x0c\r"
#: A cut follows a byte where the 13 upper bits of the rolling hash are zero (8 KB on average), from 2 KB to 64 KB after the last.
MASK, LEAST, MOST = np.uint64(0xFFF8 << 48), 2048, 65536
#: The rolling hash covers 64 bytes; each byte value has a random 64-bit number, made from this rule.
GEAR = _text.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum of the numbers of the last 64 bytes, each shifted by its age."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16, 32):
        older = h[:-k] << np.uint64(k)
        h[k:] = h[k:] + older
    return h


def cut_points(data: bytes) -> list[int]:
    """Ends of chunks. An empty text has no chunk."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    found = np.flatnonzero((rolling(np.frombuffer(data, dtype=np.uint8)) & MASK) == 0) + 1
    ends, last = [], 0
    for end in [*found.tolist(), n]:
        while end - last > MOST:
            last += MOST
            ends.append(last)
        if end - last >= LEAST or end == n and end > last:
            ends.append(end)
            last = end
    return ends


def recipes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points, whole, keys, digests, sizes, at = [], [], [], [], [], [0]
            for x in batch.column(2).to_pylist():
                x = x or ""
                data = x.encode("utf-8", "surrogatepass").translate(None, WHITE)
                points.append(len(x))
                whole.append(hashlib.sha256(data).hexdigest())
                begin = 0
                for end in cut_points(data):
                    digest = hashlib.sha256(data[begin:end]).digest()
                    keys.append(int.from_bytes(hashlib.blake2b(data[begin:end], digest_size=8).digest(), "little", signed=True))
                    digests.append(digest)
                    sizes.append(end - begin)
                    begin = end
                at.append(len(keys))
            chunks = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64())], names=["key", "digest", "size"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(points, pa.int64()), pa.array(whole, pa.string()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), chunks)], names=["row", "id", "text_hash", "n_points", "text_sha256", "chunks"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string"), text_hash(text_col))
    return rows.mapInArrow(_text.tidy(chunk), f"row long, id {kind}, text_hash long, n_points long, text_sha256 string, chunks array<struct<key: long, digest: binary, size: long>>")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, keep_id (of the row of its group that stays), group_size, kept, text_sha256, text_hash.

    Texts are equal when identical without space, tab, LF, VT, FF and CR; null counts as empty, and all empty texts are
    one group. The row with the most code points in its original text stays, then the smallest id (null last). Of
    rows that agree in these too, exactly one is kept. Other columns don't matter; an empty table gives no rows."""
    rows = stash(recipes(docs, id_col, text_col), "recipes")
    chunks = rows.select("row", F.posexplode("chunks").alias("place", "chunk")).select("row", "place", "chunk.*")
    # The catalogue has each distinct chunk once. Variants of a key exist only if its short hash collides.
    catalogue = chunks.groupBy("key", "digest", "size").agg(F.lit(1).alias("_"))
    catalogue = catalogue.select("key", "digest", "size", F.row_number().over(Window.partitionBy("key").orderBy("digest", "size")).alias("variant"))
    named = chunks.join(catalogue, ["key", "digest", "size"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "key", "variant"))).alias("parts"))
    lists = named.select("row", F.transform("parts", lambda p: F.struct(p["key"], p["variant"])).alias("recipe"))
    empty = F.array().cast("array<struct<key: bigint, variant: int>>")
    known = rows.drop("chunks").join(lists, "row", "left").select("row", "id", "text_hash", "n_points", "text_sha256", F.coalesce("recipe", empty).alias("recipe"))
    known = stash(known, "known")
    # Null sorts first in a struct's order: the flag puts null ids last.
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("id").isNull().alias("none"), "id", "row"))
    # Written, so that the join can split the rows of a large group among tasks.
    groups = stash(known.groupBy("recipe").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    return known.join(groups, "recipe").select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "text_hash"
    )
