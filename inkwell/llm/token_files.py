"""Token ids of documents in files of compressed blocks, in the order of document ids.

A file is a shard: Parquet whose rows are blocks (see mixcoder), each coded on its own and checked by two checksums, so that
blocks are read by any number of tasks, and a range of document ids reads the blocks that may hold it. A block holds whole
documents; beside its ids are their documents' ids and lengths. Spark writes and reads the files, in any store that it knows."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import _text, mixcoder
from inkwell.llm._tables import partitions, shared_folder, small_batches, stash
from inkwell.llm.packing import encoder

#: Ids of a block, about: it ends with the document that reaches this number.
BLOCK_IDS = 1 << 20
#: Bytes of a row group: few blocks are held at once.
GROUP_BYTES = 16 << 20


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """Blocks (shard, block, first, n_docs, n_ids, least, most, ids, lengths, payload) of documents dealt out by ranges of
    their ids, so that shards follow each other."""
    value = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Rows of one id, or of none, are told apart by their texts and then their places, so that any number of them is split.
    rows = docs.select(F.col(id_col).alias("id"), value.alias("text"), F.xxhash64(value).alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_last(), F.col("hash"), F.col("row")]
    rows = rows.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order).select("text", "id", F.spark_partition_id().alias("shard"))
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        vocabulary = max(own.tokenizer.get_vocab_size(), end_id + 1)
        parts, lengths, names, shard, block, first = [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal block, first
            ids = np.concatenate(parts)
            known = pa.concat_arrays(names)
            n, size = pa.array(np.concatenate(lengths), pa.int64()), len(ids)
            out = {
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "first": pa.array([first], pa.int64()), "n_docs": pa.array([len(n)], pa.int64()), "n_ids": pa.array([size], pa.int64()),
                "least": known.slice(0, 1), "most": known.slice(len(known) - 1 - known.null_count if known.null_count < len(known) else 0, 1),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(known)], pa.int32()), known), "lengths": pa.ListArray.from_arrays(pa.array([0, len(n)], pa.int32()), n),
                "payload": pa.array([mixcoder.encode(ids, vocabulary)], pa.binary()),
            }
            block, first = block + 1, first + size
            parts.clear(), lengths.clear(), names.clear()
            return pa.RecordBatch.from_pydict(out)

        held = 0
        for batch in batches:
            data, offsets = _text.buffers(batch.column(0))
            for a, b in _text.steps(offsets, min(_text.STEP, 2 * block_ids)):
                shard = batch.column(2)[a].as_py()
                found, at = own.encode(data, offsets[a : b + 1])
                ids = np.insert(found, at[1:], np.uint32(end_id))
                parts.append(ids)
                lengths.append(np.diff(at) + 1)
                names.append(batch.column(1).slice(a, b - a))
                held += len(ids)
                if held >= block_ids:
                    yield close()
                    held = 0
        if held:
            yield close()

    return rows.mapInArrow(_text.tidy(encode, ("encoders",)), f"shard int, block int, first long, n_docs long, n_ids long, least {kind}, most {kind}, ids array<{kind}>, lengths array<long>, payload binary")


def write_documents(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Writes the ids of each document's text, then end_id, as files under path, in ascending order of document ids.

    Ids that are null come last; rows of one id go by a hash of their texts, repeated rows are written each. Null and empty
    texts are end_id alone; a text of any length lies in one block. An empty table gives files without blocks. Other columns
    aren't written. docs has to give the same rows if it is read again. tokenizer: a byte-level BPE file that workers can read."""
    with small_batches(docs.sparkSession):
        encode_documents(docs, tokenizer, end_id, id_col, text_col, block_ids).write.option("parquet.block.size", GROUP_BYTES).option("parquet.enable.dictionary", "false").parquet(path)


def read_documents(spark: SparkSession, path: str, id_col: str = "doc_id", checksums: bool = False, where: Column | None = None) -> DataFrame:
    """One row a document of files that write_documents wrote: id, start (ids of all documents before it), n_tokens, and
    ids (binary, little-endian unsigned 32-bit) or, with checksums, ids_crc32 (of those bytes) instead.

    where: a condition on the columns least and most, the first and last document id of a block; blocks that don't meet it
    aren't read. A block whose checksum or ids differ from what was written fails the job. Use it within small_batches(),
    or write its rows with stash(), so that few blocks are held at once."""
    blocks = spark.read.parquet(path)
    # One row a shard: as many as the files were written with.
    sizes = sorted((r[0], r[1]) for r in blocks.groupBy("shard").agg(F.sum("n_ids")).collect())
    starts = spark.createDataFrame(list(zip((s for s, _ in sizes), accumulate((n for _, n in sizes), initial=0), strict=False)), "shard int, start long")
    kind = blocks.schema["least"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                try:
                    ids = mixcoder.decode(batch.column(3)[i].as_py()).astype("<u4")
                except ValueError as e:
                    raise ValueError(f"shard {batch.column(4)[i]}, block {batch.column(5)[i]}: {e}") from None
                n = batch.column(2)[i].values.to_numpy()
                if int(n.sum()) != len(ids):
                    raise ValueError(f"shard {batch.column(4)[i]}, block {batch.column(5)[i]}: lengths of documents don't add up")
                ends = np.cumsum(n)
                raw, cuts = memoryview(ids.tobytes()), list(zip((4 * (ends - n)).tolist(), (4 * ends).tolist(), strict=True))
                own = pa.array([zlib.crc32(raw[a:b]) for a, b in cuts], pa.int64()) if checksums else pa.array([bytes(raw[a:b]) for a, b in cuts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, pa.array(batch.column(0)[i].as_py() + ends - n), pa.array(n), own], names=[id_col, "start", "n_tokens", "ids_crc32" if checksums else "ids"])

    rows = blocks if where is None else blocks.filter(where)
    rows = rows.join(F.broadcast(starts), "shard").select((F.col("start") + F.col("first")).alias("at"), "ids", "lengths", "payload", "shard", "block")
    return rows.mapInArrow(_text.tidy(decode), f"`{id_col}` {kind}, start long, n_tokens long, " + ("ids_crc32 long" if checksums else "ids binary"))


def written_and_read(docs: DataFrame, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes documents to the shared folder and gives what is read from there: id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/inkwell-{uuid.uuid4().hex}/tokens"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    write_documents(docs, path, tokenizer, end_id, id_col, text_col)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return stash(read_documents(spark, path, id_col, checksums=True), "read")


__all__ = ["encode_documents", "read_documents", "write_documents", "written_and_read"]
