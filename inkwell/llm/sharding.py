"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata dimensions are quantised to a few bits each, rows are sorted by their cell's place on the curve, and
runs of equal row counts become shards: files whose minima and maxima are narrow in every dimension at once."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm._tables import partitions, stash, with_position

#: Bits of each dimension.
BITS = 5


def hilbert_tables(n: int) -> tuple[list[int], list[int]]:
    """For each state and corner of an n-dimensional cell: the corner's rank on the curve, and the state within it.

    A state is an entry corner and a direction; a sub-curve visits corners in reflected Gray order, turned so that it
    enters and leaves where its neighbours do."""
    size = 1 << n
    turn = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & (size - 1)  # noqa: E731  to the left
    gray = lambda i: i ^ (i >> 1)
    ones = lambda i: (~i & (i + 1)).bit_length() - 1  # noqa: E731  trailing ones
    ranks, states = [], []
    for entry in range(size):
        for direction in range(n):
            for corner in range(size):
                rank = next(i for i in range(size) if turn(gray(i), direction + 1) ^ entry == corner)
                inner = gray(2 * ((rank - 1) // 2)) if rank else 0
                axis = 0 if rank == 0 else ones(rank if rank & 1 else rank - 1) % n
                ranks.append(rank)
                states.append((entry ^ turn(inner, direction + 1)) * n + (direction + axis + 1) % n)
    return ranks, states


def hilbert_index(levels: list[Column], bits: int = BITS) -> Column:
    """Place on the curve of the cell with the given level (0 to 2**bits - 1) in each dimension."""
    n = len(levels)
    ranks, states = (F.lit(x) for x in hilbert_tables(n))

    def step(acc: Column, level: Column) -> Column:
        corner = reduce(lambda a, b: a.bitwiseOR(b), (F.call_function("shiftleft", F.call_function("shiftright", x, level).bitwiseAND(F.lit(1)), F.lit(k)) for k, x in enumerate(levels)))
        at = acc["state"] * (1 << n) + corner
        return F.struct((acc["index"] * (1 << n) + F.get(ranks, at)).cast("long").alias("index"), F.get(states, at).cast("int").alias("state"))

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(F.lit(list(range(bits - 1, -1, -1))), start, step)["index"]


def numeric_level(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """Level by approximate quantiles (2**bits - 1 numbers on the driver); null is 0."""
    ways = (1 << bits) - 1
    row = df.agg(F.percentile_approx(column, [i / (ways + 1) for i in range(1, ways + 1)], 10_000).alias("cuts")).first()
    cuts = F.lit(sorted(set(row["cuts"] or []))) if row["cuts"] else F.array().cast("array<bigint>")
    return F.coalesce(F.size(F.filter(cuts, lambda c: c < F.col(column))), F.lit(0))


def category_level(df: DataFrame, column: str, bits: int = BITS) -> Column:
    """Level of a string column: its value's rank by code point among the distinct ones, scaled. Null is first.

    The driver and the plan hold the first value of each level (2**bits at most), so that rows aren't joined."""
    ranked = with_position(df.select(column).distinct(), [F.col(column).asc_nulls_first()], "_rank")
    most = max(ranked.count(), 1)
    level = F.expr(f"int(_rank * {1 << bits} div {most})")
    firsts = sorted((r[0], r[1]) for r in ranked.groupBy(level.alias("level")).agg(F.min_by(column, "_rank")).collect())
    out = F.lit(0)
    for value, first in firsts:
        out = out if first is None else F.when(F.col(column) >= F.lit(first), value).otherwise(out)
    return F.coalesce(out, F.lit(0))


def hilbert_shards(docs: DataFrame, shards: int, numbers: tuple[str, ...], categories: tuple[str, ...], ties: tuple[str, ...], bits: int = BITS) -> DataFrame:
    """Adds shard int and slot long (gapless from 0 in each shard): row counts of shards are at most one apart.

    Rows with equal cells go by the columns in ties, so that equal values there come to lie in a row; equal rows are
    interchangeable. Nulls are a value of their own in every dimension. An empty table gives an empty result."""
    df = stash(docs, "metadata")
    levels = [numeric_level(df, c, bits) for c in numbers] + [category_level(df, c, bits) for c in categories]
    cells = df.select(*docs.columns, hilbert_index(levels, bits).alias("_cell"))
    placed = with_position(cells, [F.col("_cell"), *(F.col(c).asc_nulls_last() for c in ties)], "_place")
    rows = max(placed.count(), 1)
    begins = F.lit([*accumulate([rows // shards + (k < rows % shards) for k in range(shards)], initial=0)][:-1]).cast("array<bigint>")
    # The first rows % shards shards have one row more.
    more, each = rows % shards, rows // shards
    shard = F.expr(f"int(if(_place < {more * (each + 1)}, _place div {each + 1}, {more} + (_place - {more * (each + 1)}) div {max(each, 1)}))")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("_place") - F.get(begins, F.col("shard"))).drop("_place", "_cell")


def document_metadata(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, size (UTF-8 bytes of the text and 8) and text_crc32 (unsigned); a null text has no bytes."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", "lang", "source", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """Shards documents by size, language and source; equal texts of a cell lie side by side."""
    placed = hilbert_shards(document_metadata(docs), shards, ("size",), ("lang", "source"), ("text_crc32", "doc_id"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "lang", "source")


def write_shards(placed: DataFrame, path: str) -> None:
    """Writes a folder a shard, rows in the order of their slots. Ranges of (shard, slot) go to tasks, so that a shard larger
    than a task's share gets several files, each a run of slots."""
    placed.repartitionByRange(partitions(placed.sparkSession), "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
