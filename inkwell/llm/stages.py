"""Decisions of operators applied to the documents they were made for, without moving texts.

A decision belongs to an id (null counts as one) and a text. Rows that agree in both are alike: if an operator decides
differently for such rows, as many of them follow each decision as it says, no matter which.

Most documents stay once. A bitmap of fixed size marks the others' hashes and is sent to all tasks, so that a row whose bit
isn't set passes in the task that read it. Of rows whose bit is set, decisions are looked up by their hashes in a table that
is sent along too if it is small: it has those that stay (because another's hash has the same place, or more than
once), so that dropped rows need no look-up. Only if it is large, rows with a set bit are joined by a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm._tables import running_sum, stash, text_hash

MINE = "__inkwell_"
ID, TEXT, BITS, TIMES, N, TOTAL = (MINE + x for x in ("id", "text", "bits", "times", "n", "total"))
#: Places of the bitmap, 64 in a row of its table: at most 2**20 rows of two numbers are broadcast.
PLACES = 1 << 26
#: Rows (of three numbers) of a table of decisions that is broadcast.
SENT = 250_000


def key_hash(keys: tuple[str, ...]) -> Column:
    return F.xxhash64(*keys, *(F.col(k).isNull() for k in keys))


def place() -> Column:
    return F.xxhash64(ID, TEXT).bitwiseAND(F.lit(PLACES - 1))


def bit_set() -> Column:
    return F.coalesce(F.expr(f"shiftright({BITS}, int({MINE}place & 63)) & 1 = 1"), F.lit(False))


def looked_up(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Joined by the two hashes: by a broadcast if the table has at most SENT rows, else by a shuffle."""
    return rows.join(F.broadcast(table) if table.count() <= SENT else table, [ID, TEXT], how)


def repeated(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.withColumn(MINE + "copy", F.explode(F.sequence(F.lit(1), F.col(TIMES).cast("int")))).select(*columns)


def agreed(marks: DataFrame, copies: Column, keys: tuple[str, ...]) -> DataFrame:
    """Hashes of ids and texts that have one mark, and how often it says."""
    own = marks.select(key_hash(keys).alias(ID), F.col("text_hash").alias(TEXT), copies.cast("long").alias(TIMES))
    return own.groupBy(ID, TEXT).agg(F.count(F.lit(1)).alias(N), F.max(TIMES).alias(TIMES)).filter(F.col(N) == 1).drop(N)


def decided(docs: DataFrame, marks: DataFrame, copies: Column, keys: tuple[str, ...], text_col: str) -> DataFrame:
    """Repeats each document as often as its mark says; every document has one.

    marks: keys, text_hash and what copies is made of. Null and repeated keys, empty tables and columns of any name are
    allowed; null texts count as empty ones."""
    names = docs.columns
    own = marks.select(key_hash(keys).alias(ID), F.col("text_hash").alias(TEXT), copies.cast("long").alias("copies"))
    groups = stash(own.groupBy(ID, TEXT).agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("total"), F.max("copies").alias("most"), F.min("copies").alias("least")), "decisions")
    other = groups.filter("most <> 1 or least <> 1")
    bits = other.select(place().alias("p")).groupBy(F.shiftright("p", 6).alias(MINE + "word")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias(BITS))
    bits = stash(bits, "bits")

    def marked(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn(MINE + "place", place()).withColumn(MINE + "word", F.shiftright(MINE + "place", 6))
        return rows.join(F.broadcast(bits), MINE + "word", "left")  # at most PLACES / 64 rows

    spared = marked(groups.filter("most = 1 and least = 1")).filter(bit_set())
    known = stash(spared.select(ID, TEXT, F.col("most").alias(TIMES)).union(other.filter("most = least and most > 0").select(ID, TEXT, "most")), "known")
    torn = stash(other.filter("most > least").select(ID, TEXT, F.col("n").alias(N), F.col("total").alias(TOTAL)), "torn")
    rows = marked(docs.withColumns({ID: key_hash(keys), TEXT: text_hash(text_col)}))
    few, more = known.count() <= SENT, not known.filter(F.col(TIMES) > 1).isEmpty()
    if few:  # one reading of the documents
        found = rows.join(F.broadcast(known), [ID, TEXT], "left").withColumn(TIMES, F.when(bit_set(), F.coalesce(TIMES, F.lit(0))).otherwise(1)).filter(F.col(TIMES) > 0)
    else:
        there = rows.filter(bit_set()).join(known, [ID, TEXT])
        found = rows.filter(~bit_set()).withColumn(TIMES, F.lit(1).cast("long")).select(*names, TIMES).unionByName(there.select(*names, TIMES))
    out = repeated(found, names) if more else found.select(*names)
    if torn.isEmpty():
        return out
    alike = stash(looked_up(rows.filter(bit_set()), torn, "inner").withColumn(MINE + "row", F.monotonically_increasing_id()), "alike")
    ranked = running_sum(alike.select(ID, TEXT, N, TOTAL, MINE + "row"), [ID, TEXT], [F.col(MINE + "row")], F.lit(1), MINE + "before")
    share = F.floor(F.col(TOTAL) / F.col(N))
    ranked = ranked.select(MINE + "row", (share + (F.col(MINE + "before") < F.col(TOTAL) - share * F.col(N)).cast("int")).alias(TIMES)).filter(F.col(TIMES) > 0)
    return out.unionByName(repeated(alike.join(ranked, MINE + "row"), names))


def keep_marked(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents that marks (id, text_hash, kept) keep, with all their columns."""
    return decided(docs, marks, F.col("kept").cast("int"), (id_col,), text_col)


def repeat_mixed(docs: DataFrame, mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents as often as a mix (doc_id, source, text_hash, copies) takes them."""
    return decided(docs, mixed, F.col("copies"), ("doc_id", "source"), text_col)
