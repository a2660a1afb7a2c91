"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key divided by its quality weight; sorting by the key is weighted sampling without
replacement. A source whose target is k whole sizes and a rest is taken k times in full, and for the rest its documents
in order of their keys until the prefix sum of sizes meets the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm._tables import running_sum, stash, text_hash, with_position
from inkwell.llm.stages import ID, MINE, TEXT, TIMES, agreed, key_hash, repeat_mixed, repeated

SEED = 20_240_607
#: Weights of sources in turn, and how many times its size a source's target may be.
WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
#: Sources whose numbers are sent to all tasks, at most.
SOURCES = 100_000
#: Keys that differ by a smaller share count as equal when they are computed again.
ROUNDING = 1e-9
#: How sharply quality weights tell prose from junk: at 4 the median good text of sf0.01 weighs 7 times the median bad one.
SHARP = 4


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def text_quality(text: str) -> Column:
    """A weight in (0, 1] from the text alone: the share of lower-case (or caseless) letters, marks on them and white
    space, times ln(distinct words) / ln(words), which hardly depends on a text's length; to the power SHARP."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    plain = F.length(F.regexp_replace(value, r"[^\p{Ll}\p{Lo}\p{M}\s]+", "")) / F.greatest(F.length(value), F.lit(1))
    words = F.split(F.lower(value), r"[\x20\x09-\x0D]+")
    variety = F.log(F.size(F.array_distinct(words)) + F.lit(1.0)) / F.log(F.size(words) + F.lit(1.0))
    return F.greatest(F.pow(plain * variety, F.lit(float(SHARP))), F.lit(1e-6))


def uniform(*values: Column, seed: int = SEED) -> Column:
    """In (0, 1), from the values alone: reruns agree."""
    bits = F.call_function("shiftrightunsigned", F.xxhash64(F.lit(seed), *values), F.lit(11))
    return (bits + F.lit(0.5)) / F.lit(float(1 << 53))


def fill_targets(sources: DataFrame, most: float) -> DataFrame:
    """Adds target double to rows (key, size, weight): shares of the total size by weight, none above most times its size.

    What sources can't take is shared by weight among the others until none is above. So every target is the lesser of
    its cap and level * weight; each round finds the level from two sums over the sources, and as capped ones stay
    capped, few rounds suffice."""
    cap = F.col("size") * F.lit(float(most))
    total, weights = sources.agg(F.sum("size"), F.sum("weight")).first()
    level, capped = (total or 0) / weights if weights else 0.0, 0
    while True:
        above = cap < F.lit(level) * F.col("weight")
        spent, free, n = sources.agg(F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)).first()
        if n == capped or not free:
            break
        level, capped = (total - spent) / free, n
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def draw_key(text: str, quality: Column | None, seed: int) -> Column:
    """The exponential key of a document (columns doc_id and text): -ln(u) divided by its quality weight.

    A null or NaN weight counts as 1e-9, as do zero and negative ones: such documents come last."""
    weight = (quality if quality is not None else text_quality(text)).cast("double")
    weight = F.when(F.isnan(weight), F.lit(None)).otherwise(weight)
    return -F.log(uniform(F.col("doc_id"), text_hash(text), seed=seed)) / F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(1e-9))


def draws(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, quality: Column | None = None, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, source, size, text_hash, key, source_size, target, epochs, once (taken for the rest)."""
    rows = docs.select("doc_id", "source", word_count("text").alias("size"), text_hash("text").alias("text_hash"), draw_key("text", quality, seed).alias("key"))
    rows = stash(rows.withColumn("_row", F.monotonically_increasing_id()), "keys")
    sources = rows.groupBy(F.col("source").alias("key")).agg(F.sum("size").alias("size"))
    ranked = with_position(sources, [F.col("key").asc_nulls_last()], "turn")
    sources = ranked.withColumn("weight", F.get(F.lit([float(w) for w in weights]), (F.col("turn") % len(weights)).cast("int"))).drop("turn")
    targets = stash(fill_targets(sources, most), "targets").select(F.col("key").alias("_source"), F.col("size").alias("source_size"), "target")
    run = running_sum(rows, ["source"], [F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("text_hash"), F.col("_row")], F.col("size"), "_before")
    run = run.join(F.broadcast(targets) if targets.count() <= SOURCES else targets, F.col("source").eqNullSafe(F.col("_source")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    once = (F.col("size") > 0) & (F.col("_before") + F.col("size") / 2 <= rest)
    return run.select("doc_id", "source", "size", "text_hash", "key", "source_size", "target", epochs.alias("epochs"), once.alias("once"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, quality: Column | None = None, seed: int = SEED) -> DataFrame:
    """One row a document: doc_id, source, size (words), text_hash, source_size, target (of its source), copies, taken.

    Sources in order of code points (null last) get the weights in turn and share the total size of all documents;
    targets stop at `most` times a source's size. quality: a positive weight of each document (text_quality if None); the
    greater, the earlier a document is drawn. A document is taken in full as often as its source's target holds the source's
    size, and once more if the prefix sum at its middle lies within the rest: a source's taken words differ from its
    target by at most half the last document drawn. Null text: size 0, as the empty one. Documents of size 0 are taken
    as often as whole epochs say. Repeated rows draw the same key and are ordered among themselves. An empty table gives
    no rows; other columns don't matter."""
    copies = F.col("epochs") + F.col("once").cast("long")
    return draws(docs, weights, most, quality, seed).select("doc_id", "source", "size", "text_hash", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, quality: Column | None = None, seed: int = SEED) -> DataFrame:
    """The documents as often as mix() takes them, with all their columns.

    In a source, the documents drawn for the rest are those up to a key. Each source's epochs and last key are sent to all
    tasks, which compute the keys again: no text moves. Documents whose keys lie within rounding of the last one are looked
    up by id, source and text; so are all documents if sources are too many to be sent."""
    found = stash(draws(docs, weights, most, quality, seed), "draws")
    marks = found.withColumn("copies", F.col("epochs") + F.col("once").cast("long"))
    ends = found.groupBy(F.xxhash64("source", F.isnull("source")).alias(MINE + "source")).agg(F.first("epochs").alias(MINE + "epochs"), F.max(F.when(F.col("once"), F.col("key"))).alias(MINE + "end"))
    ends = stash(ends, "ends")
    if ends.count() > SOURCES:
        return repeat_mixed(docs, marks)
    key, end = F.col(MINE + "key"), F.col(MINE + "end")
    close = lambda k, times: F.coalesce(F.abs(k - end) <= times * ROUNDING * end, F.lit(False))
    near = marks.withColumn(MINE + "source", F.xxhash64("source", F.isnull("source"))).join(F.broadcast(ends), MINE + "source").filter(close(F.col("key"), 2))
    near = stash(near.select("doc_id", "source", "text_hash", "copies"), "near")
    sure = stash(agreed(near, F.col("copies"), ("doc_id", "source")), "sure")
    rows = docs.withColumns({MINE + "source": F.xxhash64("source", F.isnull("source")), MINE + "key": draw_key("text", quality, seed)})
    rows = rows.join(F.broadcast(ends), MINE + "source")  # two numbers a source
    once = (word_count("text") > 0) & F.coalesce(key < end, F.lit(False))
    if sure.count() == near.count() <= SOURCES:  # as a rule one row a source
        rows = rows.withColumns({ID: key_hash(("doc_id", "source")), TEXT: text_hash("text")}).join(F.broadcast(sure), [ID, TEXT], "left")
        copies = F.when(close(key, 1), F.coalesce(TIMES, F.lit(0))).otherwise(F.col(MINE + "epochs") + once.cast("long"))
        return repeated(rows.withColumn(TIMES, copies).filter(F.col(TIMES) > 0), docs.columns)
    clear = rows.filter(~close(key, 1)).withColumn(TIMES, F.col(MINE + "epochs") + once.cast("long")).filter(F.col(TIMES) > 0)
    return repeated(clear, docs.columns).unionByName(repeat_mixed(rows.filter(close(key, 1)).select(*docs.columns), near))
