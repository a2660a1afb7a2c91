"""Target-distribution importance resampling: documents drawn in proportion to how much likelier they are in a target.

Features (runs of words) are hashed to buckets. A table of counts in the corpus and one in the target give each bucket a
gain, an array of fixed size that all tasks hold; a document's weight is the mean gain of its features. With Gumbel noise
added, the highest scores are a draw without replacement. The k-th highest is found by a distributed quickselect: exact counts
below, at and above random pivots narrow the range of keys, so that only what is drawn is ever sorted."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from inkwell.llm import _text
from inkwell.llm._tables import stash, with_position

#: Buckets of features, longest run of words, documents drawn of 100 that have at least so many words, and the noise's seed.
BUCKETS, RUN, PERCENT, LEAST_WORDS, SEED = 10_000, 1, 10, 20, "2024"
#: Random pivots of a round: each narrows the range of keys about so many times.
PIVOTS = 16


def features(data: np.ndarray, offsets: np.ndarray, run: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all features of rows, the row of each, and the words of rows."""
    units, starts, ends, at = _text.terms(data, offsets)
    n_words = np.diff(at)
    row = np.repeat(np.arange(len(n_words)), n_words)
    if run == 1:
        return _text.crc32s(units, starts, ends) % np.uint32(buckets), row, n_words
    # Words behind each other with one space between: a run of any length is one span.
    size = ends - starts + 1
    stop = np.cumsum(size)
    begin = stop - size
    joined = np.full(int(stop[-1]) if len(stop) else 0, 0x20, dtype=np.uint8)
    inside = np.ones(len(joined), dtype=bool)
    inside[stop - 1] = False
    joined[inside] = units[np.repeat(starts - (begin - np.arange(len(begin))), size - 1) + np.arange(int((size - 1).sum()))]
    found, owner = [], []
    for n in range(1, run + 1):
        first = np.flatnonzero(row[: len(row) - n + 1] == row[n - 1 :]) if len(row) >= n else np.zeros(0, dtype=np.int64)
        found.append(_text.crc32s(joined, begin[first], stop[first + n - 1] - 1) % np.uint32(buckets))
        owner.append(row[first])
    return np.concatenate(found), np.concatenate(owner), n_words


def bucket_counts(docs: DataFrame, text_col: str = "text", run: int = RUN, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all documents fall in each bucket. Tasks add up their own; the driver sees `buckets` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            data, offsets = _text.buffers(batch.column(0))
            for a, b in _text.steps(offsets):
                total += np.bincount(features(data, offsets[a : b + 1], run, buckets)[0], minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["bucket", "n"])

    found = docs.select(F.col(text_col).cast("string")).mapInArrow(_text.tidy(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in found.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares of the target and of the corpus, rounded down."""
    size, most, least = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(most + size) / (float(s + 1) * float(least + size)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, run: int) -> DataFrame:
    """id, n_words, n_features and weight of each document."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.buffers(batch.column(1))
            for a, b in _text.steps(offsets):
                bucket, row, n_words = features(data, offsets[a : b + 1], run, len(gain))
                n = np.bincount(row, minlength=b - a)
                total = np.zeros(b - a, dtype=np.int64)
                np.add.at(total, row, gain[bucket])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))], names=[id_col, "n_words", "n_features", "weight"])

    rows = docs.select(id_col, F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(_text.tidy(weigh), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(id_col: str, seed: str) -> Column:
    """Thousandths of Gumbel noise, rounded down, from the seed and the id alone (a null id is an empty text)."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def order(id_col: str) -> list[Column]:
    """Higher scores first, then lower ids (null last), then rows as they were written."""
    return [F.col("score").desc(), F.col(id_col).asc_nulls_last(), F.col("_row")]


def below(rows: DataFrame, id_col: str, key: Row) -> str:
    """Condition that a row comes before the one with this key (score, id, _row) in order(): as SQL, since a round has many."""
    if key[id_col] is None:
        same, before = f"`{id_col}` is null", f"`{id_col}` is not null"
    else:
        text = str(key[id_col]).replace("\\", "\\\\").replace("'", "\\'")
        own = f"cast('{text}' as {rows.schema[id_col].dataType.simpleString()})"
        same, before = f"`{id_col}` <=> {own}", f"coalesce(`{id_col}` < {own}, false)"
    return f"(score > {key['score']} or (score = {key['score']} and ({before} or ({same} and _row < {key['_row']}))))"


def is_at(key: Row) -> str:
    return f"(_row = {key['_row']})"


def kth(rows: DataFrame, id_col: str, k: int, seed: int = 0) -> Row | None:
    """The key (score, id, _row) of the k-th row (from 1) of a written table in order(); _row tells all rows apart. None if
    there is no such row.

    Each round draws pivots among the rows still in question (those of the least hashes), counts exactly how many rows are
    below, at and above each, and keeps the range between two. The driver sees the pivots and these counts alone."""
    left, turn = rows.select(id_col, "score", "_row"), 0
    while k > 0:
        pivots = left.orderBy(F.xxhash64(F.lit(seed + turn), "_row"), "_row").limit(PIVOTS).collect()
        pivots.sort(key=lambda r: (-r["score"], r[id_col] is None, r[id_col] if r[id_col] is not None else 0, r["_row"]))
        # Place 2i is between pivots i - 1 and i, place 2i + 1 at pivot i.
        place = " + ".join(["0", *(f"case when {below(rows, id_col, r)} then 0 when {is_at(r)} then 1 else 2 end" for r in pivots)])
        counts = dict(left.groupBy(F.expr(place).alias("place")).count().collect())
        at = 0
        while at < 2 * len(pivots) + 1 and k > counts.get(at, 0):
            k -= counts.get(at, 0)
            at += 1
        if at > 2 * len(pivots):
            return None
        if at % 2:
            return pivots[at // 2]
        # Plain bounds of the score reach the scan; the whole key decides among equal ones.
        if at:
            low = pivots[at // 2 - 1]
            left = left.filter(f"score <= {low['score']} and not {below(rows, id_col, low)} and not {is_at(low)}")
        if at < 2 * len(pivots):
            high = pivots[at // 2]
            left = left.filter(f"score >= {high['score']} and {below(rows, id_col, high)}")
        turn += 1
    return None


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, run: int = RUN, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """One row a document: id, n_features, weight, score, rank (all long): of the documents with at least least_words words,
    percent of 100 with the highest scores are drawn and ranked from 1, others have no rank.

    Null and empty texts have no features and weight 0. Equal scores go by the smaller id, null ids come last; rows alike in
    both are told apart by the order in which they were written, so repeated rows are drawn each. Empty tables give no rows
    (an empty target: gains of a uniform one). Texts of any length are taken whole; other columns don't matter. Ids are whole
    numbers, strings or dates."""
    gain = gains(bucket_counts(docs, text_col, run, buckets), bucket_counts(target, target_text, run, buckets))
    scored = weighed(docs, gain, id_col, text_col, run).withColumn("score", F.col("weight") + noise(id_col, seed))
    scored = stash(scored.withColumn("_row", F.monotonically_increasing_id()), "scores")
    fit = scored.filter(F.col("n_words") >= least_words)
    last = kth(fit, id_col, fit.count() * percent // 100) if percent > 0 else None
    names = [id_col, "n_features", "weight", "score"]
    if last is None:
        return scored.select(*names, F.lit(None).cast("long").alias("rank"))
    drawn = f"n_words >= {least_words} and score >= {last['score']} and ({below(scored, id_col, last)} or {is_at(last)})"
    ranked = with_position(scored.filter(drawn), order(id_col), "rank")
    return ranked.select(*names, (F.col("rank") + 1).alias("rank")).unionByName(scored.filter(f"not ({drawn})").select(*names, F.lit(None).cast("long").alias("rank")))


__all__ = ["bucket_counts", "features", "gains", "kth", "resample"]
