"""Quality by hierarchical empirical Bayes.

A document classifier turns a text's statistics and its hashed words and pairs of words into a probability of good quality. Sites (a host, and a path under it)
have posterior rates from their documents' probabilities, or labels where there are any: a path is shrunk toward its
host and a host toward the global rate, the more the fewer documents it has and the less sites differ. A document's
evidence and its site's posterior, without the document itself, are combined as log odds."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import _text
from inkwell.llm._tables import small_batches, stash, text_hash
from inkwell.llm.stages import keep_marked

#: Labelled rows that the classifier is fitted on at most, chosen by a hash of their ids.
SAMPLE = 20_000
#: Site tables of at most so many rows are sent to every executor; larger ones are joined by shuffles.
SITES = 50_000
KEEP = 0.5
#: Statistics of a text, and the places that its words and pairs of words are hashed to (a power of 2).
STATISTICS, HASHED = 14, 64
FEATURES = STATISTICS + HASHED
#: Weights of the classifier: one alone, those of statistics and their squares, those of hashed words.
WEIGHTS = 1 + 2 * STATISTICS + HASHED
#: How much more the weights of hashed words are held back than others: they count where there are many labels.
HELD = 30.0

KINDS = np.full(256, 4, dtype=np.uint8)  # other marks
KINDS[[*range(65, 91)]] = 0
KINDS[[*range(97, 123), *range(128, 256)]] = 1
KINDS[[*range(48, 58)]] = 2
KINDS[[0x20, *range(0x09, 0x0E)]] = 3
KINDS[[ord(c) for c in ".,;:'\"!?()-"]] = 5  # marks of prose


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Numbers of each text (one row each): shares of kinds of bytes, repetition, lengths of words; then signed shares of
    its words and pairs of words by a part of their hash."""
    units, n = data[offsets[0] : offsets[-1]], len(offsets) - 1
    at = offsets - offsets[0]
    words, first = _text.words(data, offsets)
    out = np.zeros((n, FEATURES))
    kinds = KINDS[units]
    again = np.append(False, units[1:] == units[:-1]) if len(units) else np.zeros(0, bool)
    for i in range(n):
        k, w = kinds[at[i] : at[i + 1]], words[first[i] : first[i + 1]]
        size, m = max(len(k), 1), max(len(w), 1)
        shares = np.bincount(k, minlength=6)[:6] / size
        ranked = np.sort(w)
        new = ranked[1:] != ranked[:-1]
        runs = np.diff(np.flatnonzero(np.concatenate([[True], new, [True]]))) if len(w) else np.zeros(1)
        pairs = np.sort(_text.mix(w[1:] * _text.FACTOR + w[:-1])) if len(w) > 1 else w[:0]
        other = units[at[i] : at[i + 1]]
        out[i, :STATISTICS] = [
            *shares, np.log1p(len(w)), len(k) / m / 10, (new.sum() + 1) / m if len(w) else 0, runs.max() / m,
            ((pairs[1:] != pairs[:-1]).sum() + 1) / max(len(pairs), 1), np.count_nonzero(again[at[i] : at[i + 1]]) / size, np.count_nonzero(other == 124) / m, np.count_nonzero(other == 10) / m,
        ]
        grams = np.concatenate([ranked, pairs])
        sign = (grams & np.uint64(1)).astype(np.float64) * 2 - 1
        out[i, STATISTICS:] = np.bincount((grams >> np.uint64(1)).astype(np.int64) % HASHED, sign, HASHED) / m
    return out


@dataclass
class Classifier:
    """Logistic regression on standardised statistics, their squares, and hashed words."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        own = z[:, :STATISTICS]
        return np.hstack([np.ones((len(x), 1)), own, own * own - 1, z[:, STATISTICS:]])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.weights, -30, 30)))

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Classifier:
        """Newton's method. Without rows of both classes it gives every text the (smoothed) rate of the labels."""
        rate = (y.sum() + 1) / (len(y) + 2)
        if not 0 < y.sum() < len(y):
            one = cls(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(WEIGHTS))
            one.weights[0] = np.log(rate / (1 - rate))
            return one
        own = cls(x.mean(axis=0), x.std(axis=0) + 1e-6, np.zeros(WEIGHTS))
        a = own.design(x)
        penalty = np.full(a.shape[1], ridge)
        penalty[0] = 0
        penalty[1 + 2 * STATISTICS :] *= HELD
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a @ own.weights, -30, 30)))
            step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (y - p) - penalty * own.weights)
            own.weights += step
            if np.abs(step).max() < 1e-6:
                break
        return own


def over_texts(docs: DataFrame, text_col: str, name: str, kind: str, work) -> DataFrame:
    """Adds a column: work(bytes, offsets) for the texts."""
    names, where = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.buffers(batch.column(where))
            parts = [work(data, offsets[a : b + 1]) for a, b in _text.steps(offsets)]
            new = np.concatenate(parts) if parts else np.zeros(0)
            column = pa.array(new) if new.ndim == 1 else pa.FixedSizeListArray.from_arrays(pa.array(new.ravel()), FEATURES).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*names, name])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_text.tidy(run), f"{kept}, `{name}` {kind}")


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Classifier:
    """Fits the classifier on at most `sample` labelled ids and 2 * sample documents, the first by their hashes."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.avg(label_col).alias("_y"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), text_hash(text_col).alias("_hash")).join(F.broadcast(chosen.withColumnRenamed(id_col, "_id")), "_id")  # at most `sample` rows
    found = over_texts(rows, "_text", "_x", "array<double>", features).select(F.xxhash64("_id").alias("_order"), "_hash", "_y", "_x")
    with small_batches(docs.sparkSession):
        found = found.orderBy("_order", "_hash").limit(2 * sample).toArrow()  # repeated ids, too, have a bound and an order
    x = np.concatenate([np.zeros(0), *(c.flatten().to_numpy() for c in found.column("_x").chunks)]).reshape(-1, FEATURES)
    return Classifier.fit(x, (found.column("_y").to_numpy() >= 0.5).astype(float))


def with_probability(docs: DataFrame, model: Classifier, text_col: str, name: str = "_p") -> DataFrame:
    return over_texts(docs, text_col, name, "double", lambda data, offsets: model.probability(features(data, offsets)))


def with_value(scored: DataFrame, labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """Adds _y, what a document counts for in its sites' sums: its label, or its probability _p without one."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_label_id")).agg(F.avg(label_col).cast("double").alias("_label"))
    known = stash(known, "labels")  # so that the join can split the rows of one id among tasks
    return scored.join(known, scored["_id"] == known["_label_id"], "left").withColumn("_y", F.coalesce("_label", "_p")).drop("_label_id", "_label")


def strength(rows: DataFrame, parent: Column) -> float:
    """How many documents the prior of a level counts for, by moments of rows (n, s): the less sites differ from their
    parent's rate, the more. One row reaches the driver."""
    rate = F.col("s") / F.col("n")
    r = rows.select("n", rate.alias("r"), parent.alias("m")).agg(F.sum(F.col("n") * (F.col("r") - F.col("m")) ** 2), F.sum(F.col("m") * (1 - F.col("m"))), F.sum("n"), F.sum(F.col("n") * F.col("n")), F.avg(F.col("m") * (1 - F.col("m")))).first()
    if not r[2]:
        return 1.0
    spread = max(0.0, r[0] - r[1]) / max(r[2] - r[3] / r[2], 1.0)
    return float(np.clip(r[4] / spread - 1 if spread > 0 else 1e6, 1.0, 1e6))


@dataclass
class Sites:
    """Posterior inputs of each (host, path): n, s of both, the prior's rate and the strengths of the two levels."""

    table: DataFrame
    rate: float
    hosts: float
    paths: float


def sites(rows: DataFrame) -> Sites:
    """Grouped counts and rates over all documents (columns _host, _path, _y)."""
    paths = rows.groupBy("_host", "_path").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s"))
    paths = stash(paths, "paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n"), F.sum("s")).first()
    rate = float(np.clip((total[1] or 0.0) / total[0] if total[0] else 0.5, 0.001, 0.999))
    host_strength = strength(hosts, F.lit(rate))
    hosts = hosts.withColumnsRenamed({"_host": "_host2", "n": "host_n", "s": "host_s"})
    both = paths.join(hosts, F.col("_host").eqNullSafe(F.col("_host2"))).drop("_host2")
    both = stash(both, "sites")
    posterior = (F.col("host_s") + host_strength * rate) / (F.col("host_n") + host_strength)
    return Sites(both, rate, host_strength, strength(both, posterior))


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def judged(rows: DataFrame, known: Sites, keep: float = KEEP) -> DataFrame:
    """Adds host_posterior, path_posterior (both without the document's own value _y), posterior and kept."""
    table = known.table.withColumnsRenamed({"_host": "_host2", "_path": "_path2", "n": "_n", "s": "_s", "host_n": "_hn", "host_s": "_hs"})
    if known.table.count() <= SITES:
        table = F.broadcast(table)
    rows = rows.join(table, rows["_host"].eqNullSafe(table["_host2"]) & rows["_path"].eqNullSafe(table["_path2"]))
    # Sums of floating numbers may miss what was added by a rounding error.
    without = lambda s, n, prior, k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (s - F.col("_y") + prior * k) / (n - 1 + k)))
    rows = rows.withColumn("host_posterior", without(F.col("_hs"), F.col("_hn"), F.lit(known.rate), known.hosts))
    rows = rows.withColumn("path_posterior", without(F.col("_s"), F.col("_n"), F.col("host_posterior"), known.paths))
    odds = logit(F.col("_p")) + logit(F.col("path_posterior")) - logit(F.lit(known.rate))
    rows = rows.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return rows.withColumn("kept", F.col("posterior") >= keep).drop("_host2", "_path2", "_n", "_s", "_hn", "_hs")


def url_site(url: Column) -> tuple[Column, Column]:
    """Host (without www., in lower case) and first folder of the path of a URL; null where there is none."""
    host = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", "")
    folder = F.regexp_extract(F.try_parse_url(url, F.lit("PATH")), r"^(/[^/]+)/", 1)
    return host, F.when(folder != "", folder)


def assess(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, document_probability, host_posterior, path_posterior, posterior, kept, text_hash.

    host and path default to the columns source and lang, which stand for a site and its parts where there is no URL
    (url_site() gives both of one); null is a site of its own. Labels (id, 0 or 1; repeated ones
    are averaged, nulls ignored) may cover any part of the documents, or none: then all have the same rate. A null text
    counts as empty. Extra columns don't matter; an empty table gives no rows."""
    model = fit(docs, labels, label_col, id_col, text_col)
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), text_hash(text_col).alias("_hash"), host.alias("_host"), path.alias("_path"))
    scored = stash(with_probability(own, model, "_text").drop("_text"), "scored")
    valued = stash(with_value(scored, labels, label_col, id_col), "valued")
    out = judged(valued, sites(valued))
    return out.select(F.col("_id").alias(id_col), F.col("_p").alias("document_probability"), "host_posterior", "path_posterior", "posterior", "kept", F.col("_hash").alias("text_hash"))


def kept_documents(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that assess() keeps, with all their columns, whatever their names."""
    return keep_marked(docs, assess(docs, labels, label_col=label_col, id_col=id_col, text_col=text_col), id_col, text_col)


__all__ = ["Classifier", "assess", "features", "fit", "kept_documents", "url_site"]
