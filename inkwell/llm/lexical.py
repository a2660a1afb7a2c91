"""Ranked lexical search by per-term geometric blocking: exact top lists of all documents for a set of items.

Documents are vectors of the items' terms. Random hyperplanes give each a code; in the order of codes similar vectors stand
together, and ranges of that order are segments of the index. In a segment each term's posting list keeps the order and is
cut into blocks; a block's summary is the coordinatewise maximum of its documents' vectors, rounded up to a byte.

An item goes through the lists of its terms, the heaviest first. A document that is first met in a list has none of the
heavier terms, so a block's summary has the coordinates of its list's term and of lighter ones alone. A block is skipped only
if this exact bound is below the worst score of the ten best so far; all documents of other blocks are scored. A short
list's blocks are single documents, whose bound is their score."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm import _text
from inkwell.llm._tables import partitions, small_batches, stash, with_position

#: Documents of a segment, and cells of its table of documents and terms, at most.
SEGMENT, CELLS = 4096, 1 << 24
#: Documents of a list up to which its blocks are single documents; of other blocks at least, and such blocks of a list at most.
SINGLE, BLOCK, BLOCKS = 24, 64, 16
#: Random hyperplanes of a code. Distinct terms and terms (with items) of the items that are searched for at once.
PLANES, TERMS, QUERIES = 24, 8192, 1 << 20
#: A vector's values are below 10**6: shifted by so many bits (rounded up) they fit a byte.
SHIFT = 12


def saturation(tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What tf occurrences in a document of n terms are worth, before the term's weight: below 10**6."""
    m = 100 - 75 + (75 * n.astype(np.int64) * documents) // words
    return (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + 8 * m)


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def item_terms(items: DataFrame) -> DataFrame:
    """item, term (bytes), times of items (item, text)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, starts, ends, at = _text.terms(*_text.buffers(batch.column(1)))
            raw = units.tobytes()
            item = np.repeat(batch.column(0).to_numpy(), np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())], names=["item", "term"])

    return items.select("item", "text").mapInArrow(split, "item long, term binary").groupBy("item", "term").agg(F.count(F.lit(1)).alias("times"))


class Vocabulary:
    """Terms by number; found among spans of bytes by a 64-bit hash and the length."""

    def __init__(self, terms: list[bytes]):
        ends = np.cumsum([len(t) for t in terms], dtype=np.int64)
        starts = ends - np.array([len(t) for t in terms], dtype=np.int64)
        key = _text.hashes(np.frombuffer(b"".join(terms), dtype=np.uint8), starts, ends)
        order = np.argsort(key)
        self.key, self.size, self.number = key[order], (ends - starts)[order], order.astype(np.int64)

    def vectors(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of each row; and rows, numbers and occurrences of the vocabulary's terms in them, in order."""
        units, starts, ends, at = _text.terms(data, offsets)
        n = np.diff(at)
        row = np.repeat(np.arange(len(n)), n)
        key = _text.hashes(units, starts, ends)
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        known = np.flatnonzero((self.key[place] == key) & (self.size[place] == ends - starts))
        pair, times = np.unique(row[known] * len(self.key) + self.number[place[known]], return_counts=True)
        return n, pair // len(self.key), pair % len(self.key), times


def term_vectors(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """id, n (terms with repeats), terms and times (binary, 32-bit) of each document, written; _row tells rows apart."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms)
        for batch in batches:
            data, offsets = _text.buffers(batch.column(1))
            for a, b in _text.steps(offsets):
                n, row, number, times = vocabulary.vectors(data, offsets[a : b + 1])
                cut = pa.array((4 * np.searchsorted(row, np.arange(b - a + 1))).astype(np.int32))
                both = [pa.Array.from_buffers(pa.binary(), b - a, [None, cut.buffers()[1], pa.py_buffer(x.astype("<i4").tobytes())]) for x in (number, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), *both], names=["id", "n", "terms", "times"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_text.tidy(find), f"id {rows.schema['id'].dataType.simpleString()}, n long, terms binary, times binary")
    return stash(found.withColumn("_row", F.monotonically_increasing_id()), "vectors")


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """32-bit numbers of a binary column one after another, and where each row's begin."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 4
    values = np.frombuffer(data, dtype="<i4") if data is not None and data.size else np.zeros(0, dtype="<i4")
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def holding(vectors: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term. Tasks add up their own; the driver sees one number a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            total += np.bincount(numbers(batch.column(0))[0], minlength=terms)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total), pa.int32()), pa.array(total[total > 0])], names=["term", "n"])

    out = np.zeros(terms, dtype=np.int64)
    for term, n in vectors.select("terms").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def coded(vectors: DataFrame, weight: np.ndarray, rank: np.ndarray, documents: int, words: int) -> DataFrame:
    """id, code, terms, values (binary, 32-bit) of documents that hold a term: bits of the code are the sides of random
    hyperplanes on which the weighted vector lies. Terms are numbered anew by rank; weight is by the new numbers."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = _text.mix(np.arange(1, len(weight) + 1, dtype=np.uint64) * np.uint64(_text.BASE))
        sides = np.where((bits[:, None] >> np.arange(PLANES, dtype=np.uint64)) & np.uint64(1), 1.0, -1.0).astype(np.float32)
        for batch in batches:
            term, at = numbers(batch.column(2))
            term = rank[term]
            times, _ = numbers(batch.column(3))
            n = batch.column(1).to_numpy()
            value = saturation(times, np.repeat(n, np.diff(at)), documents, words)
            power = (value * weight[term]).astype(np.float32)
            key = np.zeros(len(n), dtype=np.int64)
            if len(term):
                for plane in range(PLANES):
                    key = key << 1 | (np.add.reduceat(power * sides[term, plane], at[:-1]) > 0)
            raw = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(value.astype("<i4").tobytes())])
            name = pa.Array.from_buffers(pa.binary(), len(n), [None, raw.buffers()[1], pa.py_buffer(term.astype("<i4").tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key), batch.column(4), name, raw], names=["id", "code", "_row", "terms", "values"])

    rows = vectors.filter("length(terms) > 0").select("id", "n", "terms", "times", "_row")
    return rows.mapInArrow(code, f"id {vectors.schema['id'].dataType.simpleString()}, code long, _row long, terms binary, values binary")


FIELDS = ("starts", "terms", "values", "lists", "postings", "blocks", "cuts", "rows", "coordinates", "maxima")


def stored(field: str, width: int) -> str:
    """How a field's numbers are stored: a segment has at most 2**16 documents, an index mostly as few terms."""
    return "u1" if field == "maxima" else "<u2" if field == "postings" or field in ("terms", "coordinates") and width <= 1 << 16 else "<i4"


def upper(values: np.ndarray) -> np.ndarray:
    return (values + (1 << SHIFT) - 1) >> SHIFT


def segment(ids: pa.Array, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, width: int) -> pa.RecordBatch:
    """One row of the index: documents, the posting lists of terms, their blocks, and the blocks' summaries.

    lists: where each term's postings begin; blocks: its blocks, none for a list of single documents; cuts: the bounds of
    blocks among postings, two a block; rows, coordinates, maxima: summaries, block by block."""
    n = len(ids)
    owner = np.repeat(np.arange(n), np.diff(starts))
    table = np.zeros((n, width), dtype=np.uint8)
    table[owner, terms] = upper(values)
    order = np.argsort(terms, kind="stable")
    posting, length = owner[order], np.bincount(terms, minlength=width)
    lists = np.append(0, np.cumsum(length))
    # Blocks of nearly equal size, documents in the order of codes.
    many = np.where(length > SINGLE, np.minimum(-(-length // BLOCK), BLOCKS), 0)
    blocks = np.append(0, np.cumsum(many))
    of = np.repeat(np.arange(width), many)
    turn = np.arange(len(of)) - blocks[of]
    cuts = np.stack([lists[of] + turn * length[of] // many[of], lists[of] + (turn + 1) * length[of] // many[of]], axis=1)
    coordinates, maxima = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint8)]
    for term, (a, b) in zip(of.tolist(), cuts.tolist(), strict=True):
        most = table[posting[a:b], term:].max(axis=0)
        used = np.flatnonzero(most)
        coordinates.append(used + term)
        maxima.append(most[used])
    rows = np.cumsum([0, *map(len, coordinates[1:])])
    found = {"starts": starts, "terms": terms, "values": values, "lists": lists, "postings": posting, "blocks": blocks, "cuts": cuts.ravel(), "rows": rows, "coordinates": np.concatenate(coordinates), "maxima": np.concatenate(maxima)}
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids), *(pa.array([found[k].astype(stored(k, width)).tobytes()], pa.binary()) for k in FIELDS)], names=["ids", *FIELDS])


def build_index(rows: DataFrame, width: int) -> DataFrame:
    """Segments of the index of coded documents, in ranges of their codes. Rows of one code are told apart by their places."""
    kind = rows.schema["id"].dataType.simpleString()
    most = max(64, min(SEGMENT, CELLS // max(width, 1)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(batches).combine_chunks()
            ids, *rest = (c.chunk(0) for c in whole.columns)
            (terms, at), (values, _) = map(numbers, rest)
            return segment(ids, at, terms, values, width)

        for batch in batches:
            while len(batch):
                room = most - sum(map(len, held))
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(map(len, held)) == most:
                    yield close(held)
                    held = []
        if held:
            yield close(held)

    dealt = rows.repartitionByRange(partitions(rows.sparkSession), "code", "_row").sortWithinPartitions("code", "_row").select("id", "terms", "values")
    return dealt.mapInArrow(_text.tidy(build), f"ids array<{kind}>, " + ", ".join(f"{k} binary" for k in FIELDS))


def ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0] .. last[0] - 1, first[1] .. and so on."""
    n = last - first
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Segment:
    def __init__(self, fields: dict[str, np.ndarray], width: int):
        self.__dict__.update({k: v.astype(np.int64) if k in ("starts", "lists", "blocks", "cuts") else v for k, v in fields.items()})
        self.cuts = self.cuts.reshape(-1, 2)
        self.summary = np.zeros((len(self.cuts), width), dtype=np.uint8)
        self.summary[np.repeat(np.arange(len(self.cuts)), np.diff(self.rows)), self.coordinates] = self.maxima

    def scores(self, docs: np.ndarray, power: np.ndarray) -> np.ndarray:
        first, last = self.starts[docs], self.starts[docs + 1]
        pick = ranges(first, last)
        return np.add.reduceat(power[self.terms[pick]] * self.values[pick], np.cumsum(last - first) - (last - first))

    def best(self, terms: np.ndarray, weights: np.ndarray, power: np.ndarray, least: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents with a score of at least `least` and above 0 that may be among the best `count`, and their scores.

        terms: an item's, in order of their numbers, which is from the heaviest on; weights: theirs with repeats; power: the
        same by term number."""
        done = np.zeros(len(self.starts) - 1, dtype=bool)
        docs, scores = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]

        def score(postings: np.ndarray) -> None:
            nonlocal least
            own = np.zeros(len(done), dtype=bool)
            own[postings] = True
            own = np.flatnonzero(own & ~done)
            if not len(own):
                return
            done[own] = True
            docs.append(own)
            scores.append(self.scores(own, power))
            known = np.concatenate(scores)
            if len(known) >= count:
                least = max(least, int(np.partition(known, len(known) - count)[len(known) - count]))

        n = self.blocks[terms + 1] - self.blocks[terms]
        alone = terms[n == 0]
        score(self.postings[ranges(self.lists[alone], self.lists[alone + 1])])
        block = ranges(self.blocks[terms], self.blocks[terms + 1])
        # A summary has no coordinates of terms heavier than its list's.
        bound = self.summary[block[:, None], terms[None, :]].astype(np.int64) @ (weights << SHIFT)
        order = np.argsort(-bound, kind="stable")
        block, bound = block[order], bound[order]
        a, step = 0, 4
        while a < len(block) and bound[a] >= max(least, 1):
            b = min(int(np.searchsorted(-bound, -max(least, 1), side="right")), a + step)
            score(self.postings[ranges(self.cuts[block[a:b], 0], self.cuts[block[a:b], 1])])
            a, step = b, 2 * step
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        fit = scores >= max(least, 1)
        return docs[fit], scores[fit]


def search_index(index: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], width: int, count: int) -> DataFrame:
    """item, id, score: the best of what each task has read of the index.

    queries: item number, numbers of its terms and their weights with repeats."""
    kind = index.schema["ids"].dataType.elementType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[list] = [[] for _ in queries]
        ordered = []
        for _, terms, weights in queries:
            heavy = np.argsort(terms)
            ordered.append((terms[heavy], weights[heavy]))
        power = np.zeros(width, dtype=np.int64)
        id_type = None
        for batch in batches:
            for i in range(len(batch)):
                ids = batch.column(0)[i].values
                id_type = ids.type
                place = np.empty(len(ids), dtype=np.int64)
                place[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
                own = Segment({k: np.frombuffer(batch.column(1 + j)[i].as_buffer(), dtype=stored(k, width)) for j, k in enumerate(FIELDS)}, width)
                for q, (terms, weights) in enumerate(ordered):
                    power[terms] = weights
                    docs, scores = own.best(terms, weights, power, -top[q][-1][0] if len(top[q]) == count else 0, count)
                    power[terms] = 0
                    if len(docs):
                        keep = np.lexsort((place[docs], -scores))[:count]
                        names = ids.take(pa.array(docs[keep])).to_pylist()
                        top[q] = sorted([*top[q], *((-s, x is None, x) for s, x in zip(scores[keep].tolist(), names, strict=True))], key=lambda r: (r[0], r[1], r[2] if r[2] is not None else 0))[:count]
        found = [(queries[q][0], r[2], -r[0]) for q in range(len(queries)) for r in top[q]]
        if found:
            item, doc, score = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, id_type), pa.array(score, pa.int64())], names=["item", "id", "score"])

    return index.mapInArrow(_text.tidy(search), f"item long, id {kind}, score long")


def write_index(docs: DataFrame, terms: list[bytes], id_col: str, text_col: str) -> tuple[DataFrame, dict[bytes, int], np.ndarray]:
    """The index of documents for terms, written; the terms' numbers in it, from the heaviest on, and their weights."""
    vectors = term_vectors(docs, terms, id_col, text_col)
    documents, words = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    weight = np.array([term_weight(documents, n) for n in holding(vectors, len(terms)).tolist()], dtype=np.int64)
    heavy = np.argsort(-weight, kind="stable")
    rank = np.empty(len(terms), dtype=np.int64)
    rank[heavy] = np.arange(len(terms))
    index = build_index(coded(vectors, weight[heavy], rank, documents, words), len(terms))
    # A segment is some MB: row groups are small, so that few are held at once.
    return stash(index, "index", options={"parquet.block.size": 8 << 20}), dict(zip(terms, rank.tolist(), strict=True)), weight[heavy]


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", count: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score (long) of each item's `count` best documents with a score above 0.

    Equal scores go by the lesser document id, null last; documents of one id are ranked each. Items of one id are searched
    for each; null and empty items, and those without a known term, have no rows. Null and empty texts have no terms; texts of any
    length are taken whole. Empty tables give no rows; other columns don't matter.

    Items are searched for in groups with few enough terms to be sent to all tasks, each with an index of its own; rows of a
    result that reach one task are at most `count` a task of the search before."""
    spark = docs.sparkSession
    numbered = with_position(items.select(F.col(item_col).alias("name"), F.col(item_text).cast("string").alias("text")), [F.col("name").asc_nulls_last(), F.xxhash64("text")], "item")
    known = stash(item_terms(numbered), "terms")
    groups, total = 1, numbered.count()
    part = lambda: F.pmod(F.xxhash64("item"), F.lit(groups))
    while groups < total:
        most = known.groupBy(part().alias("g")).agg(F.count_distinct("term").alias("terms"), F.count(F.lit(1)).alias("n")).agg(F.max("terms"), F.max("n")).first()
        if (most[0] or 0) <= TERMS and (most[1] or 0) <= QUERIES:
            break
        groups *= 2
    found = []
    for group in range(groups):
        own = known.filter(part() == group).collect()
        if not own:
            continue
        terms = sorted({bytes(r["term"]) for r in own})
        index, number, weight = write_index(docs, terms, id_col, text_col)
        queries: dict[int, dict[int, int]] = {}
        for r in own:
            queries.setdefault(r["item"], {})[number[bytes(r["term"])]] = r["times"]
        listed = [(item, np.array(list(q), dtype=np.int64), np.array([n * int(weight[t]) for t, n in q.items()], dtype=np.int64)) for item, q in sorted(queries.items())]
        with small_batches(spark):
            found.append(stash(search_index(index, listed, len(terms), count), "best"))
    names = (numbered.schema["name"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString())
    if not found:
        return spark.createDataFrame([], f"`{item_col}` {names[0]}, rank int, `{id_col}` {names[1]}, score long")
    best = found[0]
    for more in found[1:]:
        best = best.unionByName(more)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    ranked = best.withColumn("rank", rank).filter(F.col("rank") <= count)
    return ranked.join(numbered.select("item", "name"), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")


__all__ = ["search"]
