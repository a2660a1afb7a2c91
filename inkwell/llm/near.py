"""Near-duplicate classes by ProbMinHash, banding and verification.

A document is its set of five-word shingles, each weighted by 1 + ln(occurrences) / 8. ProbMinHash signatures agree in a
register with the probability Jaccard similarity of two documents; documents whose signatures agree in a whole band
are candidates. As repetition moves weighted similarity away from that of the sets, a document with repeated shingles
also has a signature and bands of its plain set (weights 1); without repeats the two are the same, so any two documents
can meet by their sets. A candidate counts as a link only if the exact Jaccard similarity of the shingle sets reaches the
threshold. Classes are the connected components of the links.

Groups are never expanded into all pairs: equal texts are one node; in each bucket nodes are verified against the
bucket's first node; then only nodes that are not yet in one component with it are verified against the others there.
A pair of one component needs no check, so no link between classes is lost, whatever a bucket's size. A pair is made
only if a few bits of each register of the plain sets' signatures let the registers' agreement be near the threshold (limits lie 4.5 deviations beyond
what is expected there). Sets of shingles are made in a second reading, of documents that share a bucket."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm import _registers, _text
from inkwell.llm._tables import stash, text_hash

WORDS, THRESHOLD = 5, 0.8
#: Divides the logarithm of a shingle's occurrences in its weight: near 1, weights keep the probability Jaccard similarity
#: near that of the sets, which decides.
DAMPED = 8
#: Registers (a power of 2) and those in a band. At similarity 0.8 a pair shares none of 64 bands with probability 8e-6.
REGISTERS, ROWS = 512, 8
#: Places in the bitmap that tells the second reading which documents are needed; the others that pass cost time only.
PLACES = 1 << 26
#: Multipliers of a shingle's words and of a band's registers, odd numbers made from this rule.
FACTORS = _text.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Hashes of the runs of `size` words of one document, or of all its words if there are fewer (none of none)."""
    n = max(len(words) - size + 1, min(len(words), 1))
    total = np.zeros(n, dtype=np.uint64)
    for k in range(min(size, len(words))):
        total += words[k : k + n] * FACTORS[k]
    return _text.mix(total)


def prob_minhash(elements: np.ndarray, weights: np.ndarray, starts: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Signatures (one row a document): in each register, the element that arrives first."""
    docs = len(starts) - 1
    out = np.zeros((docs, registers), dtype=np.uint64)
    weight = np.add.reduceat(np.append(weights, 0.0), starts[:-1]) * (np.diff(starts) > 0)

    def fill(rows: np.ndarray, until: np.ndarray) -> np.ndarray:
        at, owner = _registers.pick(starts, rows)
        found, register, time = _registers.arrivals(elements[at], weights[at], owner, until[rows], registers)
        key = owner[found] * registers + register
        least = np.full(len(rows) * registers, np.inf)
        np.minimum.at(least, key, time)
        first = time == least[key]
        own = np.zeros(len(rows) * registers, dtype=np.uint64)
        own[key[first]] = elements[at][found[first]]
        out[rows] = own.reshape(len(rows), registers)
        return np.isfinite(least).reshape(len(rows), registers).all(axis=1) | (weight[rows] == 0)

    each = np.log(registers) + 2
    _registers.settle(docs, registers / np.maximum(weight, 1e-9) * each, registers * each, fill)
    return out


def bands(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    docs, registers = signatures.shape
    parts = signatures.reshape(docs, registers // rows, rows) * FACTORS[:rows]
    return _text.mix(parts.sum(axis=2, dtype=np.uint64) + np.arange(registers // rows, dtype=np.uint64) * FACTORS[60]).view(np.int64)


def most_differing(threshold: float, registers: int, bits: int) -> int:
    """Registers in which so many bits may differ, at most, 4.5 deviations beyond what is expected at the threshold."""
    p = (1 - threshold) * (1 - 0.5**bits)
    return int(registers * p + 4.5 * (registers * p * (1 - p)) ** 0.5) + 1


def name(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, id, text_hash, whole (hash of the words in order), size (of the set of shingles), bits (one a register),
    nibbles (four bits a register), bands. bits and nibbles are of the plain set's signature, bands of both signatures."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _text.buffers(batch.column(2))
            for a, b in _text.steps(offsets):
                words, at = _text.words(data, offsets[a : b + 1])
                whole, place, sets, counts = [], {}, [], []
                for i in range(b - a):
                    own = words[at[i] : at[i + 1]]
                    key = name(own)
                    if key not in place:  # equal texts are worked on once
                        place[key] = len(sets)
                        x, n = np.unique(shingles(own), return_counts=True)
                        sets.append(x)
                        counts.append(n)
                    whole.append(key)
                starts = np.cumsum([0, *map(len, sets)])
                elements, n = np.concatenate(sets), np.concatenate(counts)
                signatures = prob_minhash(elements, 1.0 + np.log(n) / DAMPED, starts)
                pick = np.array([place[k] for k in whole])
                size = np.diff(starts)[pick]
                plain = signatures.copy()
                torn = [k for k, x in enumerate(counts) if len(x) and x.max() > 1]
                if torn:
                    own = [sets[k] for k in torn]
                    plain[torn] = prob_minhash(np.concatenate(own), np.ones(sum(map(len, own))), np.cumsum([0, *map(len, own)]))
                marks = bands(signatures).tolist()
                for k, more in zip(torn, bands(plain[torn]).tolist(), strict=True):
                    marks[k] = list(dict.fromkeys([*marks[k], *more]))
                marks = [marks[k] for k in pick]
                mixed = _text.mix(plain)
                bits = np.packbits((mixed & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)[pick]
                upper = (mixed >> np.uint64(60)).astype(np.uint8)
                nibbles = np.ascontiguousarray(upper[:, 0::2] << 4 | upper[:, 1::2]).view(np.int64)[pick]
                lists = lambda x, some: pa.array([r if k else [] for r, k in zip(x, some, strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in (0, 1, 3)), pa.array(whole, pa.binary()), pa.array(size, pa.int64()), lists(bits.tolist(), size >= 0), lists(nibbles.tolist(), size >= 0), lists(marks, size > 0)],
                    names=["row", "id", "text_hash", "whole", "size", "bits", "nibbles", "bands"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string"), text_hash(text_col))
    return rows.mapInArrow(_text.tidy(sketch), f"row long, id {kind}, text_hash long, whole binary, size long, bits array<long>, nibbles array<long>, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """row, shingles (as 32 bits) of the nodes in wanted (row, whole).

    A bitmap of fixed size tells tasks which texts to look at; what passes by chance is left out by the join."""
    place = F.conv(F.hex(F.substring("whole", 1, 4)), 16, 10).cast("long").bitwiseAND(F.lit(PLACES - 1))
    marks = wanted.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("bits")).toArrow()
    bitmap = np.zeros(PLACES // 64, dtype=np.uint64)
    bitmap[marks.column("w").to_numpy()] = marks.column("bits").to_numpy().view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            data, offsets = _text.buffers(batch.column(0))
            for a, b in _text.steps(offsets):
                words, at = _text.words(data, offsets[a : b + 1])
                found = {}
                for i in range(b - a):
                    key = name(words[at[i] : at[i + 1]])
                    p = int.from_bytes(key[:4], "big") & (PLACES - 1)
                    if key not in found and (int(own[p >> 6]) >> (p & 63)) & 1:
                        found[key] = np.unique(shingles(words[at[i] : at[i + 1]]).astype(np.uint32)).view(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.list_(pa.int32()))], names=["whole", "shingles"])

    found = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).mapInArrow(_text.tidy(build), "whole binary, shingles array<int>")
    return found.groupBy("whole").agg(F.first("shingles").alias("shingles")).join(wanted, "whole").select("row", "shingles")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (a, b) whose sets have a Jaccard similarity of at least the threshold."""
    one, two = (sets.select(F.col("row").alias(c), F.col("shingles").alias(f"_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    return both.filter(shared >= F.lit(threshold) * (F.size("_a") + F.size("_b") - shared)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, label (the least node of its connected component) for each node of links (a, b).

    Stars are merged until nothing moves: every node points to the least node among its neighbours, then its larger
    neighbours do. The number of rounds grows with the logarithm of a component's width."""
    edges = stash(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = stash(large.distinct(), "large")
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        edges = stash(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def plausible(x: str, y: str, threshold: float) -> Column:
    """Sizes and signatures (columns size, bits and nibbles of two sides) that don't rule the threshold out."""
    sizes = F.least(f"{x}.size", f"{y}.size") >= F.lit(threshold) * F.greatest(f"{x}.size", f"{y}.size")
    one = [F.bit_count(F.get(f"{x}.bits", F.lit(k)).bitwiseXOR(F.get(f"{y}.bits", F.lit(k)))) for k in range(REGISTERS // 64)]

    def differing(total: Column, v: Column) -> Column:
        v = v.bitwiseOR(F.shiftrightunsigned(v, 2))
        return total + F.bit_count(v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseAND(F.lit(0x1111111111111111)))

    four = F.aggregate(F.zip_with(f"{x}.nibbles", f"{y}.nibbles", lambda p, q: p.bitwiseXOR(q)), F.lit(0), differing)
    return sizes & (sum(one[1:], one[0]) <= most_differing(threshold, REGISTERS, 1)) & (four <= most_differing(threshold, REGISTERS, 4))


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, class_id (the least id of its class), class_size, kept (exactly one row a class), text_hash.

    Documents are alike if the Jaccard similarity of their five-word shingles (words lower-cased in A-Z) is at least the
    threshold, or if their words are the same; fewer than five words are one shingle. Null, empty and blank texts have
    no words and form one class. The row with the least id stays (null last). Extra columns don't matter; an empty
    table gives no rows."""
    rows = stash(sketches(docs, id_col, text_col), "sketches")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    nodes = stash(rows.groupBy("whole").agg(F.min("row").alias("row"), best.alias("best"), F.count(F.lit(1)).alias("n"), *(F.first(c).alias(c) for c in ("size", "bits", "nibbles", "bands"))), "nodes")
    marks = nodes.select("row", F.explode("bands").alias("bucket"))
    shared = marks.groupBy("bucket").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    live = stash(marks.join(shared, "bucket"), "live")
    facts = nodes.select("row", F.struct("size", "bits", "nibbles").alias("own"))
    live = live.join(facts, "row").join(facts.select(F.col("row").alias("first"), F.col("own").alias("head")), "first")
    live = stash(live, "members")
    sets = stash(sets_of(docs, nodes.select("row", "whole").join(live.select("row"), "row", "left_semi"), text_col), "sets")
    with_first = live.filter((F.col("row") != F.col("first")) & plausible("own", "head", threshold))
    links = stash(verified(with_first.select(F.col("first").alias("a"), F.col("row").alias("b")).distinct(), sets, threshold), "links")
    label = components(links).withColumnsRenamed({"node": "row", "label": "part"})
    parts = live.join(label, "row", "left").select("bucket", "row", "own", "first", F.coalesce("part", "row").alias("part"))
    heads = parts.filter(F.col("row") == F.col("first")).select("bucket", F.col("part").alias("head"))
    parts = parts.join(heads, "bucket")
    torn = parts.groupBy("bucket").agg(F.max(F.col("part") != F.col("head")).alias("torn")).filter("torn").select("bucket")
    parts = parts.join(torn, "bucket", "left_semi").filter(F.col("row") != F.col("first"))
    parts = stash(parts.join(nodes.select("row", "bands"), "row"), "parts")
    x, y = parts.filter(F.col("part") != F.col("head")).alias("x"), parts.alias("y")
    alike = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.part") != F.col("y.part")) & plausible("x.own", "y.own", threshold)
    alike &= (F.col("y.part") == F.col("y.head")) | (F.col("x.row") < F.col("y.row"))  # pairs of others once
    alike &= F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.bucket")  # and in the least bucket they share, whichever side is x
    rest = x.join(y, alike).select(F.least("x.row", "y.row").alias("a"), F.greatest("x.row", "y.row").alias("b")).distinct()
    links = links.union(stash(verified(rest, sets, threshold), "more"))
    label = components(links).withColumnRenamed("node", "row")
    classes = nodes.join(label, "row", "left").select("whole", "best", "n", F.coalesce("label", "row").alias("label"))
    # Written, so that the join can split the texts of a large class among tasks.
    total = stash(classes.groupBy("label").agg(F.min("best").alias("top"), F.sum("n").alias("class_size")), "totals")
    named = stash(classes.join(total, "label").select("whole", "top", "class_size"), "classes")
    return rows.select("id", "row", "text_hash", "whole").join(named, "whole").select(F.col("id").alias(id_col), F.col("top.id").alias("class_id"), "class_size", (F.col("row") == F.col("top.row")).alias("kept"), "text_hash")
