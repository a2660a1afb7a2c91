"""Order MinHash fingerprints: sketches whose agreement falls with edit distance.

Every k-mer of a text is numbered by its occurrence, so that repeats count. Each of the components takes, in a random
order of its own, the first `take` numbered k-mers, puts them back into the order in which they stand in the text, and
hashes that tuple. Two texts agree in a component if they have the same minimal k-mers in the same order."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import _registers, _text
from inkwell.llm._tables import partitions, with_position

K, TAKE, COMPONENTS = 8, 2, 64
FACTORS = _text.mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)
#: Bits for places in a text in the sort keys of its k-mers; the others are of the k-mer's hash.
PLACE = 20


def kmers(points: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the runs of k code points, or of all of them if there are fewer (none of none)."""
    n = max(len(points) - k + 1, min(len(points), 1))
    total = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(points))):
        total += (points[j : j + n].astype(np.uint64) + np.uint64(1)) * FACTORS[j]
    return _text.mix(total)


def occurrences(hashes: np.ndarray) -> np.ndarray:
    """How many equal ones stand before each."""
    n = len(hashes)
    if n < 1 << PLACE:
        low = np.uint64((1 << PLACE) - 1)
        keys = np.sort((hashes & ~low) | np.arange(n, dtype=np.uint64))
        order, same = (keys & low).astype(np.int64), (keys[1:] ^ keys[:-1]) <= low
    else:
        order = np.argsort(hashes, kind="stable")
        ranked = hashes[order]
        same = ranked[1:] == ranked[:-1]
    place = np.arange(n)
    begin = place.copy()
    begin[1:][same] = 0
    out = np.empty(n, dtype=np.uint64)
    out[order] = place - np.maximum.accumulate(begin)
    return out


def fingerprints(texts: list[str], k: int = K, take: int = TAKE, components: int = COMPONENTS) -> np.ndarray:
    """One row of 16-bit numbers a text. A text without k-mers has zeros; one with fewer than `take` uses all it has."""
    own = [kmers(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), k) for x in texts]
    starts = np.cumsum([0, *map(len, own)])
    out = np.zeros((len(texts), components), dtype=np.uint16)
    if not starts[-1]:
        return out
    hashes = np.concatenate(own)
    elements = _text.mix(hashes + np.concatenate([occurrences(x) for x in own]) * FACTORS[40])
    sizes = np.diff(starts)

    def fill(rows: np.ndarray, until: np.ndarray) -> np.ndarray:
        at, owner = _registers.pick(starts, rows)
        found, register, time = _registers.arrivals(elements[at], None, owner, until[rows], components)
        key = owner[found] * components + register
        which = at[found]
        cells = len(rows) * components
        # One sort by register and time: the time takes the lower 40 bits.
        order = np.argsort((key.astype(np.uint64) << np.uint64(40)) | (time / until[rows][owner[found]] * (2.0**40 - 1)).astype(np.uint64))
        key, which = key[order], which[order]
        places = np.full((take, cells), -1, dtype=np.int64)
        for j in range(take):
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            places[j, key[head]] = which[head]
            other = which != places[j, key]  # an element counts once
            key, which = key[other], which[other]
        done = ((places >= 0).sum(axis=0).reshape(len(rows), components) >= np.minimum(take, sizes[rows])[:, None]).all(axis=1)
        places = np.sort(places, axis=0)
        total = np.zeros(cells, dtype=np.uint64)
        for j in range(take):
            total += np.where(places[j] >= 0, hashes[places[j]], np.uint64(0)) * FACTORS[50 + j]
        out[rows] = np.where((places >= 0).any(axis=0), _text.mix(total) >> np.uint64(48), 0).astype(np.uint16).reshape(len(rows), components)
        return done

    _registers.settle(len(texts), components / np.maximum(sizes, 1) * 10.0, components * 10.0, fill)
    return out


def spell(prints: np.ndarray) -> list[str]:
    return [x.astype(">u2").tobytes().hex() for x in prints]


def likeness(a: str, b: str) -> float:
    """Share of equal components of two fingerprints."""
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, len(a), 4)) / (len(a) // 4)


def edited(text: str, other: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the other text."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, halo, id, text, dealt out so that a task holds a run of rows, then the row with halo set that comes next: ids
    descend, null is last, rows of one id go by a hash of their text, and after the last comes the first.

    Runs are cut at keys (id, hash), found on these columns alone, so that rows of one id, or of none, are split as others
    are. A cut is a key and not a row: rows that agree in id and text are in one run, and it makes no difference if the table
    gives its rows in another order when it is read again. The driver sees one key a cut; each text moves once (those at a
    cut twice)."""
    count = 2 * partitions(docs.sparkSession)
    value = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(value).alias("hash"), value.alias("text"))
    placed = with_position(rows.drop("text"), [F.col("id").asc_nulls_first(), F.col("hash")], "_position")
    size = placed.count()
    each = max(1, -(-size // count))
    last = placed.filter(((F.col("_position") + 1) % each == 0) | (F.col("_position") == size - 1)).select("id", "hash").distinct()
    cuts = sorted((r["id"] is not None, r["id"], r["hash"]) if r["id"] is not None else (False, 0, r["hash"]) for r in last.collect())
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["bucket", "halo", "id", "hash", "text"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [(i is not None, i if i is not None else 0, h) for i, h in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True)]
            own = [bisect_left(cuts, k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([False] * len(own)), *batch.columns], names=names)
            # The greatest key of a run is what comes after the least one of the run above; equal rows do as well.
            ends = [i for i, b in enumerate(own) if keys[i] == cuts[b]]
            if ends:
                yield pa.RecordBatch.from_arrays([pa.array([(own[i] + 1) % len(cuts) for i in ends], pa.int32()), pa.array([True] * len(ends)), *batch.take(pa.array(ends)).columns], names=names)

    dealt = rows.mapInArrow(deal, f"bucket int, halo boolean, id {kind}, hash long, text string")
    dealt = dealt.repartitionById(max(1, len(cuts)), F.col("bucket")) if cuts else dealt
    return dealt.sortWithinPartitions("bucket", "halo", F.col("id").desc_nulls_last(), F.col("hash").desc()).select("bucket", "halo", "id", "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, take: int = TAKE, components: int = COMPONENTS) -> DataFrame:
    """One row a document: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next lower id (ties by a hash of the text, null ids last, after the last the
    first). Ids of any type that has an order will do. A null text counts as empty. Rows of one id that differ follow each other; extra columns don't matter; an empty table
    gives no rows."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # bucket, halo, id, text, fingerprint of the row before
        for batch in batches:
            sizes = np.append(0, np.cumsum(pa.compute.binary_length(batch.column(3)).to_numpy()))
            for a, b in _text.steps(sizes, _text.STEP // 4):
                rows = list(zip(*(c.slice(a, b - a).to_pylist() for c in batch.columns), strict=True))
                prints = spell(fingerprints([r[3] for r in rows], k, take, components))
                chain = ([held] if held else []) + [(*r, p) for r, p in zip(rows, prints, strict=True)]
                pairs = [(x, y) for x, y in zip(chain, chain[1:], strict=False) if x[0] == y[0] and not x[1]]
                held = chain[-1]
                if not pairs:
                    continue
                texts = [edited(x[3], y[3]) for x, y in pairs]
                other = spell(fingerprints(texts, k, take, components))
                yield pa.RecordBatch.from_pydict(
                    {
                        id_col: pa.array([x[2] for x, _ in pairs], batch.schema.field(2).type),
                        "n_chars": pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts],
                        "fingerprint": [x[4] for x, _ in pairs],
                        "edited_fingerprint": other,
                        "near_edited": pa.array([likeness(x[4], p) for (x, _), p in zip(pairs, other, strict=True)], pa.float64()),
                        "near_next": pa.array([likeness(x[4], y[4]) for x, y in pairs], pa.float64()),
                    }
                )

    import pyarrow.compute  # noqa: F401

    return with_next(docs, id_col, text_col).mapInArrow(
        sketch, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
