"""Best-fit packing: tokenised documents into sequences of a fixed capacity.

Best-fit decreasing places pieces by length, longest first, each into the tightest open bin. Which piece of equal
length goes where makes no difference, so the driver needs only the counts of each length (at most `capacity` numbers
for any corpus): it runs best-fit decreasing over runs of equal bins, with a segment tree over remaining capacities,
and gives a table of runs. Each piece then finds its bin from its rank among pieces of its length."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm import _text
from inkwell.llm._tables import stash, with_position

#: Pre-tokens that a worker keeps ids of (half as many more, if one step has many), and how many ids each has on the average, at most.
KEPT, KEPT_IDS = 600_000, 8


class CapacityTree:
    """Counts open bins by remaining capacity; finds the least capacity that suffices and has bins, in log steps."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, bins: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += bins
            at >>= 1

    def tightest(self, need: int) -> int | None:
        at = self.leaves + need
        while not self.count[at]:
            while at & 1:  # a right child: all to the right of it lies under a later ancestor
                at >>= 1
                if at <= 1:
                    return None
            if at == 0:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing for counts of lengths. Gives runs (length, first rank, pieces, first bin, offset), where
    the pieces of a run go to consecutive bins at the same offset, and the number of bins."""
    tree, open_bins, runs, bins = CapacityTree(capacity), {}, [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            open_bins.setdefault(room, []).append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:  # new bins; each takes pieces until it is too full for one more
                each = capacity // length
                for n, per in ((left // each, each), (1, left % each)):
                    if n and per:
                        for slot in range(per):
                            runs.append((length, rank, n, bins, slot * length))
                            rank += n
                        leave(capacity - per * length, bins, n)
                        bins += n
                break
            first, n = open_bins[room].pop()
            used = min(n, left)
            tree.add(room, -n)
            leave(room, first + used, n - used)
            runs.append((length, rank, used, first, capacity - room))
            leave(room - length, first, used)
            rank += used
            left -= used
    return runs, bins


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others for
    the letters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Encoder:
    """Ids of whole texts by a byte-level BPE of the tokenizers library.

    Such a tokenizer splits a text into pre-tokens that it encodes one by one. The splits are found here for many
    texts at once, and each distinct pre-token is given to the tokenizer once. An added token that stands in a text
    literally is a pre-token with an id of its own, as for the library; what is around it is split on its own."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.literal = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        points = "".join(map(chr, [*range(0xD800), *([0xFFFD] * 0x800), *range(0xE000, 0x110000)]))
        self.kind = np.zeros(0x110000, dtype=np.uint8)  # 0: other
        for kind, pattern in ((1, r"\p{L}+"), (2, r"\p{N}+"), (3, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, points):
                self.kind[m.start() : m.end()] = kind
        self.letters = np.array([ord(c) for c in byte_letters()], dtype="<u2")
        self.forget()

    def many(self, text: str, raw: np.ndarray, byte: np.ndarray, starts: np.ndarray, ends: np.ndarray, literal: bool) -> tuple[list[int], list[int]]:
        """Ids of pre-tokens one after another, and how many each has. They are given by their code points in text, whose bytes
        are raw; byte: where code points begin there."""
        size = byte[ends] - byte[starts]
        to = np.cumsum(size)
        own = raw[np.repeat(byte[starts] - (to - size), size) + np.arange(int(to[-1]))]
        spelled, tokenize = self.letters[own].tobytes().decode("utf-16-le"), self.tokenizer.model.tokenize
        added = {}
        if literal:  # added tokens that stand in the text
            added = {i: self.added[x] for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)) if (x := text[a:b]) in self.added}
        ids, n = [], []
        for i, (a, b) in enumerate(zip((to - size).tolist(), to.tolist(), strict=True)):
            found = [added[i]] if i in added else [x.id for x in tokenize(spelled[a:b])]
            ids += found
            n.append(len(found))
        return ids, n

    def forget(self, least: int = 0) -> None:
        """Room for KEPT pre-tokens, or least if that is more: at most two of three places are taken."""
        room = max(KEPT, least)
        self.bits = (room * 3 // 2).bit_length()
        self.hash = np.zeros(1 << self.bits, dtype=np.uint64)  # of the pre-token at each place; 0: a free one
        self.number = np.zeros(1 << self.bits, dtype=np.int32)
        self.kept, self.again = 0, np.zeros(room, dtype=bool)  # by number: whether a later step had it too
        self.first = np.zeros(room + 1, dtype=np.int64)  # where its ids begin, and end at the next
        self.ids = np.empty(1 << 16, dtype=np.uint32)

    def thin(self, least: int) -> None:
        """Keeps the pre-tokens that later steps had too, unless they are half of the room; makes room for least more."""
        at = np.flatnonzero(self.hash)
        at = at[self.again[self.number[at]]]
        keys, number = self.hash[at], self.number[at]
        where = self.first[number]
        n = self.first[number + 1] - where
        ends = np.cumsum(n)
        few = 0 < len(keys) <= KEPT // 2 and ends[-1] <= KEPT * KEPT_IDS // 2
        ids = self.ids[np.repeat(where - (ends - n), n) + np.arange(int(ends[-1]))] if few else None
        self.forget(least + KEPT // 2)
        if few:
            self.keep(keys, ids, n)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each hash, or the free one where it would go: the first from its own on."""
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.hash.take(at)
        left = np.flatnonzero((there != keys) & (there != 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            there = self.hash[at[left]]
            left = left[(there != keys[left]) & (there != 0)]
        return at

    def keep(self, keys: np.ndarray, ids: list[int] | np.ndarray, n: list[int] | np.ndarray) -> None:
        """Keeps the ids of pre-tokens that are new, given by their distinct hashes."""
        ends = self.first[self.kept] + np.cumsum(np.array(n, dtype=np.int64))
        before, total = int(self.first[self.kept]), int(ends[-1])
        if total > len(self.ids):
            more = np.empty(2 * total, dtype=np.uint32)
            more[:before] = self.ids[:before]
            self.ids = more
        self.ids[before:total] = ids
        self.first[self.kept + 1 : self.kept + len(keys) + 1] = ends
        number = np.arange(self.kept, self.kept + len(keys), dtype=np.int32)
        self.kept += len(keys)
        while len(keys):
            at = self.places(keys)
            self.hash[at] = keys  # of several that would go to one place, one takes it
            won = self.hash[at] == keys
            self.number[at[won]] = number[won]
            keys, number = keys[~won], number[~won]

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin: contractions; letters, numbers or others with one space before; other white space."""
        n = len(points)
        kind = self.kind.take(points)
        begins = np.zeros(n, dtype=bool)
        begins[first] = True
        white = kind == 3
        before, change = white[:-1], kind[1:] != kind[:-1]
        start = np.zeros(n, dtype=bool)
        start[1:] = change & (~before | (points[:-1] != 32))
        last = white[1:-1] & before[:-1] & ~white[2:] & ~begins[2:]  # of a longer run, before something else
        start[1:-1] |= last
        quote = np.flatnonzero(points[:-1] == 39)
        if len(quote):
            lone = start[quote] | begins[quote]
            own = np.append(first, n)
            end = own[np.searchsorted(own, quote, side="right")]
            one = points[np.minimum(quote + 1, n - 1)]
            two = points[np.minimum(quote + 2, n - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"]) & (quote + 1 < end)
            pairs = [(ord(a), ord(b)) for a, b in ("re", "ve", "ll")]
            long = np.logical_or.reduce([(one == a) & (two == b) for a, b in pairs]) & (quote + 2 < end)
            for found, size in ((lone & short, 2), (lone & long, 3)):
                at = quote[found]
                start[at + 1] = False
                at = at + size
                start[at[at < n]] = True
        return np.flatnonzero(start | begins)

    def spans(self, text: str, rows: np.ndarray) -> np.ndarray:
        """Starts and ends of added tokens in rows (their bounds) one after another."""
        out, at = [], 0
        while self.literal and (m := self.literal.search(text, at)):
            end = int(rows[np.searchsorted(rows, m.start(), side="right")])
            inside = m if m.end() <= end else self.literal.search(text, m.start(), end)
            if inside:
                out.append(inside.span())
            at = inside.end() if inside else m.start() + 1
        return np.array(out, dtype=np.int64).reshape(-1, 2)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, and where each row's begin."""
        raw = data[offsets[0] : offsets[-1]]
        text = raw.tobytes().decode("utf-8", "surrogatepass")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        byte = np.append(np.flatnonzero(raw.view(np.int8) >= -64), len(raw))  # all but the bytes that continue a code point
        rows = np.searchsorted(byte, offsets - offsets[0])
        if not len(points):
            return np.zeros(0, dtype=np.uint32), np.zeros(len(offsets), dtype=np.int64)
        spans = self.spans(text, rows)
        first = np.concatenate([rows[:-1], spans.ravel()])
        starts = self.starts(points, np.unique(first[first < len(points)]))
        if len(spans):
            at = np.searchsorted(spans[:, 0], starts, side="right") - 1
            starts = starts[(at < 0) | (starts == spans[at, 0]) | (starts >= spans[at, 1])]
        ends = np.append(starts[1:], len(points))
        keys = _text.hashes(points, starts, ends)
        keys[keys == 0] = 1
        at = self.places(keys)
        new = np.flatnonzero(self.hash.take(at) == 0)
        unique, sample = np.unique(keys[new], return_index=True)
        if self.kept + len(unique) > KEPT or self.first[self.kept] > KEPT * KEPT_IDS:
            self.thin(len(np.unique(keys)))
            at = self.places(keys)
            new = np.flatnonzero(self.hash.take(at) == 0)
            unique, sample = np.unique(keys[new], return_index=True)
        self.again[self.number.take(at)] = True  # (and number 0, for places that are free)
        if len(new):
            pick = new[sample]
            self.keep(unique, *self.many(text, raw, byte, starts[pick], ends[pick], len(spans) > 0))
            at[new] = self.places(keys[new])
        number = self.number.take(at).astype(np.int64)
        where = self.first.take(number)
        n = self.first.take(number + 1) - where
        ends_at = np.cumsum(n)
        ids = self.ids.take(np.repeat(where - (ends_at - n), n) + np.arange(int(ends_at[-1])))
        return ids, np.append(0, ends_at)[np.searchsorted(starts, rows)]


def encoder(path: str) -> Encoder:
    if path not in (own := _text.held.setdefault("encoders", {})):
        own[path] = Encoder(path)
    return own[path]


def tokenise(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Cuts each document's ids (its text's, then end_id) into pieces of at most capacity.

    Returns the columns in keep, piece int, start long, length long and ids binary (little-endian unsigned 32-bit).
    Only documents longer than capacity are cut; all pieces but the first are then full. A null text counts as empty:
    one piece with end_id alone. tokenizer: path of a byte-level BPE file that every worker can read."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        for batch in batches:
            data, offsets = _text.buffers(batch.column(0))
            for a, b in _text.steps(offsets):
                ids, at = own.encode(data, offsets[a : b + 1])
                owner, piece, start, length, parts = [], [], [], [], []
                for i in range(b - a):
                    doc = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                    head = (len(doc) - 1) % capacity + 1
                    for k, end in enumerate(range(head, len(doc) + 1, capacity)):
                        begin = 0 if k == 0 else end - capacity
                        owner.append(a + i)
                        piece.append(k)
                        start.append(begin)
                        length.append(end - begin)
                        parts.append(doc[begin:end].tobytes())
                kept = [batch.column(1 + j).take(pa.array(owner, pa.int64())) for j in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(parts, pa.binary())], names=[*keep, "piece", "start", "length", "ids"])

    rows = docs.select(F.col(text).cast("string").alias("_text"), *keep)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(_text.tidy(cut, ("encoders",)), f"{kept}, piece int, start long, length long, ids binary")


def pack(pieces: DataFrame, capacity: int = 2048, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Adds sequence_id long and offset long to rows with a length of 1 to capacity, by best-fit decreasing.

    Ties (equal lengths) go by the columns in order; equal rows are interchangeable. An empty table gives an empty
    result. Other columns pass through."""
    placed = with_position(pieces, [F.col("length"), *(F.col(c).asc_nulls_last() for c in order)], "_position")
    counts = dict(sorted((r[0], r[1]) for r in placed.groupBy("length").count().collect()))  # at most capacity rows
    runs, _ = best_fit(counts, capacity)
    before = dict(zip(counts, accumulate(counts.values(), initial=0), strict=False))
    table = np.array(sorted((before[length] + rank, first, offset) for length, rank, _, first, offset in runs), dtype=np.int64).reshape(-1, 3)
    shared = pieces.sparkSession.sparkContext.broadcast(table)
    names = pieces.columns
    where = placed.columns.index("_position")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, bins, offset = shared.value.T
        for batch in batches:
            position = batch.column(where).to_numpy()
            run = np.searchsorted(at, position, side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(bins[run] + position - at[run]), pa.array(offset[run])], names=[*names, "sequence_id", "offset"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return placed.mapInArrow(assign, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Tokenises, cuts and packs documents; one row a piece, with a checksum in place of the ids."""
    cut = tokenise(docs, tokenizer, capacity, end_id)
    # Written, as ordering them by ranges reads them twice.
    return pack(stash(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces"), capacity)


__all__ = ["CapacityTree", "best_fit", "encoder", "pack", "pack_documents", "tokenise"]
