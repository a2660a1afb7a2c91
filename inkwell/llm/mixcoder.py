"""A range coder for token ids whose probabilities come from mixed predictions, for whole blocks at once.

A block's ids are dealt to lanes of consecutive ids that are coded side by side, one id of each lane a step; all lanes share
one model, which starts empty in each block and learns after each step. It mixes three predictions of the next id: the one
that last followed the two ids before (order 2), the one that last followed the id before (order 1), each with a confidence,
and the frequencies of ids so far (order 0). How much weight the first two get is learned for each pair of confidences. The
mixture is linear, so the sum below an id is the mixture of the sums below it, and an id takes one coding step; only ids not
seen in the block take a second one, of plain bits.

All is whole numbers, the same for coding and decoding. Coding steps are those of a carryless range coder with 64 bits of
state and 32-bit words."""

from __future__ import annotations

import struct
import zlib

import numpy as np

U, V = np.uint64, np.uint32
#: Ids of a vocabulary at most.
MOST = 1 << 22
#: Bits of the mixture's weights, at most; lanes of a block at most, and ids of a lane at least.
WEIGHT_BITS, LANES, LANE_IDS = 12, 4096, 256
#: Bits of the order-2 table; a step of the schedule on which order-0 frequencies are taken anew.
PAIR_BITS, ANEW = 18, 1.125
#: Steps whose ids are brought together at once: as many as lie in a line of a cache.
TILE = 16
LOW32 = U(0xFFFFFFFF)
HEADER = struct.Struct("<4sIIII")
MAGIC = b"ICM1"


def shape(n: int) -> tuple[int, int, int]:
    """Lanes, whole steps, and lanes with one id more."""
    lanes = max(1, min(LANES, n // LANE_IDS))
    return lanes, n // lanes, n % lanes


class Model:
    """Predictions for one step of all lanes, and what is learned from the ids that came. Ids and places are below 2**30."""

    def __init__(self, lanes: int, vocabulary: int):
        if not 0 < vocabulary <= MOST:
            raise ValueError(f"a vocabulary has 1 to {MOST} ids")
        self.vocabulary = vocabulary
        self.raw_bits = max(1, (vocabulary - 1).bit_length())
        self.bits = 16
        while (1 << self.bits) < vocabulary + vocabulary // 8:
            self.bits += 1
        self.total = 1 << self.bits
        self.weight_bits = min(WEIGHT_BITS, 30 - self.bits)
        self.counts = np.zeros(vocabulary, dtype=np.int64)
        self.one = np.zeros(vocabulary, dtype=V)  # order 1: id and confidence after an id
        self.two = np.zeros(1 << PAIR_BITS, dtype=V)  # order 2: the same after a hash of two
        self.before = np.zeros(lanes, dtype=np.int64)
        self.earlier = np.zeros(lanes, dtype=V)
        self.seen, self.hits = np.full(128, 4, dtype=np.int64), np.ones((2, 128), dtype=np.int64)
        self.step, self.next, self.recent, self.told = 0, 1, [], []
        self.take_weights()
        self.take_frequencies()

    def take_frequencies(self) -> None:
        """Order-0 shares of the ids so far; what is left for new ones is the share of ids that came once."""
        if self.recent:
            self.counts += np.bincount(np.concatenate(self.recent), minlength=self.vocabulary)
            self.recent = []
        used = np.flatnonzero(self.counts > 0)
        counts = self.counts[used]
        n = int(counts.sum())
        share = np.zeros(self.vocabulary + 1, dtype=np.int64)  # the last one: a new id
        if n:
            new = min(max(1, self.total * int((counts == 1).sum()) // n), self.total - self.vocabulary)
            own = 1 + counts * (self.total - new - len(used)) // n
            own[np.argmax(own)] += self.total - new - int(own.sum())
            share[used] = own
            share[-1] = new
        else:
            share[-1] = self.total
        self.used, self.own, self.at = used, share[used], None
        self.share = share.astype(V)
        self.below = np.cumsum(self.share, dtype=V) - self.share

    def take_weights(self) -> None:
        """Weights of the two predictions for each kind of confidences, and what is left for order 0."""
        if self.told:
            found = np.bincount(np.concatenate(self.told), minlength=512).reshape(128, 4)
            self.told = []
            self.seen += found.sum(axis=1)
            self.hits[0] += found[:, 2] + found[:, 3]
            self.hits[1] += found[:, 1]
        most = (1 << self.weight_bits) - 64
        two = np.minimum((self.hits[0] << self.weight_bits) // self.seen, most)
        one = np.minimum((self.hits[1] << self.weight_bits) // self.seen, most - two)
        one[1::2] = 0  # both predict the same id
        self.bases, self.twos, self.ones = (x.astype(V) for x in ((1 << self.weight_bits) - two - one, two << self.bits, one << self.bits))

    def predict(self) -> None:
        """The ids that the two and the one id before predict, their masses, and the weight of order 0."""
        before = self.before.astype(V)
        self.pair = ((before * V(0x9E3779B1) + self.earlier * V(0x85EBCA77)) >> V(32 - PAIR_BITS)).astype(np.int64)
        self.earlier = before
        self.was_two, self.was_one = self.two.take(self.pair), self.one.take(self.before)
        self.by_two, self.by_one = self.was_two >> V(3), self.was_one >> V(3)
        self.sure_two, self.sure_one = self.was_two & V(7), self.was_one & V(7)
        self.kind = ((self.sure_two << V(4)) + (self.sure_one << V(1)) + (self.by_two == self.by_one)).astype(np.int64)
        self.base, self.mass_two, self.mass_one = self.bases.take(self.kind), self.twos.take(self.kind), self.ones.take(self.kind)

    def place(self, ids: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each id's interval begins, and its size. coded: the ids in 32 bits."""
        begin = self.base * self.below.take(ids) + self.mass_two * (coded > self.by_two) + self.mass_one * (coded > self.by_one)
        return begin, self.base * self.share.take(ids) + self.mass_two * (coded == self.by_two) + self.mass_one * (coded == self.by_one)

    def interval(self, ids: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The interval of each id, or of a new one, and which ids are coded as new."""
        begin, size = self.place(ids, coded)
        new = np.flatnonzero(size == 0)
        if len(new):  # what comes after all ids
            begin[new] = self.base[new] * self.below[-1] + self.mass_two[new] + self.mass_one[new]
            size[new] = self.base[new] * self.share[-1]
        return begin, size, new

    def find(self, value: np.ndarray) -> np.ndarray:
        """The id (or vocabulary for a new one) whose interval holds a value."""
        if self.at is None:
            self.at = np.repeat(np.append(self.used, self.vocabulary), np.append(self.own, self.share[-1]))
        # How far a value lies beyond where a predicted id's interval begins; below it, that wraps to a number beyond any size.
        past_two = value - (self.base * self.below.take(self.by_two) + self.mass_one * (self.by_two > self.by_one))
        past_one = value - (self.base * self.below.take(self.by_one) + self.mass_two * (self.by_one > self.by_two))
        in_two = past_two < self.base * self.share.take(self.by_two) + self.mass_two
        in_one = past_one < self.base * self.share.take(self.by_one) + self.mass_one
        beyond_two, beyond_one = (past_two < V(1 << 31)) & ~in_two, (past_one < V(1 << 31)) & ~in_one
        rest = value - self.mass_two * beyond_two - self.mass_one * beyond_one
        # Within the interval of a predicted id the rest may pass the table's end: it isn't used there.
        ids = self.at.take((rest / self.base).astype(np.int64), mode="clip")
        np.copyto(ids, self.by_two, where=in_two)
        np.copyto(ids, self.by_one, where=in_one)
        return ids

    def learn(self, ids: np.ndarray, coded: np.ndarray) -> None:
        by_two, by_one = coded == self.by_two, coded == self.by_one
        self.told.append((self.kind << 2) + (by_two.view(np.uint8) * np.uint8(2) + by_one))
        self.recent.append(ids)
        fresh = (coded << V(3)) | V(1)
        for table, at, was, sure, hit in ((self.two, self.pair, self.was_two, self.sure_two, by_two), (self.one, self.before, self.was_one, self.sure_one, by_one)):
            # A hit adds confidence, up to 7; a miss takes some, and the place of an id that has at most 1.
            table[at] = np.where(hit | (sure > 1), was + (hit & (sure < 7)) - ~hit, fresh)
        self.before = ids
        self.step += 1
        if self.step < 32 or self.step % 8 == 0:
            self.take_weights()
        if self.step == self.next:
            self.take_frequencies()
            self.next = max(self.step + 1, int(self.step * ANEW))

    def keep(self, lanes: int) -> None:
        self.before, self.earlier = self.before[:lanes], self.earlier[:lanes]


def shift(low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shifts a word out of lanes that have to: which, and their lower ends before. A width that crosses a word's border is cut
    at it."""
    lanes = np.flatnonzero(width <= LOW32)
    a, w = low[lanes], width[lanes]
    if len(lanes):
        crossing = np.flatnonzero((a ^ (a + w - U(1))) > LOW32)
        w[crossing] = (~a[crossing] + U(1)) & LOW32
        width[lanes] = w << U(32)
        low[lanes] = a << U(32)
    return lanes, a


def by_steps(ids: np.ndarray, lanes: int, steps: int, more: int) -> np.ndarray:
    """Ids of a block by steps: a row has one of each lane; the last one is for the lanes with one id more."""
    out = np.zeros((steps + 1, lanes), dtype=V)
    long = more * (steps + 1)
    for a in range(0, steps + 1, TILE):
        b = a + TILE
        out[a:b, :more] = ids[:long].reshape(more, steps + 1)[:, a:b].T
        out[a : min(b, steps), more:] = ids[long:].reshape(lanes - more, steps)[:, a:b].T
    return out


def by_lanes(rows: np.ndarray, more: int) -> np.ndarray:
    """The ids of by_steps in their order."""
    return np.concatenate([rows[:, :more].T.ravel(), rows[:-1, more:].T.ravel()])


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block of ids below vocabulary."""
    n = len(ids)
    lanes, steps, more = shape(n)
    ids = np.asarray(ids).astype(V)
    rows = by_steps(ids, lanes, steps, more)
    model = Model(lanes, vocabulary)
    low, width = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    places, words = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint32)]

    for step in range(steps + (more > 0)):
        active = lanes if step < steps else more
        model.keep(active)
        coded = rows[step, :active]
        own = coded.astype(np.int64)
        model.predict()
        begin, size, new = model.interval(own, coded)
        a, w = low[:active], width[:active]
        part = w >> U(model.bits + model.weight_bits)
        a += part * begin
        np.multiply(part, size, out=w)
        out, was = shift(a, w)
        places.append(out)
        words.append((was >> U(32)).astype(np.uint32))
        if len(new):
            a, w = low[new], width[new]
            w >>= U(model.raw_bits)
            a += w * coded[new]
            out, was = shift(a, w)
            low[new], width[new] = a, w
            places.append(new[out])
            words.append((was >> U(32)).astype(np.uint32))
        model.learn(own, coded)
    # Each lane's words: those shifted out, one that ends it, and zero. A decoder holds two words ahead of what it shifts out.
    lane, word = np.concatenate(places), np.concatenate(words)
    count = np.bincount(lane, minlength=lanes)
    begin = np.cumsum(count + 2) - (count + 2)
    order = np.argsort(lane.astype(np.uint16), kind="stable")  # of 16 bits: by radix
    rank = np.empty(len(lane), dtype=np.int64)
    rank[order] = np.arange(len(lane)) - np.repeat(np.cumsum(count) - count, count)
    sequence = np.zeros(len(lane) + 2 * lanes, dtype="<u4")
    sequence[begin[lane] + rank] = word
    sequence[begin + count] = ((low + LOW32) >> U(32)).astype(np.uint32)
    stream = np.concatenate([sequence[begin], sequence[begin + 1], sequence[begin[lane] + rank + 2]])
    body = HEADER.pack(MAGIC, vocabulary, n, zlib.crc32(ids.astype("<u4", copy=False)), len(stream)) + stream.tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def decode(block: bytes) -> np.ndarray:
    """The ids of a block. ValueError if it isn't one, or isn't whole."""
    if len(block) < HEADER.size + 4 or block[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    if zlib.crc32(memoryview(block)[:-4]) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("a block of token ids is damaged: its checksum differs")
    _, vocabulary, n, checksum, size = HEADER.unpack_from(block)
    stream = np.frombuffer(block, dtype="<u4", count=size, offset=HEADER.size).astype(np.uint64)
    lanes, steps, more = shape(n)
    rows = np.zeros((steps + 1, lanes), dtype=V)
    model = Model(lanes, vocabulary)
    # Only the code's distance from the interval's lower end and that end itself are needed.
    low, width = np.zeros(lanes, dtype=np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    code = stream[:lanes] << U(32) | stream[lanes : 2 * lanes]
    read = 2 * lanes

    def take(a: np.ndarray, w: np.ndarray, c: np.ndarray) -> None:
        nonlocal read
        out, _ = shift(a, w)
        c[out] = c[out] << U(32) | stream[read : read + len(out)]
        read += len(out)

    for step in range(steps + (more > 0)):
        active = lanes if step < steps else more
        model.keep(active)
        model.predict()
        a, w, c = low[:active], width[:active], code[:active]
        part = w >> U(model.bits + model.weight_bits)
        own = model.find(((c - a) // part).astype(V))
        coded = own.astype(V)
        begin, size = model.place(own, coded)
        a += part * begin
        np.multiply(part, size, out=w)
        take(a, w, c)
        new = np.flatnonzero(own == vocabulary)
        if len(new):
            a, w, c = low[new], width[new], code[new]
            w >>= U(model.raw_bits)
            raw = (c - a) // w
            a += w * raw
            take(a, w, c)
            low[new], width[new], code[new] = a, w, c
            own[new] = raw.astype(np.int64)
            coded[new] = raw.astype(V)
        rows[step, :active] = coded
        model.learn(own, coded)
    ids = by_lanes(rows, more).astype(np.int64)
    if zlib.crc32(ids.astype("<u4")) != checksum:
        raise ValueError("a block of token ids is damaged: its ids' checksum differs")
    return ids


__all__ = ["LANES", "decode", "encode"]
