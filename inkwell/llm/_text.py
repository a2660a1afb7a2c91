"""Vectorised text work inside tasks: words and their hashes from Arrow string columns.

Hashes are 64-bit polynomials over bytes or code points, finished by a mixer; they depend on nothing but the text."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
#: An odd multiplier.
FACTOR = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text and rows that are worked on at once (a longer document is taken whole).
STEP, ROWS = 1 << 20, 4096

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: What this worker holds between tasks, by name: tables and tokenizers that are dear to make.
held: dict[str, object] = {}


def let_go(holds: tuple[str, ...]) -> None:
    for name in held.keys() - {"powers", *holds}:
        del held[name]


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], holds: tuple[str, ...] = ()):
    """work for mapInArrow in a worker that later stages use too. What other work holds, beyond what is named in holds, is
    let go at the start; memory that is free is given back to the system at the end, as idle workers would keep the peak of
    their last task beside the needs of the next stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(holds)  # these are functions of the module: what is within this one is sent to workers as a copy
        yield from work(batches)
        give_back()

    return run


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the power 0 .. n-1 and the inverses, modulo 2**64. Those for a step are held, more are made anew."""

    def make(size: int) -> tuple[np.ndarray, np.ndarray]:
        both = np.empty((2, size), dtype=np.uint64)
        for x, base in zip(both, (BASE, pow(BASE, -1, 1 << 64)), strict=True):
            x[:] = base
            x[0] = 1
            np.cumprod(x, dtype=np.uint64, out=x)
        return both[0], both[1]

    if n > STEP + 1:
        return make(n)
    if "powers" not in held:
        held["powers"] = make(STEP + 1)
    up, down = held["powers"]
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (SplitMix64's finisher)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), offsets


def steps(offsets: np.ndarray, limit: int = STEP) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most limit bytes (or one row)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        b = min(b, n, a + ROWS)
        yield a, b
        a = b


def spans(space: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs that aren't space and don't cross the positions in first (starts of rows)."""
    n = len(space)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    cut = np.zeros(n + 1, dtype=bool)
    cut[first] = True
    cut[n] = True
    solid = ~space
    start = solid.copy()
    start[1:] &= space[:-1] | cut[1:n]
    end = solid
    end[:-1] &= space[1:] | cut[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of units (bytes or code points)."""
    up, down = powers(len(units) + 1)
    total = np.zeros(len(units) + 1, dtype=np.uint64)
    each = units.astype(np.uint64)
    each += np.uint64(1)
    each *= up[:-1]
    np.cumsum(each, out=total[1:])
    return mix((total.take(ends) - total.take(starts)) * down.take(starts))


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (maximal runs without space, tab, LF, VT, FF, CR) of rows, and where each row's begin."""
    units = data[offsets[0] : offsets[-1]]
    first = offsets[:-1] - offsets[0]
    starts, ends = spans(SPACE[units], first[first < len(units)])
    return hashes(LOWER[units] if lower else units, starts, ends), np.append(np.searchsorted(starts, first), len(starts))


#: Letters and digits of ASCII and all that is beyond it.
TERM = np.zeros(256, dtype=bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of a span up to which checksums are taken for many spans at once.
SHORT = 64


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of rows with A-Z in lower case, starts and ends of their terms (maximal runs of ASCII letters, digits and all
    beyond ASCII), and where each row's terms begin."""
    units = data[offsets[0] : offsets[-1]]
    first = offsets[:-1] - offsets[0]
    starts, ends = spans(~TERM[units], first[first < len(units)])
    return LOWER[units], starts, ends, np.append(np.searchsorted(starts, first), len(starts))


def crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = np.where(value & np.uint32(1), (value >> np.uint32(1)) ^ np.uint32(0xEDB88320), value >> np.uint32(1))
    return value


CRC = crc_table()


def crc32s(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """zlib.crc32 of each span of bytes: a table look-up a byte for all spans that are longer, the longest first."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, SHORT + 1).astype(np.int16), kind="stable")
    at, size = starts[order], size[order]
    out = np.full(len(order), 0xFFFFFFFF, dtype=np.uint32)
    longer = int(np.searchsorted(-size, -SHORT, side="left"))
    left = np.append(np.cumsum(np.bincount(np.minimum(size, SHORT), minlength=SHORT + 1)[::-1])[::-1], 0)  # spans of so many bytes or more
    for k in range(SHORT):
        n = int(left[k + 1])
        if n == longer:
            break
        x = out[longer:n]
        out[longer:n] = CRC[(x ^ units[at[longer:n] + k]) & np.uint32(255)] ^ (x >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in range(longer):
        out[i] = zlib.crc32(units[at[i] : at[i] + size[i]])
    back = np.empty_like(out)
    back[order] = out
    return back
