"""Poisson arrivals of weighted elements at registers, with early termination, for many documents at once.

Element e of weight w sends arrivals at rate w; each goes to a random register. The k-th arrival's delay and register
are functions of e and k alone. In each register, elements' first arrivals are then independent exponential times, so
that the earliest element is drawn in proportion to its weight, and the l earliest are a random order's first l."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from inkwell.llm._text import mix

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def arrivals(elements: np.ndarray, weights: np.ndarray | None, owner: np.ndarray, until: np.ndarray, registers: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All arrivals before the owner's time: index of the element, register (a power of 2 of them), time."""
    at, found = np.arange(len(elements)), []
    now, state = np.zeros(len(elements)), elements.copy()
    ends = until[owner]
    while len(at):
        many = max(1, FEW // len(at))  # where few elements are left, each sends several at once
        x = mix(state[:, None] + GOLDEN * np.arange(1, many + 1, dtype=np.uint64))
        time = -np.log((x >> np.uint64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54)
        if weights is not None:
            time /= weights[at][:, None]
        time[:, 0] += now
        if many > 1:
            np.cumsum(time, axis=1, out=time)
        alive = time < ends[:, None]  # ends with the first that is too late
        found.append((np.repeat(at, alive.sum(axis=1)), (x[alive] & np.uint64(registers - 1)).astype(np.int64), time[alive]))
        on = alive[:, -1]
        at, now, state, ends = at[on], time[on, -1], state[on] + GOLDEN * np.array([many], dtype=np.uint64), ends[on]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


#: Arrivals that are held at once, about, and those that a step makes at least.
HELD, FEW = 1 << 19, 1 << 13


def settle(n: int, first: np.ndarray, each: float, fill: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
    """Calls fill(rows, until) for all n rows, then with doubled times for those that it says are not done; for so many
    rows at once that their arrivals, of which a row has about `each`, stay few."""
    until, block = first.copy(), max(1, int(HELD / each))
    for a in range(0, n, block):
        rows = np.arange(a, min(a + block, n))
        while len(rows):
            rows = rows[~fill(rows, until)]
            until[rows] *= 2


def pick(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the elements of the given rows, and each one's row as a place in rows."""
    n = starts[rows + 1] - starts[rows]
    total = np.cumsum(n)
    return np.repeat(starts[rows] - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0), np.repeat(np.arange(len(rows)), n)
