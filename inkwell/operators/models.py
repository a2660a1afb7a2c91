"""Models that a worker process holds: functions sent to workers name this module, which is imported there, so that what it
holds stays from task to task instead of being copied with each function."""

from __future__ import annotations

from collections.abc import Callable

_held: dict[str, Callable[[str], str]] = {}


def held(name: str, load: Callable[[], Callable[[str], str]]) -> Callable[[str], str]:
    """The model of that name, loaded at the first call in this process."""
    if name not in _held:
        _held[name] = load()
    return _held[name]
