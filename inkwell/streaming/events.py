"""File events as a stream: what differs between two listings of a vault.

An offset names a listing that was kept; the rows between two offsets are the files that were created, modified, deleted or
moved. So a batch that is run again, after a restart too, gives the same rows, and what one batch gave no other gives. A file is
the same if its time of change, size and inode are; one that has another name only has moved."""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

EVENTS = "seq long, ts timestamp, kind string, path string, destination string, is_directory boolean"
#: Events of a task.
PER_TASK = 10_000


def listed(root: str) -> dict[str, list[int]]:
    """Time of change, size and inode of each Markdown file by its relative path; links aren't followed, folders that can't
    be read are an error, as nothing is known of what is in them."""
    found: dict[str, list[int]] = {}
    folders = [""]
    while folders:
        folder = folders.pop()
        with os.scandir(os.path.join(root, folder)) as entries:
            for e in entries:
                path = f"{folder}/{e.name}" if folder else e.name
                try:
                    if e.is_dir(follow_symlinks=False):
                        folders.append(path)
                    elif e.is_file(follow_symlinks=False) and e.name.lower().endswith(".md"):
                        s = e.stat(follow_symlinks=False)
                        found[path] = [s.st_mtime_ns, s.st_size, s.st_ino]
                except FileNotFoundError:  # gone while it was listed
                    pass
    return found


def differences(old: dict[str, list[int]], new: dict[str, list[int]]) -> list[tuple[str, str, str | None]]:
    """kind, path and destination of what happened from one listing to another, moves first."""
    gone, come = {p: old[p] for p in old.keys() - new.keys()}, {p: new[p] for p in new.keys() - old.keys()}
    places: dict[tuple, list[str]] = {}
    for p in sorted(come, reverse=True):
        places.setdefault(tuple(come[p]), []).append(p)
    moved = [("moved", p, places[tuple(gone[p])].pop()) for p in sorted(gone) if places.get(tuple(gone[p]))]
    left, there = {p for _, p, _ in moved}, {d for _, _, d in moved}
    rest = [("deleted", p, None) for p in sorted(gone.keys() - left)] + [("created", p, None) for p in sorted(come.keys() - there)]
    return moved + rest + [("modified", p, None) for p in sorted(old.keys() & new.keys()) if old[p] != new[p]]


class Events(InputPartition):
    def __init__(self, rows: list[tuple]):
        super().__init__(0)
        self.rows = rows


class EventReader(DataSourceStreamReader):
    """root: the vault; state: a folder of the driver's for listings, one for each stream. The first listing is what there
    is when the stream starts first: later changes are events, and a scan that follows finds the rest."""

    def __init__(self, root: str, state: str):
        self.root, self.state = os.path.realpath(root), state
        os.makedirs(state, exist_ok=True)

    def _name(self, number: int) -> str:
        return os.path.join(self.state, f"{number:012d}.json")

    def _numbers(self) -> list[int]:
        return sorted(int(m[1]) for n in os.listdir(self.state) if (m := re.fullmatch(r"(\d{12})\.json", n)))

    def _load(self, number: int) -> dict:
        with open(self._name(number), encoding="utf-8") as f:
            return json.load(f)

    def _keep(self, number: int, files: dict[str, list[int]]) -> None:
        beside = self._name(number) + ".new"
        with open(beside, "w", encoding="utf-8") as f:
            json.dump({"at": time.time(), "files": files}, f)
        os.replace(beside, self._name(number))

    def initialOffset(self) -> dict:
        if not self._numbers():
            self._keep(0, listed(self.root))
        return {"listing": self._numbers()[0]}

    def latestOffset(self) -> dict:
        known = self._numbers()
        if not known:
            return self.initialOffset()
        try:
            files = listed(self.root)
        except OSError:  # a folder that can't be read tells nothing of what is in it
            return {"listing": known[-1]}
        if files != self._load(known[-1])["files"]:
            self._keep(known[-1] + 1, files)
            return {"listing": known[-1] + 1}
        return {"listing": known[-1]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = []
        old = self._load(start["listing"])
        for number in range(start["listing"] + 1, end["listing"] + 1):
            new = self._load(number)
            rows += [(number * 1_000_000_000 + i, new["at"], *e) for i, e in enumerate(differences(old["files"], new["files"]))]
            old = new
        return [Events(rows[a : a + PER_TASK]) for a in range(0, len(rows), PER_TASK)] or [Events([])]

    def read(self, partition: Events) -> Iterator[tuple]:
        from datetime import UTC, datetime

        for seq, at, kind, path, destination in partition.rows:
            yield seq, datetime.fromtimestamp(at, UTC), kind, path, destination, False

    def commit(self, end: dict) -> None:
        for number in self._numbers():
            if number < end["listing"]:
                os.remove(self._name(number))


class EventSource(DataSource):
    """spark.readStream.format("vault_events").option("state", folder).load(vault). Every node mounts the vault; the listings
    in state are the driver's."""

    @classmethod
    def name(cls) -> str:
        return "vault_events"

    def schema(self) -> str:
        return EVENTS

    def streamReader(self, schema) -> EventReader:
        if "path" not in self.options or "state" not in self.options:
            raise ValueError("vault_events needs a path and a folder for its state")
        return EventReader(self.options["path"], self.options["state"])


__all__ = ["EVENTS", "EventSource", "differences", "listed"]
