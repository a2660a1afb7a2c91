"""File events as differences of listings, bursts that end by the clock, and a watch that reconciles while idle."""

import os
import time

import pytest

from inkwell.plans.ingest import Embedding
from inkwell.sources.index import Index
from inkwell.sources.markdown import Chunking, Parsing
from inkwell.streaming.events import EventReader, differences
from inkwell.streaming.settle import rocks, settled
from inkwell.streaming.watch import actions, vault_events, watch

PARSING, EMBEDDING = Parsing(Chunking(20, 2, 40)), Embedding(8)


def write(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as f:
        f.write(text)


def until(condition, seconds=90.0):
    end = time.monotonic() + seconds
    while not condition():
        assert time.monotonic() < end
        time.sleep(0.2)


def test_differences():
    old = {"a.md": [1, 5, 10], "b.md": [1, 5, 11], "c.md": [1, 5, 12], "d.md": [2, 2, 13]}
    new = {"a.md": [1, 5, 10], "x/b.md": [1, 5, 11], "c.md": [3, 5, 12], "e.md": [2, 2, 14]}
    assert differences(old, new) == [("moved", "b.md", "x/b.md"), ("deleted", "d.md", None), ("created", "e.md", None), ("modified", "c.md", None)]
    assert differences(new, new) == [] and differences({}, {"a.md": [1, 1, 1]}) == [("created", "a.md", None)]


def test_listings_are_offsets(tmp_path):
    root, state = str(tmp_path / "vault"), str(tmp_path / "state")
    write(root, "a.md", "1")
    os.symlink(os.path.join(root, "a.md"), os.path.join(root, "link.md"))
    own = EventReader(root, state)
    first = own.initialOffset()
    assert own.latestOffset() == first
    write(root, "sub/b.MD", "2")
    write(root, "c.txt", "no")
    second = own.latestOffset()
    rows = lambda reader, a, b: [r[2:5] for p in reader.partitions(a, b) for r in reader.read(p)]
    assert rows(own, first, second) == [("created", "sub/b.MD", None)]
    again = EventReader(root, state)  # after a restart, before the batch was committed
    assert again.latestOffset() == second and rows(again, first, second) == rows(own, first, second)
    again.commit(second)
    assert again.initialOffset() == second and rows(again, second, second) == []
    os.rename(os.path.join(root, "a.md"), os.path.join(root, "z.md"))
    assert rows(again, second, again.latestOffset()) == [("moved", "a.md", "z.md")]


def test_restarts_give_no_event_twice(spark, tmp_path):
    root, seen = str(tmp_path / "vault"), []
    write(root, "a.md", "1")

    def run():
        query = vault_events(spark, root, str(tmp_path / "state")).writeStream.foreachBatch(lambda rows, _: seen.extend((r["kind"], r["path"]) for r in rows.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
        return query

    query = run()
    until(lambda: os.path.isdir(tmp_path / "state") and os.listdir(tmp_path / "state"))
    write(root, "b.md", "2")
    until(lambda: seen)
    query.stop()
    write(root, "c.md", "3")
    query = run()
    until(lambda: len(seen) > 1)
    time.sleep(1)
    query.stop()
    assert seen == [("created", "b.md"), ("created", "c.md")]


def test_a_burst_ends_by_the_clock(spark, tmp_path):
    """The only burst there is comes through, with its last action, though nothing follows it."""
    folder, seen = tmp_path / "events", []
    folder.mkdir()
    from inkwell.streaming.watch import read_events

    with rocks(spark):
        query = settled(actions(read_events(spark, str(folder))), 1.0).writeStream.outputMode("update").foreachBatch(lambda rows, _: seen.extend(tuple(r) for r in rows.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="100 milliseconds").start()
    own = '{"seq": %d, "ts": "2024-01-01T00:00:0%dZ", "kind": "%s", "path": "a.md", "is_directory": false}'
    (folder / "1.json").write_text("\n".join([own % (1, 1, "created"), own % (3, 3, "deleted"), own % (2, 2, "modified")]))
    until(lambda: seen)
    time.sleep(2)
    query.stop()
    assert seen == [("a.md", "delete", 3)]


def test_a_watch_observes_scans_and_reconciles(spark, tmp_path):
    root, index = str(tmp_path / "vault"), Index(spark, str(tmp_path / "index"), buckets=2)
    write(root, "a.md", "before the watch")
    query = watch(index, root, vault_events(spark, root, str(tmp_path / "state")), str(tmp_path / "c"), PARSING, EMBEDDING, "100 milliseconds", quiet=0.2, reconcile=3.0, scan_first=True)
    paths = lambda: {r["path"] for r in index.table("documents").collect()} if index.version() else set()
    try:
        until(lambda: paths() == {"a.md"})
        write(root, "b.md", "an event")
        until(lambda: "b.md" in paths())
        version = index.version()
        until(lambda: index.version() > version)  # a scan without any event
        os.remove(os.path.join(root, "a.md"))
        until(lambda: paths() == {"b.md"})
    finally:
        query.stop()
    assert query.exception() is None


def test_a_source_needs_its_state(spark, tmp_path):
    from inkwell.streaming.events import EventSource

    spark.dataSource.register(EventSource)
    with pytest.raises(Exception, match="state"):
        spark.readStream.format("vault_events").load(str(tmp_path)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination(30)
