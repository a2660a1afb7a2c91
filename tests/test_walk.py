"""The walk of a vault in tasks, and an ingest that lists once and keeps no paths."""

import os

import pytest

from inkwell.plans import ingest as plan
from inkwell.plans.ingest import Embedding, ingest
from inkwell.sources import walk as own
from inkwell.sources.index import Index
from inkwell.sources.markdown import Chunking, Parsing, listing

PARSING, EMBEDDING = Parsing(Chunking(20, 2, 40)), Embedding(8)


@pytest.fixture
def root(tmp_path):
    root = tmp_path / "vault"
    for path in ("a.md", "B.MD", "_x/.hidden.md", "deep/er/and/deeper/c.md", "deep/d.txt", "_x/ü.md"):
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(f"note {path}")
    (root / "empty").mkdir()
    os.symlink(root / "deep", root / "linked")
    os.symlink(root / "a.md", root / "l.md")
    return str(root)


def test_rounds_list_what_a_walk_lists(spark, root, tmp_path):
    notes, unread = own.walk(spark, root, str(tmp_path / "staged"))
    assert sorted(r[0] for r in notes.collect()) == listing(root)[0] and unread.isEmpty()
    found = {r["path"]: bytes(r["content"]).decode() for r in own.contents(notes, root).collect()}
    assert found == {p: f"note {p}" for p in listing(root)[0]}
    gone = own.contents(spark.createDataFrame([("no.md",), ("l.md",), ("../a.md",), ("deep/d.txt",)], "path string"), root).collect()
    assert all(r["content"] is None and r["error"] for r in gone)
    notes, unread = own.walk(spark, str(tmp_path / "absent"), str(tmp_path / "staged2"))
    assert notes.isEmpty() and [tuple(r) for r in unread.collect()] == [(".", "FileNotFoundError")]


def test_ingest_lists_once_and_reads_what_changed(spark, root, tmp_path, monkeypatch):
    index, walks = Index(spark, str(tmp_path / "index"), buckets=2), []
    monkeypatch.setattr(plan, "walk", lambda *a: (walks.append(1), own.walk(*a))[1])
    first = ingest(index, root, PARSING, EMBEDDING)
    assert (first["discovered"], first["ingested"], first["removed"], first["discovery_complete"], len(walks)) == (5, 5, 0, True, 1)
    (tmp_path / "vault" / "a.md").write_text("changed")
    os.remove(tmp_path / "vault" / "B.MD")
    read = []
    monkeypatch.setattr(plan, "contents", lambda paths, root: (read.extend(r[0] for r in paths.select("path").collect()), own.contents(paths, root))[1])
    second = ingest(index, root, PARSING, EMBEDDING)
    assert read == ["a.md"] and (second["discovered"], second["ingested"], second["skipped"], second["removed"]) == (4, 1, 3, 1)


def test_an_unread_folder_removes_nothing(spark, root, tmp_path, monkeypatch):
    index = Index(spark, str(tmp_path / "index"), buckets=2)
    ingest(index, root, PARSING, EMBEDDING)
    os.remove(tmp_path / "vault" / "B.MD")

    def partly(*arguments):
        notes, _ = own.walk(*arguments)
        return notes.filter("not path like 'deep%'"), spark.createDataFrame([("deep", "PermissionError")], "path string, error string")

    monkeypatch.setattr(plan, "walk", partly)
    found = ingest(index, root, PARSING, EMBEDDING)
    assert not found["discovery_complete"] and found["removed"] == 0 and found["unresolved_errors"] == 1
    assert index.table("documents").count() == 5
    assert [(r["source_path"], r["stage"], r["error_details"]) for r in index.table("errors").collect()] == [("deep", "discover", "PermissionError")]
