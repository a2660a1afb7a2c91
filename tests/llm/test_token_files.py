"""Token files: round trips, order and places against a fresh tokenizer, damage."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkwell.llm import mixcoder, token_files
from inkwell.llm._tables import stash
from inkwell.llm.entry import tokenizer_path
from tests.llm.test_operators import rows


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 299), max_size=3000), st.sampled_from([300, 65536, 70000, 1 << 20]))
def test_blocks_come_back(ids, vocabulary):
    assert mixcoder.decode(mixcoder.encode(np.array(ids, dtype=np.int64), vocabulary)).tolist() == ids


@pytest.mark.parametrize("kind", ["one id", "two in turn", "all once", "end of the vocabulary", "skewed"])
def test_long_blocks_come_back(kind):
    r = np.random.default_rng(1)
    ids = {"one id": np.full(100_000, 7), "two in turn": np.tile([3, 50256], 40_000), "all once": r.permutation(50257), "end of the vocabulary": np.full(70_001, 50256), "skewed": np.minimum(r.zipf(1.2, 200_000), 50257) - 1}[kind]
    block = mixcoder.encode(ids, 50257)
    assert (mixcoder.decode(block) == ids).all()
    if kind in ("one id", "two in turn", "end of the vocabulary"):
        assert len(block) < len(ids) / 4  # of 2 bytes an id
    if kind == "skewed":  # at most the entropy of single ids and what the frequencies cost to learn
        n = np.bincount(ids)
        n = n[n > 0]
        assert len(block) * 8 < 1.05 * (n * -np.log2(n / n.sum())).sum() + 24 * len(n) + 64 * mixcoder.LANES


def test_context_is_used():
    """After each id comes one of its own; single ids are of equal share."""
    r = np.random.default_rng(2)
    follow, ids = r.permutation(1000), [0]
    for _ in range(150_000):
        ids.append(int(follow[ids[-1]]) if r.random() < 0.9 else int(r.integers(1000)))
    assert len(mixcoder.encode(np.array(ids), 50257)) * 8 / len(ids) < 4  # order 0 alone: 10


def test_damage_is_told():
    block = bytearray(mixcoder.encode(np.arange(1000), 50257))
    for at in (0, 8, 20, 500, len(block) - 1):
        bad = bytearray(block)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            mixcoder.decode(bytes(bad))
    for bad in (b"", bytes(block[:-1]), bytes(block[:24])):
        with pytest.raises(ValueError):
            mixcoder.decode(bad)


def expected(docs):
    from tokenizers import Tokenizer

    own, out = Tokenizer.from_file(tokenizer_path()), []
    for r in docs.select("doc_id", "text").collect():
        ids = np.array([*own.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        out.append((r["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))


def test_files_hold_every_document_in_order(documents, edge):
    for docs in (documents, edge):
        found = sorted(rows(token_files.written_and_read(docs, tokenizer_path())), key=lambda r: r["start"])
        assert [(r["doc_id"] is None, r["doc_id"] or 0) for r in found] == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in found)
        assert [r["start"] for r in found] == np.cumsum([0, *(r["n_tokens"] for r in found)])[:-1].tolist()
        assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])) == expected(docs)


def test_small_blocks_ranges_and_ids(spark, documents, empty, tmp_path):
    path = str(tmp_path / "tokens")
    token_files.write_documents(documents, path, tokenizer_path(), block_ids=5000)
    whole = stash(token_files.read_documents(spark, path), "whole")
    assert spark.read.parquet(path).count() > 10
    assert sorted((r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in rows(whole)) == expected(documents)
    middle = documents.orderBy("doc_id").collect()[documents.count() // 2]["doc_id"]
    part = stash(token_files.read_documents(spark, path, where=(F.col("least") <= middle) & (F.col("most") >= middle)), "part")
    assert 0 < part.count() < whole.count() / 2 and part.filter(F.col("doc_id") == middle).count() == whole.filter(F.col("doc_id") == middle).count()
    assert rows(part.join(whole, ["doc_id", "start", "n_tokens"], "left_anti")) == []
    assert rows(token_files.written_and_read(empty, tokenizer_path())) == []


def test_a_damaged_file_fails(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    token_files.write_documents(docs, str(tmp_path / "a"), tokenizer_path())
    bad = spark.read.parquet(str(tmp_path / "a")).withColumn("payload", F.expr("concat(substr(payload, 1, length(payload) - 1), X'00')"))
    bad.write.parquet(str(tmp_path / "b"))
    with pytest.raises(Exception, match="block 0"):
        token_files.read_documents(spark, str(tmp_path / "b")).collect()
