"""Importance resampling against a slow version from its definition."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkwell.llm import resample
from inkwell.llm._tables import stash
from tests.llm.test_operators import rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def found_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def runs(text, most=1):
    own = found_words(text)
    return [" ".join(own[i : i + n]) for n in range(1, most + 1) for i in range(len(own) - n + 1)]


def slow(docs, target, percent=10, least=20, most=1):
    """doc_id, n_features, weight, score of all rows, and the drawn ones' (score, id) in order."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10000
    s, t = (Counter(bucket(f) for _, x in table for f in runs(x, most)) for table in (docs, target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000))))
    out, fit = [], []
    for i, x in docs:
        own = [gain(bucket(f)) for f in runs(x, most)]
        weight = sum(own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(own), weight, score))
        if len(found_words(x)) >= least:
            fit.append((-score, i is None, i or 0))
    return Counter(out), sorted(fit)[: percent * len(fit) // 100]


@pytest.mark.parametrize(("percent", "most"), [(10, 1), (60, 3)])
def test_whole_result_is_the_slow_one(spark, documents, edge, small, percent, most):
    target = spark.read.parquet(f"{small}/benchmark.parquet")
    for docs in (documents, edge):
        found = rows(resample.resample(docs, target, percent=percent, run=most))
        wanted, drawn = slow([(r["doc_id"], r["text"]) for r in docs.collect()], [(0, r["text"]) for r in target.collect()], percent, 20, most)
        assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in found) == wanted
        ranked = sorted((r["rank"], -r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in found if r["rank"] is not None)
        assert [r[0] for r in ranked] == list(range(1, len(drawn) + 1))
        assert [r[1:] for r in ranked] == drawn


def test_empty_tables(spark, documents, empty):
    assert rows(resample.resample(empty, empty)) == []
    found = rows(resample.resample(documents, empty))
    assert len(found) == documents.count() and sum(r["rank"] is not None for r in found) == len(slow([(r["doc_id"], r["text"]) for r in documents.collect()], [])[1])


@pytest.mark.parametrize("kind", ["long", "string", "date"])
def test_selection_finds_every_place(spark, kind):
    r = random.Random(3)
    table = spark.createDataFrame([(r.choice([None, *range(40)]), r.randrange(6), n) for n in range(400)], "id int, score long, n int")
    own = {"long": F.col("id").cast("long"), "string": F.concat(F.lit("it's \\ "), F.col("id")), "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("id"))}[kind]
    table = stash(table.select(own.alias("id"), "score", F.monotonically_increasing_id().alias("_row")), "rows")
    wanted = table.orderBy(*resample.order("id")).collect()
    for k in (1, 199):
        assert resample.kth(table, "id", k, seed=k)["_row"] == wanted[k - 1]["_row"]
    assert resample.kth(table, "id", 0) is None and resample.kth(table, "id", 401) is None


def test_target_documents_weigh_more(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice(words) for _ in range(30)) for words in (["sun", "moon", "star"], ["tax", "levy", "fee"]) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {x["doc_id"]: x["weight"] for x in rows(resample.resample(docs, docs.filter("doc_id < 5")))}
    assert min(found[i] for i in range(50)) > max(found[i] for i in range(50, 100))
