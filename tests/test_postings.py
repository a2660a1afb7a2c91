"""Postings and counts that commits keep, and text queries answered from them."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkwell.functions.text import chunk_id, content_hash, tokens
from inkwell.operators import postings, textquery
from inkwell.operators.policy import Policy, decision
from inkwell.operators.search import Search
from inkwell.sources.index import TABLES, Change, Index

WORDS = ["ant", "bee", "cat", "dog", "élan", "fox"]


def rows_of(spark, texts):
    """documents and chunks (one a part between bars) of {path: text}."""
    docs = spark.createDataFrame(list(texts.items()), "path string, body string")
    documents = docs.select("path", content_hash("body").alias("sha256"), F.lit("p").alias("processing_fingerprint"), F.lit('{"k": 1}').alias("metadata_json"), F.lit("m").alias("embedding_model"), F.lit("1").alias("embedding_version"), F.lit("2024-01-01").cast("timestamp").alias("ingested_at"), "body", content_hash("body").alias("body_sha256"))
    each = docs.select(F.col("path").alias("source_path"), F.posexplode(F.split("body", r"\|")).alias("ordinal", "content"))
    chunks = each.select(chunk_id(F.col("source_path"), F.col("ordinal")).alias("chunk_id"), "source_path", "ordinal", "content", content_hash("content").alias("content_sha256"), tokens("content").alias("tokens"), F.array().cast("array<float>").alias("embedding"))
    return documents, chunks


def text(r):
    return "|".join(" ".join(r.choices(WORDS, k=r.randint(0, 12))) for _ in range(r.randint(1, 3)))


@pytest.fixture(scope="module")
def grown(spark, tmp_path_factory):
    """An index after commits that add, replace and remove documents, and the texts it should hold."""
    r, held = random.Random(1), {f"{i}.md": text(random.Random(i)) for i in range(30)}
    index = Index(spark, str(tmp_path_factory.mktemp("grown")), buckets=4)
    documents, chunks = rows_of(spark, held)
    index.commit({"documents": documents, "chunks": chunks})
    for turn in range(6):
        new = {f"{r.randrange(40)}.md": text(r) for _ in range(r.randint(1, 3))}
        gone = r.sample(sorted(held), 2)
        held = {k: v for k, v in held.items() if k not in gone} | new
        documents, chunks = rows_of(spark, new)
        keys = spark.createDataFrame([(k,) for k in {*gone, *new}], "path string")
        index.commit({"documents": Change(keys, documents), "chunks": Change(keys, chunks)})
    return index, held


def test_counts_equal_a_recount(grown, spark):
    index, held = grown
    own = [(path, i, [w.replace("é", "e") for w in part.split()]) for path, body in held.items() for i, part in enumerate(body.split("|"))]
    counts = index.statistics()
    assert (counts.chunks, counts.words) == (len(own), sum(len(w) for *_, w in own))
    assert Counter({r["term"]: r["n"] for r in index.table("terms").groupBy("term").agg(F.sum("chunks").alias("n")).collect()}) == Counter(t for *_, w in own for t in set(w))
    assert Counter((r["term"], r["source_path"], r["ordinal"], r["place"], r["n_words"]) for r in index.table("postings").collect()) == Counter((t, p, i, k, len(w)) for p, i, w in own for k, t in enumerate(w))
    assert index.vacuum() > 0 and index.table("postings").count() == counts.words


def test_a_commit_writes_the_buckets_it_touches(grown, spark):
    index, held = grown
    before = index.manifest()
    path = sorted(held)[0]
    documents, chunks = rows_of(spark, {path: held[path]})
    index.commit({"documents": Change(documents.select("path"), documents), "chunks": Change(documents.select("path"), chunks)})
    after = index.manifest()
    for name in ("chunks", "postings", "terms"):
        assert sum(after["tables"][name].get(b) != f for b, f in before["tables"][name].items()) == 1
    assert after["statistics"] == before["statistics"] and index.document(path).count() == 1


QUERIES = [
    textquery.phrase("cat"), textquery.phrase("Élan fox"), textquery.phrase("ant ant"), textquery.phrase("dog bee cat"), textquery.phrase("nothing"), textquery.phrase("!!!"), textquery.prefix("c"), textquery.prefix("dog e"), textquery.phrase("bee", first=True),
    textquery.all_of(textquery.phrase("ant"), textquery.none_of(textquery.phrase("bee"), textquery.phrase("fox dog"))), textquery.any_of(textquery.phrase("cat dog"), textquery.near(textquery.phrase("ant"), textquery.phrase("fox"), 2)),
    textquery.near(textquery.phrase("ant bee"), textquery.phrase("ant bee"), 1), textquery.all_of(textquery.any_of(textquery.phrase("ant"), textquery.phrase("bee")), textquery.any_of(textquery.phrase("cat"), textquery.none_of(textquery.phrase("dog")))),
]


@pytest.mark.parametrize("number", range(len(QUERIES)))
def test_rows_and_scores_are_those_of_a_scan(grown, number):
    index, _ = grown
    own, query = Search.of(index), QUERIES[number]
    spelled = lambda df: sorted((r["source_path"], r["ordinal"], round(r["score"], 9)) for r in df.collect())
    assert spelled(postings.ranked(own.postings, own.terms, own.statistics, query)) == spelled(textquery.ranked(own.chunks, query))


def test_what_only_leaves_words_out_is_refused(grown):
    with pytest.raises(ValueError):
        postings.matching(grown[0].table("postings"), textquery.any_of(textquery.phrase("ant"), textquery.none_of(textquery.phrase("bee"))))


def test_requests_equal_those_without_postings(grown):
    index, _ = grown
    hide = Policy(document=lambda: decision(F.when(F.col("path").startswith("1"), "hide").otherwise("allow")))
    for policy in (None, hide):
        own = Search.of(index, policy=policy)
        plain = Search(own.documents, own.chunks, own.attributes, policy=policy)
        for words in ("cat", "cat dog", "nothing"):
            pages = [s.full_text_search(words, {"k": 1}, limit=5).collect() for s in (own, plain)]
            assert pages[0] == pages[1]
    top = own.of(index).text_query(textquery.phrase("cat"), limit=3).collect()
    assert [r["score"] for r in top] == sorted(r["score"] for r in top) and len(top) == 3
    with pytest.raises(ValueError):
        own.text_query(textquery.phrase("cat"))


def test_terms_reach_the_scan_and_an_empty_index_answers(grown, spark, tmp_path):
    own = Search.of(grown[0])
    plan = postings.ranked(own.postings, own.terms, own.statistics, textquery.phrase("cat dog"))._jdf.queryExecution().toString()
    assert "In(term, [cat,dog])" in plan and "content" not in plan
    empty = Search.of(Index(spark, str(tmp_path / "none")))
    assert empty.full_text_search("cat").collect()["results"] == []
    assert set(TABLES) == {"documents", "chunks", "attributes", "errors"}
