import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.operators.policy import Policy, decision, python_decision, secret_scan_decision
from inkwell.operators.search import Search, SearchConfig, SearchError, tools

NOTES = [
    ("journal/day.md", '{"date": "2026-03-13"}', "A quiet day with notes."),
    ("projects/atlas/decision.md", '{"project_id": "atlas", "status": "done"}', "We chose the migration to files. The plan works."),
    ("projects/atlas/overview.md", '{"project_id": "atlas", "nested": {"count": 3}, "flag": true, "empty": null}', "The plan of atlas and its goals."),
    ("projects/atlas/retro.md", '{"project_id": "custom-atlas"}', "What went well: the plan, the plan and the team."),
    ("reference/files.md", '{"title": "Files"}', "Files are simple."),
]


@pytest.fixture(scope="module")
def index(spark):
    docs = spark.createDataFrame(NOTES, "path string, metadata_json string, body string").select("*", T.content_hash("body").alias("body_sha256"), F.lit("m").alias("embedding_model"), F.lit("1").alias("embedding_version")).cache()
    chunks = docs.select(T.chunk_id(F.col("path"), F.lit(0)).alias("chunk_id"), F.col("path").alias("source_path"), F.lit(0).alias("ordinal"), F.col("body").alias("content"), F.col("body_sha256").alias("content_sha256"), T.tokens("body").alias("tokens"), F.array(F.size(T.tokens("body")).cast("float"), F.lit(1.0).cast("float")).alias("embedding")).cache()
    attributes = docs.filter("path like '%overview%'").select(F.lit("document").alias("domain"), F.col("body_sha256").alias("sha256"), F.lit('{"review": {"ok": true, "count": 3}, "private": "x", "secret_scan": {"risk_score": 0, "llm_status": "ok"}}').alias("attributes_json")).cache()
    return docs, chunks, attributes


CONFIG = SearchConfig(embedding_space="s", embedding_model="m", embedding_version="1", dimensions=2, document_attribute_keys=("review",), candidate_limit=50, max_content_chars=20)


@pytest.fixture
def search(index):
    return Search(*index, CONFIG, embed=lambda texts: [[float(len(t.split())), 1.0] for t in texts])


def paths(page):
    return [r["source_file"] for r in page.collect()["results"]]


def test_pages(search):
    one = search.metadata_search({"project_id": "atlas"}, limit=1).collect()
    assert len(one["results"]) == 1 and one["truncated"] and one["next_offset"] == 1
    two = search.metadata_search({"project_id": "atlas"}, limit=1, offset=1).collect()
    assert two["results"][0]["source_file"].endswith("overview.md") and two["next_offset"] is None
    assert two["results"][0]["document_attributes"] == {"review": '{"count":3,"ok":true}'}


def test_full_text_is_a_literal_phrase(search):
    assert paths(search.full_text_search("migration")) == ["projects/atlas/decision.md"]
    assert paths(search.full_text_search('migration" OR "files')) == []
    assert paths(search.full_text_search("the plan"))[0] == "projects/atlas/retro.md"
    assert paths(search.full_text_search("!!!")) == []
    row = search.full_text_search("migration").collect()["results"][0]
    assert row["content"] == NOTES[1][2][:20] and row["content_truncated"] and row["score"] < 0


def test_vectors(search):
    page = search.vector_search([4.0, 1.0], "s", limit=5).collect()["results"]
    assert [r["distance"] for r in page] == sorted(r["distance"] for r in page)
    for bad in ([1.0], [0.0, 0.0], [float("nan"), 1.0], [True, 1.0], [1e300, 1.0]):
        with pytest.raises(ValueError):
            search.vector_search(bad, "s")
    with pytest.raises(ValueError):
        search.vector_search([1.0, 1.0], "other")


def test_zero_vectors_and_other_spaces_fail(index):
    docs, chunks, attributes = index
    zero = chunks.withColumn("embedding", F.array(F.lit(0.0), F.lit(0.0)).cast("array<float>"))
    with pytest.raises(Exception, match="no distance"):
        Search(docs, zero, attributes, CONFIG).vector_search([1.0, 1.0], "s").collect()
    with pytest.raises(SearchError):
        Search(docs.withColumn("embedding_model", F.lit("else")), chunks, attributes, CONFIG).vector_search([1.0, 1.0], "s")


def test_hybrid_is_reciprocal_rank_fusion(search):
    rows = search.hybrid_knowledge_search("one two three", "the plan").collect()["results"]
    for r in rows:
        assert abs(r["relevance"] - sum(1 / (60 + r[k]) for k in ("fts_rank", "vector_rank") if r[k])) < 1e-12
    assert [r["relevance"] for r in rows] == sorted((r["relevance"] for r in rows), reverse=True)
    assert paths(search.semantic_search("a b c d e f g"))[0] is not None


def test_distinct_and_chunk(search):
    assert [(r["kind"], r["value"]) for r in search.get_distinct_metadata("project_id").collect()["results"]] == [("text", "atlas"), ("text", "custom-atlas")]
    assert [(r["kind"], r["value"]) for r in search.get_distinct_metadata("empty").collect()["results"]] == [("null", None)]
    found = search.full_text_search("migration").collect()["results"][0]
    assert search.get_chunk(found["chunk_id"])["source_file"] == found["source_file"] and search.get_chunk("0" * 24) is None
    with pytest.raises(ValueError):
        search.get_chunk("x")


@pytest.mark.parametrize(("condition", "n"), [({"review.count": 3}, 1), ({"review.count": {"op": "exists", "value": False}}, 4), ({"review.count": {"op": "is_null", "value": True}}, 0)])
def test_attribute_filters(search, condition, n):
    assert len(paths(search.metadata_search(document_attribute_filters=condition))) == n


def test_only_exposed_keys_may_be_filtered(search):
    with pytest.raises(ValueError):
        search.metadata_search(document_attribute_filters={"private": "x"})


def test_policies(index):
    hidden = Policy(document=lambda: decision(F.when(F.col("path").contains("retro"), "hide").otherwise("allow")))
    rows = Search(*index, CONFIG, hidden).full_text_search("the plan").collect()["results"]
    assert [r["source_file"] for r in rows] == ["projects/atlas/decision.md", "projects/atlas/overview.md"] and {r["score"] for r in rows} == {None}
    nulled = Policy(document=lambda: decision("null", source=False))
    row = Search(*index, CONFIG, nulled).full_text_search("migration").collect()["results"][0]
    assert row["content"] is None and row["content_truncated"] is False and row["source_file"] is None
    closed = Policy(document=lambda: decision(metadata=F.col("path").contains("overview")))
    assert paths(Search(*index, CONFIG, closed).metadata_search({"project_id": "atlas"})) == ["projects/atlas/overview.md"]
    assert len(paths(Search(*index, CONFIG, closed).metadata_search({}))) == 5
    python = Policy(document=lambda: python_decision(lambda p: {"action": "hide" if p.startswith("journal") else "allow"}, "path"))
    assert len(paths(Search(*index, CONFIG, python).metadata_search())) == 4
    scanned = Policy(document=lambda: secret_scan_decision("document_attributes_json"))
    assert paths(Search(*index, CONFIG, scanned).metadata_search()) == ["projects/atlas/overview.md"]
    rewritten = Policy(rewrite=lambda tool, a: a | {"limit": min(a["limit"], 2)})
    assert len(paths(Search(*index, CONFIG, rewritten).metadata_search(limit=10))) == 2
    with pytest.raises(ValueError):
        Search(*index, CONFIG, Policy(rewrite=lambda tool, a: {})).metadata_search()


def test_guards_and_tools(search, index):
    for bad in (0, 51, True, "1"):
        with pytest.raises(ValueError):
            search.metadata_search(limit=bad)
    for bad in ("", "   ", "x" * 1001):
        with pytest.raises(ValueError):
            search.full_text_search(bad)
    with pytest.raises(ValueError):
        search.metadata_search(offset=10_001)
    assert set(tools(search)) == {"metadata_search", "full_text_search", "get_distinct_metadata", "get_chunk"}
    with pytest.raises(ValueError):
        tools(Search(*index), ("vector_search",))
    with pytest.raises(ValueError):
        SearchConfig(embedding_space="s")
