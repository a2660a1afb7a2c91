from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from inkwell.llm._tables import stash, text_hash
from inkwell.llm.mixing import mix
from inkwell.llm.stages import keep_marked, repeat_mixed
from tests.llm.test_operators import brute_classes, brute_exact, check_mix, rows


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    held = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stash(stage(spark, docs, small), name)
        held[name] = (rows(docs), rows(out))
        if name != "packing":
            assert out.columns == columns
        docs = out
    before, after = held["quality"]
    assert 0.6 * len(before) < len(after) < len(before)
    before, after = held["exact_dedup"]
    assert len(after) == len({x.split(", ")[-1] for x in brute_exact(before)}) and len({d["doc_id"] for d in after}) == len(after)
    before, after = held["near_dedup"]
    assert sorted(d["doc_id"] for d in after) == sorted({int(x.strip("()").split(", ")[1]) for x in brute_classes(before)})
    before, after = held["mixing"]
    copies = Counter(d["doc_id"] for d in after)
    found = rows(mix(spark.createDataFrame(before, spark.read.parquet(f"{small}/documents.parquet").schema)))
    check_mix(found, before)
    assert {r["doc_id"]: r["copies"] for r in found if r["copies"]} == dict(copies)
    before, after = held["packing"]
    assert Counter(r["doc_id"] for r in after if r["piece"] == 0) == copies


def test_decisions_for_alike_rows(spark):
    docs = spark.createDataFrame([(1, "a", "s"), (1, "a", "s"), (1, "b", "s"), (None, "c", None), (None, "c", None), (2, None, "s")], "doc_id long, text string, source string")
    marks = docs.withColumn("text_hash", text_hash("text")).withColumn("n", F.lit(1))
    first = marks.filter("text in ('b') or doc_id = 2").withColumn("kept", F.lit(True)).drop("n")
    torn = marks.filter("text in ('a', 'c')").groupBy("doc_id", "text", "source", "text_hash").agg(F.count("n").alias("n")).select("doc_id", "text", "source", "text_hash", F.explode(F.array(F.lit(True), F.lit(False))).alias("kept"))
    found = keep_marked(docs, first.unionByName(torn))
    assert sorted(map(str, (tuple(r.values()) for r in rows(found)))) == sorted(map(str, [(1, "a", "s"), (1, "b", "s"), (None, "c", None), (2, None, "s")]))
    mixed = marks.withColumn("copies", F.when(F.col("text") == "a", 2).when(F.col("text") == "b", 0).otherwise(1).cast("long"))
    counts = Counter(str(r["text"]) for r in rows(repeat_mixed(docs, mixed)))
    assert counts == {"a": 4, "c": 2, "None": 1}


def test_the_whole_pipeline(spark, small):
    found = rows(corpus_pipeline.run(spark, small))
    assert found and max(Counter(r["sequence_id"] for r in found).values()) >= 1
    assert all(r["length"] <= 2048 for r in found)


def test_stages_of_edge_and_empty_tables(spark, edge, empty, small):
    """Null, empty and long texts, repeated rows, and columns named as what the stages use inside."""
    clashing = edge.withColumns({c: F.lit(c) for c in ("_host", "_path", "_p", "_y", "_n", "_found", "_new", "copies", "n", "total", "times", "key", "_text", "_id", "text_hash", "host_posterior", "posterior")})
    for name, stage in corpus_pipeline.STAGES:
        assert rows(stage(spark, empty, small)) == []
        before, found = Counter(map(str, rows(clashing))), stage(spark, clashing, small)
        if name == "packing":
            assert {r["doc_id"] for r in rows(found)} == {r["doc_id"] for r in rows(edge)}
            continue
        assert found.columns == clashing.columns
        after = Counter(map(str, rows(found)))
        assert set(after) <= set(before) and (name == "mixing" or not after - before)


def test_decisions_too_many_to_be_sent(spark, monkeypatch):
    from inkwell.llm import stages

    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.lit("s").alias("source"))
    marks = docs.withColumns({"text_hash": text_hash("text"), "kept": F.col("doc_id") % 3 == 0, "copies": F.col("doc_id") % 4})
    for places, sent in ((64, 250_000), (64, 0), (1 << 26, 0)):  # full bitmaps, too large tables
        monkeypatch.setattr(stages, "PLACES", places)
        monkeypatch.setattr(stages, "SENT", sent)
        assert sorted(r["doc_id"] for r in rows(keep_marked(docs, marks))) == list(range(0, 500, 3))
        assert Counter(r["doc_id"] for r in rows(repeat_mixed(docs, marks))) == +Counter({k: k % 4 for k in range(500)})
