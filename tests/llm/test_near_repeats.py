from pyspark.sql import functions as F

from inkwell.llm import near
from tests.llm.conftest import words
from tests.llm.test_operators import rows, shingle_set


def test_copies_with_a_line_repeated_a_thousand_times_are_found(spark):
    docs = []
    for k in range(8):
        base, line = words(500 + k, 400), words(900 + k, 90)
        docs += [(2 * k, " ".join(base)), (2 * k + 1, " ".join([*base, *(line * 1000)]))]
        a, b = (shingle_set(t) for _, t in docs[-2:])
        assert 0.8 <= len(a & b) / len(a | b) < 0.82
    found = rows(near.near_classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)))
    assert sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in found) == [(i, i // 2 * 2, 2) for i in range(16)]


def test_plain_bands_are_those_of_the_set(spark):
    base = words(5, 60)
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(base * 2 + base[:4])), (3, " ".join(base + base[:4]))], "doc_id long, text string")
    found = {r["id"]: r for r in rows(near.sketches(docs, "doc_id", "text").select("id", "bits", "nibbles", F.size("bands").alias("n"), "bands"))}
    assert found[2]["bits"] == found[3]["bits"] and found[2]["nibbles"] == found[3]["nibbles"] and set(found[3]["bands"]) <= set(found[2]["bands"])
