"""Full-text queries against their SQL over words that equal a query's only without diacritics, and texts that words are cut
from in other ways: combining marks, private-use characters, capitals with a lower case of two characters or of two forms."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from inkwell.functions import text as T
from tests.test_queries import spelled

TEXTS = [
    "License íñ of the",
    "The license in of the",
    "the LİCENSE under the",
    "under thé license, under a a a licènse",
    "öf the of thë of the",
    "of\u0301 the licen\u0301se of the",
    "of\ue000the license of the\ue000",
    "Thé of under ÍN license",
    "ΛΟΓΟΣ license of the ΛΟΓΟΣ",
    "thé",
    "",
    None,
    "under b c d license",
    "licençiado licenĉe licentiate",
    "Ïn of the",
]
NAMES = ["fts_term", "fts_phrase", "fts_boolean", "fts_prefix", "fts_near", "fts_first", "fts_filtered", "fts_policy_order", "token_counts", "hybrid_rrf"]
NAMES += [f"postings_{kind}" for kind in ("term", "phrase", "boolean", "prefix", "near", "first", "filtered", "top")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of tables, and SQL over them."""
    d = str(tmp_path_factory.mktemp("spelled"))
    spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 1)) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, i, [1.0, float(i)]) for i in range(len(TEXTS))], "vec_id long, label int, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    connection = duckdb.connect()
    for name in ("documents", "labels", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    return d, connection


@pytest.mark.parametrize("name", NAMES)
def test_words_are_those_of_the_sql(spark, tables, name):
    d, connection = tables
    found = entry.queries()[name](spark, d)
    names = sorted(found.columns)
    result = connection.execute(entry.oracle_sql()[name])
    at = [[c[0] for c in result.description].index(n) for n in names]
    assert spelled([r[i] for i in at] for r in result.fetchall()) == spelled(tuple(r) for r in found.select(*names).collect())


def test_words_keep_their_spelling(spark):
    df = spark.createDataFrame([("Café naïve 12ab, éa!",), ("ΛΟΓΟΣ İn",), ("e\u0301a b\ue000c",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.words("t")).collect()] == [["café", "naïve", "12ab", "éa"], ["λογοσ", "in"], ["e", "a", "b", "c"], [], None]
    assert [r[0] for r in df.select(T.words(F.col("t"))).collect()][0] == ["café", "naïve", "12ab", "éa"]
