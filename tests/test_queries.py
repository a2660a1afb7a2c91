import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.queries() if n in entry.oracle_sql()]


def spelled(rows):
    plain = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return sorted(repr([plain(v) for v in r]) for r in rows)


@pytest.fixture(scope="module")
def oracle(small):
    connection = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(f).removesuffix('.parquet')} AS SELECT * FROM '{f}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, small, oracle, name):
    found = entry.queries()[name](spark, small)
    names = sorted(found.columns)
    result = oracle.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    assert spelled([r[i] for i in at] for r in result.fetchall()) == spelled(tuple(r) for r in found.select(*names).collect())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rows_only_queries(spark, small):
    for name in ("semantic_topk", "chunk_markdown"):
        assert entry.queries()[name](spark, small).count() > 0
