import pytest
from pyspark.sql import functions as F

from inkwell.functions import text as T
from inkwell.functions.jsonkind import json_kind
from inkwell.operators import filters

DOC = '{"review": {"count": 3, "ok": true}, "nested": {"x": 1.0}, "flag": false, "empty": null, "name": "b", "tags": ["a"], "big": 9223372036854775808}'


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, DOC), (2, "{}"), (3, None), (4, '{"review": {"count": 3.0}}'), (5, "no json")], "id long, j string")


def ids(df, condition):
    return [r[0] for r in df.filter(filters.where(condition, "j")).orderBy("id").select("id").collect()]


@pytest.mark.parametrize(
    ("field", "kind"),
    [("review.count", "integer"), ("review.ok", "true"), ("nested.x", "real"), ("flag", "false"), ("empty", "null"), ("name", "text"), ("tags", "array"), ("review", "object"), ("big", "integer"), ("none", None)],
)
def test_kinds(docs, field, kind):
    assert docs.filter("id = 1").select(json_kind("j", field)).first()[0] == kind


@pytest.mark.parametrize(
    ("condition", "expected"),
    [
        ({"review.count": 3}, [1]), ({"review.count": 3.0}, [4]), ({"review.count": {"op": "in", "value": [2, 3, "x"]}}, [1]), ({"review.count": {"op": "lt", "value": 4}}, [1]), ({"review.count": {"op": "lte", "value": 3}}, [1]),
        ({"review.count": {"op": "gt", "value": 2}}, [1]), ({"review.count": {"op": "gte", "value": 4}}, []), ({"review.count": {"op": "exists", "value": True}}, [1, 4]), ({"review.count": {"op": "exists", "value": False}}, [2, 3, 5]),
        ({"empty": {"op": "is_null", "value": True}}, [1]), ({"flag": False}, [1]), ({"flag": 0}, []), ({"name": {"op": "gte", "value": "a"}, "review.ok": True}, [1]), ({}, [1, 2, 3, 4, 5]), (None, [1, 2, 3, 4, 5]),
    ],
)
def test_operators(docs, condition, expected):
    assert ids(docs, condition) == expected


@pytest.mark.parametrize(
    "condition",
    [{"a b": 1}, {"a": None}, {"a": {"op": "lt", "value": True}}, {"a": {"op": "in", "value": []}}, {"a": {"op": "near", "value": 1}}, {"a": {"value": 1}}, {"a": 2**63}, {"a": float("nan")}, {"a": "x" * 1001}, {"a": {"op": "is_null", "value": False}}, {f"f{i}": 1 for i in range(21)}],
)
def test_bad_filters(condition):
    with pytest.raises(ValueError):
        filters.where(condition, "j")


def test_tokens(spark):
    df = spark.createDataFrame([("Café naïve 12ab, éa!",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.tokens("t")).collect()] == [["cafe", "naive", "12ab", "ea"], [], None]
    assert T.fold("Café éa") == ["cafe", "ea"]


def test_phrases(spark):
    df = spark.createDataFrame([(["a", "b", "a", "b", "a"],), (["ab"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(T.phrase_count(F.col("t"), ["a", "b"])).collect()] == [2, 0, 0]
    assert [r[0] for r in df.select(T.phrase_count(F.col("t"), ["a", "b", "a"])).collect()] == [2, 0, 0]


def test_small_functions(spark):
    df = spark.createDataFrame([("  secret ", "aaaa", "a  b\n c")], "m string, e string, x string")
    assert df.select(T.mask(F.col("m")), T.entropy(F.col("e")), T.error_text(F.col("x"))).first()[:] == ("se***", 0.0, "a b c")
    assert df.select(T.entropy(F.lit("abcd")), T.mask(F.lit("abc"))).first()[:] == (2.0, "***")
