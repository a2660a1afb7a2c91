"""JSON values in text columns by kind: text, integer, real, true, false, null, object, array, or missing (SQL null).

Kinds are strict: 3 is not 3.0 and 1 is not true. A whole literal of 19 digits or more counts as an integer; Spark
keeps no trace of a real written so."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_path(field: str) -> str:
    return "$." + field


def json_value(column: Column | str, field: str) -> Column:
    """The variant at a dotted path; SQL null if the text is no JSON or has nothing there."""
    return F.try_variant_get(F.try_parse_json(column), json_path(field), "variant")


def kind_of(value: Column) -> Column:
    """Kind of a variant."""
    shape = F.schema_of_variant(value)
    whole = F.regexp_extract(shape, r"^DECIMAL\((\d+),0\)$", 1)
    return (
        F.when(value.isNull(), F.lit(None).cast("string"))
        .when(shape == "BIGINT", "integer")
        .when(shape == "DOUBLE", "real")
        .when(shape.startswith("DECIMAL"), F.when((whole != "") & (whole.try_cast("int") >= 19), "integer").otherwise("real"))
        .when(shape == "STRING", "text")
        .when(shape == "BOOLEAN", F.when(F.try_variant_get(value, "$", "boolean"), "true").otherwise("false"))
        .when(shape == "VOID", "null")
        .when(shape.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def json_kind(column: Column | str, field: str) -> Column:
    return kind_of(json_value(column, field))


def as_type(value: Column, kind: str) -> Column:
    return F.try_variant_get(value, "$", kind)
