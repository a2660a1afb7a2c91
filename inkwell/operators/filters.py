"""The metadata filter language: a dict of dotted fields to scalars or {"op", "value"}, as one boolean column."""

from __future__ import annotations

import math
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.jsonkind import as_type, json_value, kind_of

FIELD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)*")
ORDER = ("lt", "lte", "gt", "gte")
#: Limits of requests.
FIELDS, FIELD_LENGTH, VALUES, TEXT_LENGTH = 20, 128, 20, 1000


def scalar(value: Any) -> Any:
    if value is None or not isinstance(value, (bool, int, float, str)):
        raise ValueError("filter values are strings, numbers or booleans")
    if isinstance(value, str) and len(value) > TEXT_LENGTH:
        raise ValueError("a filter's text is too long")
    if isinstance(value, int) and not isinstance(value, bool) and not -(2**63) <= value < 2**63:
        raise ValueError("a filter's integer has more than 64 bits")
    if isinstance(value, float) and not math.isfinite(value):
        raise ValueError("a filter's number is not finite")
    return value


def typed(value: Any) -> tuple[str, str]:
    """Kind and Spark type of a Python scalar."""
    if isinstance(value, bool):
        return ("true" if value else "false"), "boolean"
    if isinstance(value, int):
        return "integer", "bigint"
    return ("real", "double") if isinstance(value, float) else ("text", "string")


def equal(found: Column, value: Any) -> Column:
    kind, spark_type = typed(scalar(value))
    same = kind_of(found) == kind
    return same if spark_type == "boolean" else same & (as_type(found, spark_type) == F.lit(value))


def untyped_equal(column: str, field: str, value: Any) -> Column:
    """Whether the value at a path equals another whatever their kinds: 1, 1.0 and true are one, a text equals texts alone, and
    null, objects, arrays and what isn't there equal nothing."""
    if not FIELD.fullmatch(field) or len(field) > FIELD_LENGTH:
        raise ValueError("a filter's field is not a dotted name")
    found = json_value(column, field)
    kind = kind_of(found)
    if isinstance(scalar(value), str):
        same = (kind == "text") & (as_type(found, "string") == F.lit(value))
    else:
        whole = isinstance(value, int)  # integers keep all their digits
        same = F.when(kind == "integer", as_type(found, "bigint") == F.lit(int(value)) if whole else as_type(found, "double") == F.lit(float(value)))
        same = same.when(kind == "real", as_type(found, "double") == F.lit(float(value))).when(kind.isin("true", "false"), (kind == "true").cast("double") == F.lit(float(value)))
    return F.coalesce(same, F.lit(False))


def predicate(column: str, field: str, condition: Any) -> Column:
    if not FIELD.fullmatch(field) or len(field) > FIELD_LENGTH:
        raise ValueError("a filter's field is not a dotted name")
    found = json_value(column, field)
    if not isinstance(condition, dict):
        return F.coalesce(equal(found, condition), F.lit(False))
    if set(condition) != {"op", "value"}:
        raise ValueError("a condition has op and value")
    op, value = condition["op"], condition["value"]
    if op == "exists":
        if not isinstance(value, bool):
            raise ValueError("exists takes true or false")
        return found.isNotNull() if value else found.isNull()
    if op == "is_null":
        if value is not True:
            raise ValueError("is_null takes true")
        return F.coalesce(kind_of(found) == "null", F.lit(False))
    if op == "in":
        if not isinstance(value, list) or not 1 <= len(value) <= VALUES:
            raise ValueError(f"in takes 1 to {VALUES} values")
        return F.coalesce(reduce(lambda a, b: a | b, (equal(found, v) for v in value)), F.lit(False))
    if op == "eq":
        return F.coalesce(equal(found, value), F.lit(False))
    if op not in ORDER:
        raise ValueError("unknown op")
    kind, spark_type = typed(scalar(value))
    if spark_type == "boolean":
        raise ValueError("booleans have no order")
    own = as_type(found, spark_type)
    compared = {"lt": own < F.lit(value), "lte": own <= F.lit(value), "gt": own > F.lit(value), "gte": own >= F.lit(value)}[op]
    return F.coalesce((kind_of(found) == kind) & compared, F.lit(False))


def where(filters: dict[str, Any] | None, column: str) -> Column:
    """All conditions at once; no filter is true."""
    if filters is None:
        return F.lit(True)
    if not isinstance(filters, dict) or len(filters) > FIELDS:
        raise ValueError(f"filters are an object of at most {FIELDS} fields")
    return reduce(lambda a, b: a & b, (predicate(column, k, v) for k, v in filters.items()), F.lit(True))
