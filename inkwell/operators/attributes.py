"""Attributes belong to content, not to paths: rows (domain, sha256, attributes_json, updated_at) joined by hash."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from inkwell.functions.jsonkind import json_kind, kind_of

KEY = ["domain", "sha256"]


def valid(rows: DataFrame) -> DataFrame:
    """Rows as they may be stored; others fail the job."""
    whole = F.try_parse_json("attributes_json")
    sound = F.col("domain").isin("document", "chunk") & F.col("sha256").rlike("^[0-9a-f]{64}$") & (kind_of(whole) == "object")
    return rows.withColumn("domain", F.when(F.coalesce(sound, F.lit(False)), F.col("domain")).otherwise(F.raise_error(F.lit("an attribute row is not valid"))))


def insert_absent(attributes: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that are there win; of new rows with one key the first by content stays."""
    first = new.groupBy(*KEY).agg(F.min(F.struct("attributes_json", "updated_at")).alias("r")).select(*KEY, "r.*")
    return attributes.unionByName(first.join(attributes, KEY, "left_anti").select(*attributes.columns))


@F.pandas_udf(StringType())
def set_key(objects: pd.Series, keys: pd.Series, values: pd.Series) -> pd.Series:
    """Objects with one top-level key set. JSON text is edited as text by Python: reals stay reals."""
    return pd.Series([v if v is None else json.dumps((json.loads(o) if o else {}) | {k: json.loads(v)}, ensure_ascii=False) for o, k, v in zip(objects, keys, values, strict=True)])


@F.pandas_udf(StringType())
def drop_key(objects: pd.Series, keys: pd.Series) -> pd.Series:
    return pd.Series([o if o is None else json.dumps({a: b for a, b in json.loads(o).items() if a != k}, ensure_ascii=False) for o, k in zip(objects, keys, strict=True)])


def upsert_key(attributes: DataFrame, key: str, new: DataFrame, now: Column | None = None) -> DataFrame:
    """Sets key to new.value_json for rows of new (domain, sha256, value_json; one a hash); other keys and rows stay."""
    now = F.current_timestamp() if now is None else now
    both = attributes.alias("o").join(new.alias("n"), KEY, "full_outer")
    changed = set_key(F.col("attributes_json"), F.lit(key), F.col("value_json"))
    return both.select(*KEY, F.coalesce(changed, "attributes_json").alias("attributes_json"), F.when(F.col("value_json").isNotNull(), now).otherwise(F.col("updated_at")).alias("updated_at"))


def contents(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """domain, sha256 of all content there is."""
    return documents.select(F.lit("document").alias("domain"), F.col("body_sha256").alias("sha256")).union(chunks.select(F.lit("chunk"), "content_sha256")).distinct()


def collect_garbage(attributes: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Only attributes whose content still occurs in their domain."""
    return attributes.join(contents(documents, chunks), KEY, "left_semi")


def unscanned(rows: DataFrame, hash_col: str, order: str, attributes: DataFrame, domain: str) -> DataFrame:
    """Hashes without an attribute row of any kind, with their first occurrence: sha256, first."""
    known = attributes.filter(F.col("domain") == domain).select(F.col("sha256").alias(hash_col))
    return rows.join(known, hash_col, "left_anti").groupBy(F.col(hash_col).alias("sha256")).agg(F.min(order).alias("first"))


def missing_key(rows: DataFrame, hash_col: str, attributes: DataFrame, domain: str, key: str) -> DataFrame:
    """Rows whose content has no such key (or no attributes)."""
    known = attributes.filter((F.col("domain") == domain) & json_kind("attributes_json", key).isNotNull()).select(F.col("sha256").alias(hash_col))
    return rows.join(known, hash_col, "left_anti")
