"""Search over an index: documents, chunks, and attributes that belong to a content hash.

documents(path, metadata_json, body_sha256, ...), chunks(chunk_id, source_path, ordinal, content, content_sha256, tokens,
embedding), attributes(domain, sha256, attributes_json). Every tool builds one DataFrame: joins, filters and the policy
come before the order and the limit, which Spark runs as one top-k. It is lazy, but for what a request has to know first:
corpus statistics of a phrase without a policy, and the embedding spaces there are (one small row each)."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from inkwell.functions.jsonkind import as_type, json_value, kind_of
from inkwell.functions.text import cosine_distance, fold, phrase_count, with_counts
from inkwell.operators.filters import FIELD, where
from inkwell.operators.policy import Policy, decision
from inkwell.sources.index import Index, Statistics

K1, B, RRF = 1.2, 0.75, 60
OFFSETS = 10_000


class SearchError(Exception):
    """The index can't answer a valid request."""


@dataclass(frozen=True)
class SearchConfig:
    max_limit: int = 50
    candidate_limit: int = 100
    max_content_chars: int = 8000
    embedding_space: str | None = None
    embedding_model: str | None = None
    embedding_version: str | None = None
    dimensions: int | None = None
    document_attribute_keys: tuple[str, ...] = ()
    chunk_attribute_keys: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not 1 <= self.max_limit <= 100 or not self.max_limit <= self.candidate_limit <= 1000 or not 1 <= self.max_content_chars <= 100_000:
            raise ValueError("limits are out of range")
        space = (self.embedding_space, self.embedding_model, self.embedding_version, self.dimensions)
        if any(x is None for x in space) and any(x is not None for x in space):
            raise ValueError("an embedding space needs a name, model, version and dimensions")


@dataclass
class Page:
    """Rows of one request, still lazy, one more than asked for if there are more. Of a hybrid request the column arms_full
    tells that an arm had more rows than its window."""

    rows: DataFrame
    limit: int
    offset: int = 0
    window: int | None = None

    def collect(self) -> dict[str, Any]:
        found = [r.asDict(recursive=True) for r in self.rows.collect()]
        full = any([r.pop("arms_full", False) for r in found])
        more = len(found) > self.limit
        after = self.offset + self.limit
        page = {"results": found[: self.limit], "truncated": more or full}
        if self.window is not None:
            return page | {"candidate_window": self.window}
        return page | {"next_offset": after if more and after <= OFFSETS else None, "pagination_truncated": more and after > OFFSETS}


def bm25(f: Column, length: Column, rows: int, matching: int, average: float) -> Column:
    """SQLite's score: lower is better, and a term in most rows counts next to nothing."""
    idf = math.log((rows - matching + 0.5) / (matching + 0.5)) if rows else 0.0
    idf = idf if idf > 0 else 1e-6
    return F.lit(-idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.lit(average or 1.0)))


def limit_of(limit: int, most: int) -> int:
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= most:
        raise ValueError(f"limit is 1 to {most}")
    return limit


def offset_of(offset: int) -> int:
    if isinstance(offset, bool) or not isinstance(offset, int) or not 0 <= offset <= OFFSETS:
        raise ValueError(f"offset is 0 to {OFFSETS}")
    return offset


def text_of(query: str) -> str:
    if not isinstance(query, str) or not 1 <= len(query) <= 1000 or not query.strip():
        raise ValueError("a query has 1 to 1000 characters")
    return query.strip()


@dataclass
class Search:
    documents: DataFrame
    chunks: DataFrame
    attributes: DataFrame
    config: SearchConfig = field(default_factory=SearchConfig)
    policy: Policy | None = None
    embed: Callable[[list[str]], list[list[float]]] | None = None
    #: Of an index: with them full text looks words up instead of reading chunks.
    postings: DataFrame | None = None
    terms: DataFrame | None = None
    statistics: Statistics | None = None

    @classmethod
    def of(cls, index: Index, config: SearchConfig | None = None, policy: Policy | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None) -> Search:
        """Search over one version of an index, with its postings and counts."""
        manifest = index.manifest()
        tables, counts = index.tables(manifest), index.statistics(manifest)
        kept = {} if counts is None else {"postings": tables["postings"], "terms": tables["terms"], "statistics": counts}
        return cls(tables["documents"], tables["chunks"], tables["attributes"], config or SearchConfig(), policy, embed, **kept)

    # What a caller may see -------------------------------------------------------------------------------------------

    def _attributes(self, domain: str, name: str) -> DataFrame:
        own = self.attributes.filter(F.col("domain") == domain)
        return own.select(F.col("sha256").alias(f"{name}_sha256"), F.col("attributes_json").alias(f"{name}_attributes_json"))

    def _exposed(self, filters: dict | None, keys: tuple[str, ...], rewritten: bool) -> None:
        if not rewritten and any(f.split(".")[0] not in keys for f in filters or {}):
            raise ValueError("an attribute filter names a key that isn't exposed")

    def _documents(self, metadata: dict | None, attributes: dict | None) -> DataFrame:
        known = self._attributes("document", "document")
        rows = self.documents.join(known, self.documents["body_sha256"] == known["document_sha256"], "left").drop("document_sha256")
        rows = rows.withColumn("document_decision", (self.policy.document if self.policy else decision)())
        rows = rows.filter(F.col("document_decision.action") != "hide").filter(where(metadata, "metadata_json")).filter(where(attributes, "document_attributes_json"))
        if metadata:
            rows = rows.filter("document_decision.disclose_metadata")
        if self._gated(attributes, self.config.document_attribute_keys):
            rows = rows.filter("document_decision.disclose_attributes")
        return rows

    def _gated(self, filters: dict | None, keys: tuple[str, ...]) -> bool:
        """Whether a filter names an exposed key, so that its answer would tell an attribute that isn't disclosed."""
        return any(f.split(".")[0] in keys for f in filters or {})

    def _chunks(self, metadata: dict | None, document_attributes: dict | None, attributes: dict | None) -> DataFrame:
        known = self._attributes("chunk", "chunk")
        own = self._documents(metadata, document_attributes)
        rows = self.chunks.join(own.select("path", "metadata_json", "document_attributes_json", "document_decision", *[c for c in ("embedding_model", "embedding_version") if c in own.columns]), F.col("source_path") == F.col("path"))
        rows = rows.join(known, rows["content_sha256"] == known["chunk_sha256"], "left").drop("chunk_sha256")
        rows = rows.withColumn("chunk_decision", (self.policy.chunk if self.policy else decision)())
        rows = rows.filter(F.col("chunk_decision.action") != "hide").filter(where(attributes, "chunk_attributes_json"))
        if metadata:
            rows = rows.filter("chunk_decision.disclose_metadata")
        if self._gated(document_attributes, self.config.document_attribute_keys) or self._gated(attributes, self.config.chunk_attribute_keys):
            rows = rows.filter("document_decision.disclose_attributes and chunk_decision.disclose_attributes")
        return rows

    def _only(self, column: str, keys: tuple[str, ...]) -> Column:
        """The exposed keys of an attributes object, as a map to JSON texts; null without an object. It is edited as text for
        the rows of a page alone: a variant would turn 1.0 into 1."""
        return exposed(F.col(column), F.lit(",".join(keys))) if keys else F.when(F.col(column).isNotNull(), F.create_map().cast("map<string, string>"))

    def _document_columns(self, decisions: tuple[str, ...]) -> list[Column]:
        def shown(what: str, value: Column) -> Column:
            allowed = F.lit(True)
            for d in decisions:
                allowed &= F.col(f"{d}.disclose_{what}")
            return F.when(allowed, value)

        return [
            shown("source", F.col("path")).alias("source_file"),
            shown("metadata", F.col("metadata_json")).alias("metadata"),
            shown("attributes", self._only("document_attributes_json", self.config.document_attribute_keys)).alias("document_attributes"),
        ]

    def _chunk_columns(self) -> list[Column]:
        most = self.config.max_content_chars
        null = (F.col("document_decision.action") == "null") | (F.col("chunk_decision.action") == "null")
        return [
            F.col("chunk_id"),
            *self._document_columns(("document_decision", "chunk_decision")),
            F.when(F.col("document_decision.disclose_attributes") & F.col("chunk_decision.disclose_attributes"), self._only("chunk_attributes_json", self.config.chunk_attribute_keys)).alias("chunk_attributes"),
            F.when(~null, F.substring("content", 1, most)).alias("content"),
            (~null & (F.length("content") > most)).alias("content_truncated"),
        ]

    def _request(self, tool: str, **arguments: Any) -> dict[str, Any]:
        self._exposed(arguments.get("document_attribute_filters"), self.config.document_attribute_keys, False)
        self._exposed(arguments.get("chunk_attribute_filters"), self.config.chunk_attribute_keys, False)
        return self.policy.rewritten(tool, arguments) if self.policy else arguments

    # The tools -------------------------------------------------------------------------------------------------------

    def metadata_search(self, metadata_filters: dict | None = None, limit: int = 10, offset: int = 0, document_attribute_filters: dict | None = None) -> Page:
        a = self._request("metadata_search", metadata_filters=metadata_filters, limit=limit, offset=offset, document_attribute_filters=document_attribute_filters)
        n, skip = limit_of(a["limit"], self.config.max_limit), offset_of(a["offset"])
        rows = self._documents(a["metadata_filters"], a["document_attribute_filters"]).orderBy("path").offset(skip).limit(n + 1)
        return Page(rows.select(*self._document_columns(("document_decision",))), n, skip)

    def _ranked_text(self, query: str, rows: DataFrame) -> DataFrame:
        """Adds score; with a policy it is null, and the order by path tells nothing of hidden rows."""
        phrase = fold(text_of(query))
        if self.postings is not None:
            from inkwell.operators import postings, textquery

            whole = textquery.Phrase(tuple(phrase))
            if self.policy:
                found = postings.matching(self.postings, whole).select(*postings.CHUNK, F.lit(None).cast("double").alias("score"))
            else:
                found = postings.ranked(self.postings, self.terms, self.statistics, whole)
            return rows.join(found, [*postings.CHUNK])
        counts = {"_n": F.size, "_f": lambda words: phrase_count(words, phrase)}
        found = with_counts(rows, "tokens", counts).filter("_f > 0")
        if self.policy:
            return found.withColumn("score", F.lit(None).cast("double")).drop(*counts)
        total = with_counts(self.chunks.select("tokens"), "tokens", counts).agg(F.count(F.lit(1)), F.count_if(F.col("_f") > 0), F.avg("_n")).first()
        return found.withColumn("score", bm25(F.col("_f"), F.col("_n"), total[0], total[1], total[2])).drop(*counts)

    ORDER = ("source_path", "ordinal", "chunk_id")

    def full_text_search(self, keyword_query: str, metadata_filters: dict | None = None, limit: int = 10, document_attribute_filters: dict | None = None, chunk_attribute_filters: dict | None = None) -> Page:
        a = self._request("full_text_search", keyword_query=keyword_query, metadata_filters=metadata_filters, limit=limit, document_attribute_filters=document_attribute_filters, chunk_attribute_filters=chunk_attribute_filters)
        n = limit_of(a["limit"], self.config.max_limit)
        chunks = self._chunks(a["metadata_filters"], a["document_attribute_filters"], a["chunk_attribute_filters"])
        rows = self._ranked_text(a["keyword_query"], chunks)
        if self.postings is not None:
            rows = self._fetched(rows, chunks, n + 1)
        return Page(rows.orderBy("score", *self.ORDER).limit(n + 1).select(*self._chunk_columns(), "score"), n)

    def _fetched(self, found: DataFrame, chunks: DataFrame, count: int) -> DataFrame:
        """The best rows of found, whose contents are read by their paths alone: the page's keys are known first."""
        keys = found.orderBy("score", *self.ORDER).limit(count).select("source_path", "ordinal", "score").collect()  # a page at most
        local = self.chunks.sparkSession.createDataFrame(keys, "source_path string, ordinal int, score double")
        return chunks.filter(F.col("source_path").isin([k[0] for k in keys])).join(F.broadcast(local), ["source_path", "ordinal"])

    def text_query(self, query: Any, limit: int = 10) -> DataFrame:
        """chunk_id, source_path, ordinal and score of the best chunks for an expression of textquery, equal scores in the order
        of path and ordinal. For hosts that see everything: no policy, no filters."""
        from inkwell.operators import postings, textquery

        if self.policy:
            raise ValueError("a text query doesn't heed a policy")
        count = limit_of(limit, self.config.candidate_limit)
        if self.postings is None:
            found = textquery.ranked(self.chunks.select("chunk_id", "source_path", "ordinal", "tokens"), query)
        else:
            found = postings.ranked(self.postings, self.terms, self.statistics, query).join(self.chunks.select("chunk_id", "source_path", "ordinal"), [*postings.CHUNK])
        return found.orderBy("score", "source_path", "ordinal").limit(count).select("chunk_id", "source_path", "ordinal", "score")

    def _vector(self, vector: list[float]) -> list[float]:
        import numpy as np

        c = self.config
        if not isinstance(vector, list) or len(vector) != c.dimensions or any(isinstance(x, bool) or not isinstance(x, (int, float)) for x in vector):
            raise ValueError(f"a vector has {c.dimensions} numbers")
        short = np.array(vector, dtype=np.float64).astype(np.float32)
        if not np.isfinite(short).all() or not short.any():
            raise ValueError("a vector is finite and not zero")
        return [float(x) for x in vector]

    def _ranked_vectors(self, vector: list[float], rows: DataFrame) -> DataFrame:
        visible = rows if self.policy else self.documents
        if "embedding_model" in self.documents.columns:
            spaces = visible.select("embedding_model", "embedding_version").distinct().limit(2).collect()  # two tell enough
            if any((r[0], r[1]) != (self.config.embedding_model, self.config.embedding_version) for r in spaces):
                raise SearchError("documents are embedded in another space")
        query = F.array(*(F.lit(x) for x in self._vector(vector)))
        return rows.withColumn("distance", cosine_distance(F.col("embedding"), query))

    def vector_search(self, vector: list[float], embedding_space: str, metadata_filters: dict | None = None, limit: int = 10, document_attribute_filters: dict | None = None, chunk_attribute_filters: dict | None = None) -> Page:
        a = self._request("vector_search", vector=vector, embedding_space=embedding_space, metadata_filters=metadata_filters, limit=limit, document_attribute_filters=document_attribute_filters, chunk_attribute_filters=chunk_attribute_filters)
        if self.config.embedding_space is None or a["embedding_space"] != self.config.embedding_space:
            raise ValueError("unknown embedding space")
        n = limit_of(a["limit"], self.config.max_limit)
        rows = self._ranked_vectors(a["vector"], self._chunks(a["metadata_filters"], a["document_attribute_filters"], a["chunk_attribute_filters"]))
        # Null (a zero vector) comes first and NaN is moved there: a stored vector without a distance fails the request.
        distance = F.when(~F.isnan("distance"), F.col("distance"))
        sound = F.when(distance.isNotNull(), distance).otherwise(F.raise_error(F.lit("a stored vector has no distance")))
        top = rows.withColumn("distance", distance).orderBy("distance", *self.ORDER).limit(n + 1)
        return Page(top.withColumn("distance", sound).select(*self._chunk_columns(), "distance"), n)

    def semantic_search(self, semantic_query: str, metadata_filters: dict | None = None, limit: int = 10, document_attribute_filters: dict | None = None, chunk_attribute_filters: dict | None = None) -> Page:
        a = self._request("semantic_search", semantic_query=semantic_query, metadata_filters=metadata_filters, limit=limit, document_attribute_filters=document_attribute_filters, chunk_attribute_filters=chunk_attribute_filters)
        once = Search(self.documents, self.chunks, self.attributes, self.config, Policy(self.policy.document, self.policy.chunk) if self.policy else None)
        rest = {k: v for k, v in a.items() if k != "semantic_query"}
        return once.vector_search(self._embedded(a["semantic_query"]), self.config.embedding_space, **rest)

    def _embedded(self, query: str) -> list[float]:
        if self.embed is None or self.config.embedding_space is None:
            raise ValueError("there is no embedder")
        vectors = self.embed([text_of(query)])
        if len(vectors) != 1:
            raise SearchError("an embedder gives one vector a text")
        return [float(x) for x in vectors[0]]

    def hybrid_knowledge_search(self, semantic_query: str, keyword_query: str, metadata_filters: dict | None = None, limit: int = 10, document_attribute_filters: dict | None = None, chunk_attribute_filters: dict | None = None) -> Page:
        a = self._request("hybrid_knowledge_search", semantic_query=semantic_query, keyword_query=keyword_query, metadata_filters=metadata_filters, limit=limit, document_attribute_filters=document_attribute_filters, chunk_attribute_filters=chunk_attribute_filters)
        n = limit_of(a["limit"], self.config.max_limit)
        rows, window = self._chunks(a["metadata_filters"], a["document_attribute_filters"], a["chunk_attribute_filters"]), self.config.candidate_limit
        # The arms' windows carry what is needed for the output, so that the rows aren't looked up again.
        carried = [c for c in (*self.ORDER, "content", "metadata_json", "path", "document_attributes_json", "chunk_attributes_json", "document_decision", "chunk_decision")]
        texts = self._ranked_text(a["keyword_query"], rows).select(*carried, "score")
        vectors = self._ranked_vectors(self._embedded(a["semantic_query"]), rows).select(*carried, "distance")
        found = fuse(texts, vectors, window, self.ORDER).orderBy(F.desc("relevance"), *self.ORDER).limit(n + 1)
        return Page(found.select(*self._chunk_columns(), "relevance", "fts_rank", F.col("score").alias("fts_score"), "vector_rank", "distance", "arms_full"), n, window=window)

    def get_distinct_metadata(self, field_name: str, limit: int = 10, offset: int = 0) -> Page:
        a = self._request("get_distinct_metadata", field=field_name, limit=limit, offset=offset)
        n, skip = limit_of(a["limit"], self.config.max_limit), offset_of(a["offset"])
        rows = self._documents(None, None).filter("document_decision.disclose_metadata")
        return Page(distinct_values(rows, "metadata_json", a["field"]).orderBy("kind", "number", "value").offset(skip).limit(n + 1).drop("number"), n, skip)

    def get_chunk(self, chunk_id: str) -> dict[str, Any] | None:
        a = self._request("get_chunk", chunk_id=chunk_id)
        if not isinstance(a["chunk_id"], str) or len(a["chunk_id"]) != 24 or set(a["chunk_id"]) - set("0123456789abcdef"):
            raise ValueError("a chunk id has 24 hexadecimal digits")
        row = self._chunks(None, None, None).filter(F.col("chunk_id") == a["chunk_id"]).select(*self._chunk_columns()).first()
        return row.asDict(recursive=True) if row else None


def fuse(texts: DataFrame, vectors: DataFrame, window: int, order: tuple[str, ...]) -> DataFrame:
    """Reciprocal-rank fusion of two arms with score and distance, each cut to its best `window` rows first. Other columns
    are the same in both. arms_full tells whether an arm had more rows.

    Windows without a partition see those rows (and one more) only."""

    def arm(rows: DataFrame, by: str, rank: str) -> DataFrame:
        top = rows.orderBy(by, *order).limit(window + 1)
        ranked = top.withColumn(rank, F.row_number().over(Window.orderBy(by, *order)).cast("bigint"))
        return ranked.withColumn("arms_full", F.max(F.col(rank) > window).over(Window.partitionBy())).filter(F.col(rank) <= window)

    shared = [c for c in texts.columns if c in vectors.columns and c != "chunk_id"]
    a = arm(texts, "score", "fts_rank")
    b = arm(vectors, "distance", "vector_rank").withColumnsRenamed({c: f"_{c}" for c in [*shared, "arms_full"]})
    both = a.join(b, "chunk_id", "full_outer")
    for c in shared:
        both = both.withColumn(c, F.coalesce(c, f"_{c}")).drop(f"_{c}")
    full = F.max(F.coalesce("arms_full", F.lit(False)) | F.coalesce("_arms_full", F.lit(False))).over(Window.partitionBy())
    share = lambda rank: F.coalesce(1.0 / (F.lit(RRF) + F.col(rank)), F.lit(0.0))
    return both.withColumn("arms_full", full).drop("_arms_full").withColumn("relevance", share("fts_rank") + share("vector_rank"))


@F.pandas_udf(MapType(StringType(), StringType()))
def exposed(objects: pd.Series, keys: pd.Series) -> pd.Series:
    """Some keys of JSON objects with their values as JSON texts."""

    def some(text: str | None, names: str) -> dict[str, str] | None:
        if text is None:
            return None
        found = json.loads(text)
        return {k: json.dumps(found[k], ensure_ascii=False, sort_keys=True, separators=(",", ":")) for k in names.split(",") if k in found}

    return pd.Series([some(o, k) for o, k in zip(objects, keys, strict=True)])


def untyped_values(rows: DataFrame, column: str, field_name: str) -> DataFrame:
    """Distinct scalars at a path, whatever their kinds: class (0 null or nothing, 1 numbers and booleans, 2 texts: their
    order), number, value. 1, 1.0 and true are one."""
    found = rows.select(json_value(column, field_name).alias("v"))
    kind = kind_of(F.col("v"))
    number = F.when(kind.isin("integer", "real"), as_type(F.col("v"), "double")).when(kind.isin("true", "false"), (kind == "true").cast("double"))
    text = F.when(kind == "text", as_type(F.col("v"), "string"))
    rank = F.when(number.isNotNull(), 1).when(text.isNotNull(), 2).when(kind.isNull() | (kind == "null"), 0)
    return found.select(rank.alias("class"), number.alias("number"), text.alias("value")).filter("class is not null").distinct()


def distinct_values(rows: DataFrame, column: str, field_name: str) -> DataFrame:
    """Distinct scalars at a path: kind, number (for order), value (text)."""
    if not FIELD.fullmatch(field_name):
        raise ValueError("a field is a dotted name")
    found = rows.select(json_value(column, field_name).alias("v"))
    return found.select(kind_of(F.col("v")).alias("kind"), as_type(F.col("v"), "double").alias("number"), as_type(F.col("v"), "string").alias("value")).filter(
        F.col("kind").isNotNull() & ~F.col("kind").isin("object", "array")
    ).withColumn("number", F.when(F.col("kind").isin("integer", "real"), F.col("number"))).distinct()


#: Tools of a host; those on vectors need an embedding space, the last two an embedder too.
TOOLS = ("metadata_search", "full_text_search", "get_distinct_metadata", "get_chunk")
VECTOR_TOOLS = ("vector_search",)
EMBEDDING_TOOLS = ("semantic_search", "hybrid_knowledge_search")


def tools(search: Search, names: tuple[str, ...] = TOOLS) -> dict[str, Callable]:
    for name in names:
        if name not in TOOLS + VECTOR_TOOLS + EMBEDDING_TOOLS:
            raise ValueError(f"unknown tool: {name}")
        if name not in TOOLS and search.config.embedding_space is None or name in EMBEDDING_TOOLS and search.embed is None:
            raise ValueError(f"{name} needs an embedding space and an embedder")
    return {name: getattr(search, name) for name in names}
