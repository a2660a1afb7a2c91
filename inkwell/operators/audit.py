"""Content audit: each distinct content is scanned once by rules, and by a language model if one is given."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.functions.jsonkind import json_kind
from inkwell.functions.text import entropy, mask
from inkwell.operators import models
from inkwell.operators.attributes import drop_key, insert_absent, unscanned

#: Rules as regular expressions that Java and RE2 read alike; the group is the value that is shown masked.
RULES = {
    "aws_key": r"((?:AKIA|ASIA)[0-9A-Z]{16})",
    "private_key": r"(-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY)",
    "assignment": r"(?i)(?:api[_-]?key|password|passwd|secret|token)[ ]*[:=][ ]*[\"']?([^ \n\"']{4,})",
    "url_credentials": r"[a-zA-Z][a-zA-Z0-9+.-]*://[^ \n/:@]+:([^ \n/:@]+)@",
    "github_token": r"(gh[pousr]_[A-Za-z0-9]{36})",
    "jwt": r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})",
}
#: Quoted strings that look random: pattern of the string, least entropy in bits a character.
RANDOM = {"hex_entropy": (r"[\"']([0-9a-fA-F]{16,})[\"']", 3.0), "base64_entropy": (r"[\"']([A-Za-z0-9+/=_-]{20,})[\"']", 4.5)}
MATCH_RISK, FLAG_RISK = 8, 5


def findings(text: Column) -> Column:
    """array<struct<type, preview>> of a text, by all rules in their order."""
    found = []
    for name, pattern in RULES.items():
        found.append(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), named(name)))
    for name, (pattern, least) in RANDOM.items():
        some = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), above(least))
        found.append(F.transform(some, named(name)))
    return F.concat(*found)


def named(name: str) -> Callable[[Column], Column]:
    return lambda v: F.struct(F.lit(name).alias("type"), mask(v).alias("preview"))


def above(least: float) -> Callable[[Column], Column]:
    return lambda v: entropy(v) > least


def by_line(text: Column) -> Column:
    """array<struct<type, line, preview>>, lines from 1."""
    lines = F.split(text, "\r\n|\n|\r")
    each = F.transform(lines, lambda t, i: F.transform(findings(t), lambda f: F.struct(f["type"].alias("type"), (i + 1).alias("line"), f["preview"].alias("preview"))))
    return F.flatten(each)


def clamp(risk: Column) -> Column:
    """Rounded half to even and held within 0 and 10."""
    return F.least(F.lit(10), F.greatest(F.lit(0), F.bround(risk))).cast("int")


def fused_risk(matched: Column, llm_risk: Column | None = None) -> Column:
    return F.greatest(F.coalesce(llm_risk, F.lit(0)) if llm_risk is not None else F.lit(0), F.when(matched, MATCH_RISK).otherwise(0))


def reply(text: str) -> dict:
    """The object in a model's reply: from the first brace to the last, with a numeric risk_score that is clamped."""
    a, b = text.find("{"), text.rfind("}")
    if a < 0 or b < a:
        raise ValueError("no object in the reply")
    out = json.loads(text[a : b + 1])
    risk = out.get("risk_score") if isinstance(out, dict) else None
    if isinstance(risk, bool) or not isinstance(risk, (int, float, str)):
        raise ValueError("no risk score in the reply")
    return out | {"risk_score": max(0, min(10, round(float(risk))))}


FINDINGS = "array<struct<type: string, line: int, preview: string>>"
REASON = 500


@dataclass
class AuditConfig:
    """Hooks are columns over the items' columns (domain, sha256, content, source_paths, ...), built-in expressions or pandas
    UDFs: pre_scan says whether an item is scanned; on_oversize gives a text in place of one over the limit, or null;
    heuristic_rules gives more findings (their previews are masked); prompt_context gives a template with {content};
    risk_policy, given the evaluated rows, the risk. post_scan gets the stored rows of a batch."""

    key: str = "secret_scan"
    limits: dict[str, int] = field(default_factory=lambda: {"chunk": 4000, "document": 50_000})
    prompt: str = "Rate from 0 to 10 how secret this is, as JSON with risk_score and reason.\n{content}"
    version: str = "1"
    #: generate(prompt) -> reply, run within tasks; None leaves the model layer out.
    generate: Callable[[str], str] | None = None
    model: str | None = None
    #: load() -> generate, called once a worker process (which later tasks and batches use again) and model, before its first prompt: what fails there fails the pass.
    load: Callable[[], Callable[[str], str]] | None = None
    #: Rows of a batch; None: all at once.
    batch: int | None = None
    pre_scan: Callable[[], Column] | None = None
    on_oversize: Callable[[Column], Column] | None = None
    heuristic_rules: Callable[[Column], Column] | None = None
    prompt_context: Callable[[Column], Column] | None = None
    #: risk(struct of the result's columns) -> risk.
    risk_policy: Callable[[DataFrame], Column] | None = None
    post_scan: Callable[[DataFrame], None] | None = None


def answers(config: AuditConfig) -> Callable[..., Column]:
    """The model layer as a pandas UDF of text, template, matched, skip reason."""
    generate, load, name = config.generate, config.load, f"{config.model}/{config.version}"

    @F.pandas_udf("status string, risk int, confidence int, reason string, snippets array<string>, error string")
    def ask(texts: pd.Series, templates: pd.Series, matched: pd.Series, skipped: pd.Series) -> pd.DataFrame:
        out = []
        for text, template, hit, why in zip(texts, templates, matched, skipped, strict=True):
            if why is not None:
                out.append(("skipped", 0, 0, why, [], None))
                continue
            if template is None or "{content}" not in template:
                out.append(("error", 5, 0, None, [], "hook:prompt_context: ValueError"))
                continue
            model = generate if load is None else models.held(name, load)
            try:
                answer = model(template.replace("{content}", text))
            except Exception as e:  # a model's failure is a result, told by its class alone
                out.append(("error", 5, 0, None, [], f"layer:llm: {type(e).__name__}"))
                continue
            try:
                found = reply(answer)
                snippets = [masked(x) for x in found.get("flagged_snippets") or [] if isinstance(x, str)]
                sure = found.get("llm_confidence_score", 0)
                sure = max(0, min(10, round(float(sure)))) if isinstance(sure, (int, float)) else 0
                out.append(("ok", found["risk_score"], sure, str(found.get("reason", ""))[:REASON], snippets, None))
            except (ValueError, TypeError) as e:
                out.append(("parse_error", 5 if hit else 0, 0, None, [], f"parse: {type(e).__name__}"))
        return pd.DataFrame(out, columns=["status", "risk", "confidence", "reason", "snippets", "error"])

    return ask


def masked(text: str) -> str:
    """As mask(), of a Python string."""
    text = text.strip()
    return text[:2] + "***" if len(text) > 4 else "***"


def evaluate(items: DataFrame, config: AuditConfig | None = None) -> DataFrame:
    """Adds oversize, skip_reason, findings, matched, llm (status, risk, confidence, reason, snippets, error), layers and
    risk_score to items (domain, sha256, content)."""
    config = config or AuditConfig()
    most = F.create_map(*(F.lit(x) for pair in config.limits.items() for x in pair))[F.col("domain")]
    over = F.length("content") > most
    instead = config.on_oversize(most) if config.on_oversize else F.lit(None).cast("string")
    rows = items.withColumn("_text", F.when(over, instead).otherwise(F.col("content")))
    unwanted = ~F.coalesce(config.pre_scan(), F.lit(False)) if config.pre_scan else F.lit(False)
    rows = rows.withColumn("skip_reason", F.when(unwanted, "pre_scan").when(F.col("_text").isNull() & F.col("content").isNotNull(), "oversize"))
    rows = rows.withColumn("oversize", F.coalesce(F.col("skip_reason") == "oversize", F.lit(False)))
    found = by_line(F.col("_text"))
    if config.heuristic_rules:
        more = F.transform(config.heuristic_rules(F.col("_text")), lambda f: F.struct(f["type"].alias("type"), f["line"].cast("int").alias("line"), mask(f["preview"]).alias("preview")))
        found = F.concat(found, F.coalesce(more, F.array().cast(FINDINGS)))
    rows = rows.withColumn("findings", F.when(F.col("skip_reason").isNull(), F.coalesce(found, F.array().cast(FINDINGS))).otherwise(F.array().cast(FINDINGS)))
    rows = rows.withColumn("matched", F.size("findings") > 0)
    layers = ["heuristic"]
    if config.generate is None and config.load is None:
        nothing = {"risk": "int", "confidence": "int", "reason": "string", "snippets": "array<string>", "error": "string"}
        status = F.when(F.col("skip_reason").isNotNull(), "skipped").otherwise("disabled")
        rows = rows.withColumn("llm", F.struct(status.alias("status"), *(F.lit(None).cast(t).alias(k) for k, t in nothing.items())))
    else:
        layers.append("llm")
        template = F.lit(config.prompt)
        rows = rows.withColumn("_template", config.prompt_context(template) if config.prompt_context else template)
        rows = rows.withColumn("llm", answers(config)("_text", "_template", "matched", "skip_reason")).drop("_template")
    rows = rows.withColumn("layers", F.when(F.col("skip_reason").isNull(), F.lit(layers)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("risk_score", fused_risk(F.col("matched"), F.col("llm.risk"))).drop("_text")
    if config.risk_policy:
        rows = rows.withColumn("risk_score", F.when(F.col("skip_reason").isNotNull(), F.col("risk_score")).otherwise(clamp(config.risk_policy(rows))))
    return rows


def work(documents: DataFrame, chunks: DataFrame, attributes: DataFrame, limit: int | None = None) -> DataFrame:
    """Content that has no attributes yet, once each: domain, sha256, content, n_places, first_path, first_ordinal. Chunks
    come first, then documents, each in the order of first occurrence. All its places are in places()."""

    def items(rows: DataFrame, domain: str, hash_col: str, text: str, path: str, ordinal: Column) -> DataFrame:
        own = rows.select(F.col(hash_col).alias("sha256"), F.col(text).alias("content"), F.struct(F.col(path).alias("path"), ordinal.cast("int").alias("ordinal")).alias("at"))
        new = unscanned(own, "sha256", "at", attributes, domain)
        # The paths of one content are summed up before they are shuffled: its number and the first ones.
        top = own.join(F.broadcast(new) if limit is not None else new, "sha256").groupBy("sha256").agg(F.min("content").alias("content"), F.count(F.lit(1)).alias("n_places"), F.min("first").alias("first"))
        return top.select(F.lit(domain).alias("domain"), "sha256", "content", "n_places", F.col("first.path").alias("first_path"), F.col("first.ordinal").alias("first_ordinal"), "first")

    both = items(chunks, "chunk", "content_sha256", "content", "source_path", F.col("ordinal")).unionByName(items(documents, "document", "body_sha256", "body", "path", F.lit(None)))
    if limit is not None:
        both = both.orderBy("domain", "first.path", "first.ordinal", "sha256").limit(limit)
    return both.drop("first")


def places(documents: DataFrame, chunks: DataFrame, items: DataFrame) -> DataFrame:
    """Where items (domain, sha256) occur: domain, sha256, path, ordinal (null of documents) and the document's metadata_json,
    a row each, so that content with any number of copies is no large row."""
    own = documents.select(F.lit("document").alias("domain"), F.col("body_sha256").alias("sha256"), "path", F.lit(None).cast("int").alias("ordinal"), "metadata_json")
    each = chunks.select("content_sha256", F.col("source_path").alias("path"), "ordinal").join(documents.select("path", "metadata_json"), "path", "left")
    both = own.unionByName(each.select(F.lit("chunk").alias("domain"), F.col("content_sha256").alias("sha256"), "path", "ordinal", "metadata_json"))
    return both.join(items.select("domain", "sha256"), ["domain", "sha256"], "left_semi")


def results(evaluated: DataFrame, config: AuditConfig | None = None, now: Column | None = None) -> DataFrame:
    """Attribute rows of evaluated items; fields without a value are left out."""
    config = config or AuditConfig()
    now = F.current_timestamp() if now is None else now
    by_model = config.generate is not None or config.load is not None
    provenance = F.struct(F.lit(config.version).alias("scanner_version"), *([F.lit(config.model).alias("model_id"), F.sha2(F.lit(config.prompt), 256).alias("prompt_sha256")] if by_model else []))
    result = F.struct(
        F.col("risk_score"), F.col("matched").alias("regex_matches_found"), F.coalesce("llm.confidence", F.lit(0)).alias("llm_confidence_score"), F.coalesce("llm.reason", F.lit("")).alias("reason"),
        F.coalesce("llm.snippets", F.array().cast("array<string>")).alias("flagged_snippets"), F.col("findings").alias("heuristic_findings"), F.col("layers"), F.col("llm.status").alias("llm_status"), F.col("skip_reason"),
        F.col("llm.error").alias("error"), provenance.alias("provenance"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("scanned_at"),
    )
    return evaluated.select("domain", "sha256", F.to_json(F.struct(result.alias(config.key))).alias("attributes_json"), now.alias("updated_at"))


def report(evaluated: DataFrame) -> DataFrame:
    """One row: scanned (all that were looked at), skipped among them, flagged, errors."""
    return evaluated.agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("llm.status") == "skipped").alias("skipped"), F.count_if(F.col("matched") | (F.col("risk_score") >= FLAG_RISK)).alias("flagged"), F.count_if(F.col("llm.status") == "error").alias("errors")
    )


def run_pass(documents: DataFrame, chunks: DataFrame, attributes: DataFrame, config: AuditConfig | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Attributes after a pass, and the evaluated items."""
    evaluated = evaluate(work(documents, chunks, attributes, limit), config)
    return insert_absent(attributes, results(evaluated, config)), evaluated


def chosen(key: str = "secret_scan", domain: str | None = None, sha256: str | None = None, statuses: tuple[str, ...] = (), least_risk: int | None = None) -> Column:
    """Rows of attributes that hold the scanner's key and meet all that is asked for."""
    value = F.try_parse_json("attributes_json")
    out = json_kind("attributes_json", key).isNotNull()
    if domain:
        out &= F.col("domain") == domain
    if sha256:
        out &= F.col("sha256") == sha256
    if statuses:
        out &= F.coalesce(F.try_variant_get(value, f"$.{key}.llm_status", "string").isin(*statuses), F.lit(False))
    if least_risk is not None:
        out &= F.coalesce(F.try_variant_get(value, f"$.{key}.risk_score", "double") >= least_risk, F.lit(False))
    return out


def reset(attributes: DataFrame, key: str = "secret_scan", now: Column | None = None, **selection: Any) -> DataFrame:
    """Attributes without the key in the rows chosen, which are as new; a row that holds nothing else goes."""
    rows = attributes.withColumn("_chosen", chosen(key, **selection))
    rest = F.when(F.col("_chosen"), drop_key(F.when(F.col("_chosen"), F.col("attributes_json")), F.lit(key))).otherwise(F.col("attributes_json"))
    stamp = F.when(F.col("_chosen"), F.current_timestamp() if now is None else now).otherwise(F.col("updated_at"))
    rows = rows.withColumns({"attributes_json": rest, "updated_at": stamp})
    return rows.filter(~F.col("_chosen") | (F.col("attributes_json") != "{}")).drop("_chosen")
