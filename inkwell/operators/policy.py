"""Visibility of documents and chunks: rows a caller may see, and what of them is disclosed.

A policy gives a decision column for documents and one for chunks, from columns alone (Catalyst sees through it) or from
a vectorised Python function; either is evaluated once a row, before any order or limit."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIONS = ("allow", "hide", "null")
DECISION = "action string, disclose_metadata boolean, disclose_source boolean, disclose_attributes boolean"


def decision(action: Column | str = "allow", metadata: Column | bool = True, source: Column | bool = True, attributes: Column | bool = True) -> Column:
    """action: allow, hide (the row) or null (its content). Any other one, or none, fails the query; a null disclosure is
    none."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    known = F.when(col(action).isin(*ACTIONS), col(action)).otherwise(F.raise_error(F.lit("a policy gave no valid decision")))
    shown = lambda x: F.coalesce(col(x), F.lit(False))
    return F.struct(known.alias("action"), shown(metadata).alias("disclose_metadata"), shown(source).alias("disclose_source"), shown(attributes).alias("disclose_attributes"))


@dataclass
class Policy:
    """document and chunk give decisions from the columns of visible rows; rewrite may replace a request's arguments."""

    document: Callable[[], Column] = decision
    chunk: Callable[[], Column] = decision
    rewrite: Callable[[str, dict[str, Any]], dict[str, Any]] | None = None

    def rewritten(self, tool: str, arguments: dict[str, Any]) -> dict[str, Any]:
        if self.rewrite is None:
            return arguments
        new = self.rewrite(tool, dict(arguments))
        if set(new) != set(arguments):
            raise ValueError("a policy keeps a request's argument names")
        return new


def python_decision(function: Callable[..., dict[str, Any]], *columns: str) -> Column:
    """A decision by a Python function of the columns' values, in Arrow batches. What isn't a decision fails the query."""

    @F.pandas_udf(DECISION)
    def decide(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for series in batches:
            series = (series,) if isinstance(series, pd.Series) else series
            rows = [{"action": "allow", "disclose_metadata": True, "disclose_source": True, "disclose_attributes": True} | function(*values) for values in zip(*series, strict=True)]
            if any(set(r) != {"action", "disclose_metadata", "disclose_source", "disclose_attributes"} or r["action"] not in ACTIONS for r in rows):
                raise ValueError("a policy gave no valid decision")
            yield pd.DataFrame(rows, columns=["action", "disclose_metadata", "disclose_source", "disclose_attributes"])

    return decide(*columns)


#: Content with this risk or more counts as flagged.
RISK = 5


def secret_scan_decision(attributes: str, key: str = "secret_scan", risk: int = RISK) -> Column:
    """Hides content that is flagged, not scanned, malformed or was skipped: it fails closed."""
    score = F.try_variant_get(F.try_parse_json(attributes), f"$.{key}.risk_score", "int")
    status = F.try_variant_get(F.try_parse_json(attributes), f"$.{key}.llm_status", "string")
    clean = score.isNotNull() & (score >= 0) & (score < risk) & ~F.coalesce(status.isin("skipped", "error", "parse_error"), F.lit(False))
    return decision(F.when(F.coalesce(clean, F.lit(False)), "allow").otherwise("hide"))
