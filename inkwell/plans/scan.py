"""Audit passes over an index: what has no attributes is evaluated once, stored, and reported.

A pass stages its work list once, in order; batches are ranges of places in it. A marker for each batch that was stored is the
cursor: a pass that was killed or stopped goes on where it ended, and the corpus is read once whatever the number of batches."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.functions.tables import numbered, read_numbered
from inkwell.operators import audit
from inkwell.operators.attributes import insert_absent
from inkwell.sources.index import Change, Index


class Queue:
    """The staged work list of one kind of pass (scanner, model, prompt, limit), in a folder of the index."""

    def __init__(self, index: Index, config: audit.AuditConfig, limit: int | None):
        name = hashlib.sha256(json.dumps([config.key, config.version, config.model, config.prompt, limit]).encode()).hexdigest()[:24]
        self.index, self.place = index, ("queue", name)
        work = str(index._path(*self.place, "work"))
        if "_SUCCESS" in index._names(*self.place, "work"):
            self.rows = read_numbered(index.spark, work)
        else:
            index._files().delete(index._path(*self.place), True)  # what a pass that died while staging left
            tables = index.tables()
            order = [F.col("domain"), F.col("first_path"), F.col("first_ordinal"), F.col("sha256")]
            self.rows = numbered(audit.work(tables["documents"], tables["chunks"], tables["attributes"], limit), order, work)
        self.size = self.rows.count()
        done = [int(m[1]) for n in index._names(*self.place) if (m := re.fullmatch(r"done-(\d+)", n))]
        self.next = max(done, default=0)

    def batch(self, size: int | None) -> tuple[DataFrame, int] | None:
        """Rows of the next places and where they end; None at the end of the list. What has got attributes meanwhile, from a
        batch whose marker is missing or from another writer, is left out."""
        if self.next >= self.size:
            return None
        end = self.size if size is None else min(self.size, self.next + size)
        known = self.index.table("attributes").select("domain", "sha256")
        rows = self.rows.filter(F.col("position").between(self.next, end - 1)).drop("position")
        return rows.join(known, ["domain", "sha256"], "left_anti"), end

    def mark(self, end: int) -> None:
        self.index._files().create(self.index._path(*self.place, f"done-{end}"), True).close()
        self.next = end

    def close(self) -> None:
        self.index._files().delete(self.index._path(*self.place), True)


def scan_pass(index: Index, config: audit.AuditConfig | None = None, limit: int | None = None, dry_run: bool = False, should_stop: Callable[[], bool] = lambda: False) -> dict[str, Any]:
    """One pass in batches of config.batch rows (all at once if it is None); each is written before it is reported or stored, so
    that a model is asked once a content. Goes on with a pass of the same kind that didn't end; what came after that was
    staged is the next pass's. A dry run reads once and stores nothing."""
    config = config or audit.AuditConfig()
    total: dict[str, Any] = {"scanned": 0, "skipped": 0, "flagged": 0, "errors": 0}
    if should_stop() or limit is not None and limit <= 0:
        return total | {"dry_run": dry_run}
    if dry_run:
        tables = index.tables()
        evaluated = _evaluated(index, audit.work(tables["documents"], tables["chunks"], tables["attributes"], limit), config)
        return audit.report(evaluated).first().asDict() | {"dry_run": True}
    queue = Queue(index, config, limit)
    while not should_stop():
        found = queue.batch(config.batch)
        if found is None:
            queue.close()
            break
        evaluated = _evaluated(index, found[0], config)
        said = audit.report(evaluated).first().asDict()
        if said["scanned"]:
            total = {k: total[k] + said[k] for k in said} | {k: v for k, v in total.items() if k not in said}
            base, known = index.version(), index.table("attributes")
            new = insert_absent(known.limit(0), audit.results(evaluated, config)).join(known, ["domain", "sha256"], "left_anti")
            index.commit({"attributes": Change(new.select("sha256").limit(0), new)}, base)
        queue.mark(found[1])
        if config.post_scan and said["scanned"]:
            try:
                config.post_scan(evaluated)
            except Exception as e:  # what is stored stays
                total["post_scan_error"] = type(e).__name__
    return total | {"dry_run": dry_run}


def _evaluated(index: Index, rows: DataFrame, config: audit.AuditConfig) -> DataFrame:
    staged = f"{index.root.rstrip('/')}/staged/audit-{uuid.uuid4().hex}"
    audit.evaluate(rows, config).write.parquet(staged)
    return index.spark.read.parquet(staged)


def scan_loop(index: Index, config: audit.AuditConfig | None = None, interval: float = 60.0, limit: int | None = None, dry_run: bool = False, passes: int | None = None, should_stop: Callable[[], bool] = lambda: False, wait: Callable[[float], None] | None = None, emit: Callable[[dict], None] = print) -> int:
    """Passes with pauses between them; gives the number of passes. A pass that fails is told by its class, and the next one
    tries again."""
    import time

    done = 0
    while not should_stop():
        try:
            emit(scan_pass(index, config, limit, dry_run, should_stop))
        except Exception as e:
            emit({"error": type(e).__name__})
        done += 1
        if passes is not None and done >= passes:
            break
        (wait or time.sleep)(interval)
    return done


def reset(index: Index, dry_run: bool = False, **selection: Any) -> int:
    """Takes results of the scanner away (see audit.reset) so that content is scanned again; gives the number of rows chosen."""
    base, attributes = index.version(), index.table("attributes")
    chosen = attributes.filter(audit.chosen(**selection))
    count = chosen.count()
    if count and not dry_run:
        # Both domains of a hash are one key.
        rows = attributes.join(chosen.select("sha256").distinct(), "sha256", "left_semi").select(*attributes.columns)
        index.commit({"attributes": Change(rows.select("sha256"), audit.reset(rows, **selection))}, base)
    return count


def file_report(spark: Any, name: str, text: str, config: audit.AuditConfig | None = None) -> dict[str, Any]:
    """One text's result, without an index."""
    rows = spark.createDataFrame([("document", text, [name])], "domain string, content string, source_paths array<string>")
    row = audit.evaluate(rows.withColumn("sha256", F.sha2("content", 256)), config).select("sha256", "risk_score", "findings", F.col("llm.status").alias("status"), "skip_reason").first()
    return {"file": name} | row.asDict(recursive=True)
