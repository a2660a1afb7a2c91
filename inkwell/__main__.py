"""python -m inkwell --config inkwell.toml check-config | ingest | watch | vacuum | audit scan | run | reset | check-config | scan-file FILE"""

from __future__ import annotations

import argparse
import importlib
import inspect
import json
import sys
import tomllib
from pathlib import Path
from typing import Any

KEYS = {"vault": str, "index": str, "events": str, "target_tokens": int, "overlap_tokens": int, "max_input_tokens": int, "dimensions": int, "hooks": list, "quiet_seconds": float, "reconcile_seconds": int, "retries": int, "audit": dict}
AUDIT_KEYS = {"key": str, "prompt": str, "max_chunk_chars": int, "max_document_chars": int, "batch_size": int, "interval_seconds": int, "hooks": dict}
AUDIT_HOOKS = {"pre_scan": 0, "on_oversize": 1, "heuristic_rules": 1, "prompt_context": 1, "risk_policy": 1, "post_scan": 1}


def checked(raw: dict[str, Any], keys: dict[str, type], where: str = "") -> None:
    for key, value in raw.items():
        if key not in keys or not isinstance(value, keys[key]) or isinstance(value, bool):
            raise ValueError(f"bad setting: {where}{key}")


def named(spec: str, arguments: int) -> Any:
    """A function named as module:name that takes so many arguments."""
    module, _, name = spec.partition(":")
    try:
        found = getattr(importlib.import_module(module), name)
        inspect.signature(found).bind(*[None] * arguments)
    except (ImportError, AttributeError, TypeError, ValueError) as e:
        raise ValueError(f"bad hook: {spec}") from e
    return found


def load_config(path: str) -> dict[str, Any]:
    """Paths are relative to the file; unknown keys and wrong types are errors. Hooks are loaded from beside the file, too."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    checked(raw, KEYS)
    checked(raw.get("audit", {}), AUDIT_KEYS, "audit.")
    for key in ("vault", "index"):
        if key not in raw:
            raise ValueError(f"{key} is missing")
    home = Path(path).resolve().parent
    if str(home) not in sys.path:
        sys.path.append(str(home))
    slots = raw.get("audit", {}).get("hooks", {})
    checked(slots, dict.fromkeys(AUDIT_HOOKS, str), "audit.hooks.")
    hooks = {slot: named(spec, AUDIT_HOOKS[slot]) for slot, spec in slots.items()}
    out = raw | {k: str(home / raw[k]) for k in ("vault", "index", "events") if k in raw and "://" not in raw[k]}
    return out | {"hooks": [named(x, 2) for x in raw.get("hooks", [])], "audit": raw.get("audit", {}) | {"hooks": hooks}}


def audit_config(raw: dict[str, Any]) -> Any:
    from inkwell.operators.audit import AuditConfig

    config = AuditConfig(**{k: raw[k] for k in ("key", "prompt") if k in raw}, batch=raw.get("batch_size"), **raw["hooks"])
    config.limits |= {k: raw[f"max_{k}_chars"] for k in config.limits if f"max_{k}_chars" in raw}
    return config


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="inkwell")
    parser.add_argument("--config", default="inkwell.toml")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("check-config", "ingest", "watch", "vacuum"):
        commands.add_parser(name)
    audit = commands.add_parser("audit").add_subparsers(dest="audit", required=True)
    for name in ("scan", "run"):
        scan = audit.add_parser(name)
        scan.add_argument("--limit", type=int)
        scan.add_argument("--dry-run", action="store_true")
        if name == "run":
            scan.add_argument("--passes", type=int)
    audit.add_parser("check-config")
    again = audit.add_parser("reset")
    again.add_argument("--domain", choices=("chunk", "document"))
    again.add_argument("--sha256")
    again.add_argument("--status", action="append", default=[])
    again.add_argument("--min-risk", type=int)
    again.add_argument("--dry-run", action="store_true")
    one = audit.add_parser("scan-file")
    one.add_argument("file")
    one.add_argument("--fail-above", type=int)
    options = parser.parse_args(arguments)
    try:
        config = load_config(options.config)
    except (OSError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    if options.command == "check-config" or getattr(options, "audit", None) == "check-config":
        print("ok")
        return 0
    return run(options, config)


def run(options: argparse.Namespace, config: dict[str, Any]) -> int:
    from pyspark.sql import SparkSession

    from inkwell.plans import scan
    from inkwell.plans.ingest import Embedding, ingest
    from inkwell.sources.index import Index
    from inkwell.sources.markdown import Chunking, Parsing, project_id_from_path
    from inkwell.streaming.watch import read_events, vault_events, watch

    spark = SparkSession.builder.appName("inkwell").getOrCreate()
    index = Index(spark, config["index"])
    chunking = Chunking(config.get("target_tokens", 400), config.get("overlap_tokens", 50), config.get("max_input_tokens", 512))
    parsing = Parsing(chunking, (project_id_from_path, *config["hooks"]))
    embedding = Embedding(config.get("dimensions", 384))
    if options.command == "ingest":
        found = ingest(index, config["vault"], parsing, embedding)
        print(json.dumps(found))
        return int(bool(found["unresolved_errors"]) or not found["discovery_complete"])
    if options.command == "vacuum":
        print(json.dumps({"deleted": index.vacuum()}))
        return 0
    if options.command == "watch":
        # Events come from the vault itself, or from files that another observer writes.
        events = read_events(spark, config["events"]) if "events" in config else vault_events(spark, config["vault"], config["index"] + "/listings")
        query = watch(
            index, config["vault"], events, config["index"] + "/stream", parsing, embedding, "200 milliseconds", config.get("retries", 3),
            quiet=config.get("quiet_seconds", 0.2), reconcile=config.get("reconcile_seconds", 300), scan_first=True,
        )
        query.awaitTermination()
        return 0
    settings = audit_config(config["audit"])
    if options.audit == "scan":
        print(json.dumps(scan.scan_pass(index, settings, options.limit, options.dry_run)))
        return 0
    if options.audit == "run":
        scan.scan_loop(index, settings, config["audit"].get("interval_seconds", 60), options.limit, options.dry_run, options.passes, emit=lambda r: print(json.dumps(r), flush=True))
        return 0
    if options.audit == "reset":
        n = scan.reset(index, options.dry_run, key=settings.key, domain=options.domain, sha256=options.sha256, statuses=tuple(options.status), least_risk=options.min_risk)
        print(json.dumps({"chosen": n, "dry_run": options.dry_run}))
        return 0
    found = scan.file_report(spark, options.file, Path(options.file).read_text(encoding="utf-8-sig"), settings)
    print(json.dumps(found))
    return int(options.fail_above is not None and found["risk_score"] > options.fail_above)


if __name__ == "__main__":
    sys.exit(main())
