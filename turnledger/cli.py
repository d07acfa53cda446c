"""Command line: inspect, inspect-trace, export-evidence, export-trace-evidence, verify-evidence, audit-samples."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from pathlib import Path
from typing import NamedTuple

from pyspark.sql import SparkSession

from turnledger import __version__
from turnledger.operators.attribution import attribution_totals, retention, sample_counts
from turnledger.operators.contract import EXIT_CODES
from turnledger.report import render
from turnledger.session import build_session, discard
from turnledger.sinks.evidence import export_bundle, report_of, verify_bundle, write_cases
from turnledger.sources.captures import CaptureError, handoffs

#: What an audit exits with (fixed values).
AUDIT_CODES = {"MATCHED": 0, "UNMATCHED": 1, "AMBIGUOUS": 3, "NO_TRAINABLE_TOKENS": 3}
COUNTS = ("generated", "trainable", "unmatched", "ambiguous", "duplicate", "unaccounted")


class Command(NamedTuple):
    run: Callable[[SparkSession, argparse.Namespace], dict]
    arguments: dict[str, dict] = {"source": {}}
    text: Callable[[dict], str] = render
    code: Callable[[dict], int] = lambda report: EXIT_CODES[report["status"]]


def _exported(report: dict, folder: str) -> dict:
    return report | {"export": {"kind": "witness_only", "directory": folder}}


def _trace(spark: SparkSession, args: argparse.Namespace) -> dict:
    report = report_of(spark, args.source, "trace")
    if args.cases_dir is None or report["status"] == "ERROR":
        return report
    write_cases(spark, args.source, report, args.cases_dir)
    return _exported(report, args.cases_dir)


def _audit(spark: SparkSession, args: argparse.Namespace) -> dict:
    files, turns, samples = handoffs(spark, Path(args.source).resolve().as_uri())
    (digest, error), = files.select("sha256", "error").collect() or [(None, "malformed:json")]
    if error:
        raise CaptureError(error)
    plain = lambda df, order: [r.asDict() for r in df.drop("path").orderBy(order).collect()]
    totals = plain(attribution_totals(turns, samples, scope=["path"]), "status") or [dict.fromkeys(COUNTS, 0) | {"status": "NO_TRAINABLE_TOKENS"}]
    counts = sample_counts(samples, keys=["path", "sample_id"]).withColumnRenamed("sample_id", "sample_index")
    return totals[0] | {"turns": plain(retention(turns, samples, scope=["path"]), "turn_id"), "samples": plain(counts, "sample_index"), "sha256": digest, "require_all_generated": args.require_all_generated}


def _audit_text(report: dict) -> str:
    if report["status"] == "ERROR":
        return render(report)
    parts = [f"{k}: {v}" for k, v in report.items() if not isinstance(v, list)]
    return "\n".join([*parts, *(", ".join(f"{k} {v}" for k, v in r.items()) for part in ("turns", "samples") for r in report[part])])


def _audit_code(report: dict) -> int:
    if report["status"] == "ERROR":
        return EXIT_CODES["ERROR"]
    return 1 if report["require_all_generated"] and report["unaccounted"] else AUDIT_CODES[report["status"]]


_BOTH = {"source": {}, "destination": {}}
COMMANDS = {
    "inspect": Command(lambda spark, args: report_of(spark, args.source, "case")),
    "inspect-trace": Command(_trace, {"source": {}, "--cases-dir": {}}),
    "export-evidence": Command(lambda spark, args: _exported(export_bundle(spark, args.source, args.destination, "case"), args.destination), _BOTH),
    "export-trace-evidence": Command(lambda spark, args: _exported(export_bundle(spark, args.source, args.destination, "trace"), args.destination), _BOTH),
    "verify-evidence": Command(lambda spark, args: verify_bundle(spark, args.source)),
    "audit-samples": Command(_audit, {"source": {}, "--require-all-generated": {"action": "store_true"}}, _audit_text, _audit_code),
}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="turnledger", description="Checks of token-level rollout records")
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("--scratch", help="a folder for intermediate tables that all executors share; needed off a local master")
    sub = top.add_subparsers(dest="command", required=True)
    for name, command in COMMANDS.items():
        own = sub.add_parser(name)
        for argument, how in {**command.arguments, "--format": {"choices": ("json", "text"), "default": "json"}}.items():
            own.add_argument(argument, **how)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    given = spark is not None
    if not given:
        spark = build_session("turnledger", "local[*]", spark__sql__shuffle__partitions=8, **({"spark__checkpoint__dir": args.scratch} if args.scratch else {}))
    command = COMMANDS[args.command]
    try:
        if not Path(args.source).exists():
            raise CaptureError(f"no such file: {args.source}")
        report = command.run(spark, args)
    except (OSError, CaptureError, RecursionError) as error:
        report = {"status": "ERROR", "reason": str(error)}
    finally:
        if not given:
            discard(spark)
    print(command.text(report) if args.format == "text" else json.dumps(report, indent=2, ensure_ascii=False, default=str))
    return command.code(report)


if __name__ == "__main__":
    sys.exit(main())
