"""Command line of the jobs, for ``spark-submit`` or ``python -m zoneflow``.

    python -m zoneflow run       --root s3a://lake --source yellow-trips --month 2024-01
    python -m zoneflow backfill  --root s3a://lake --source yellow-trips --month 2024-01 --last 2024-12
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from zoneflow.config import (
    FORMATS,
    QUARANTINE,
    STRUCTURED,
    OutlierLimits,
    QualityTargets,
    SourceConfig,
    months_between,
)
from zoneflow.operators.remediation import recovery_report, remediate
from zoneflow.plans import monitoring, pipeline, reports
from zoneflow.plans.remediation import promote
from zoneflow.session import build_session
from zoneflow.sources.manifest import batch_status
from zoneflow.sources.sinks import BATCH_KEYS, register_zone
from zoneflow.sources.zones import read_quarantine, read_structured
from zoneflow.storage import batch_months
from zoneflow.streaming.arrivals import ingest_stream

COMMANDS = {
    "status": "which months are ready, absent or broken",
    "landing-to-raw": "validate months and quarantine rejected rows",
    "raw-to-structured": "cast, enrich and clean months",
    "run": "both jobs for one month",
    "backfill": "both jobs for the months up to --last",
    "watch": "both jobs for months with files that arrived since the last time",
    "promote": "repair the quarantine of months and promote what holds the rules",
    "register": "make structured a table of the session's catalog",
    "report": "print the reports",
    "alerts": "print months that miss a quality target",
}


def parse(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(
        prog="zoneflow",
        formatter_class=argparse.RawDescriptionHelpFormatter,
        epilog="\n".join(f"{name:18s} {what}" for name, what in COMMANDS.items()),
    )
    parser.add_argument("command", choices=COMMANDS)
    parser.add_argument("--root", help="where the zones lie")
    parser.add_argument("--source")
    parser.add_argument("--config", help="JSON file with a source's parameters, instead of both")
    parser.add_argument("--format", default="parquet", choices=FORMATS, help="of landing files")
    parser.add_argument("--month", help="YYYY-MM")
    parser.add_argument("--last", help="YYYY-MM, for a range of months")
    parser.add_argument("--mode", default="replace", choices=("replace", "append"))
    parser.add_argument("--checkpoint", help="of watch; defaults to a directory in the lake")
    parser.add_argument("--output", help="directory for results as CSV, instead of printing them")
    parser.add_argument("--conf", action="append", default=[], help="a session setting, key=value")
    args = parser.parse_args(argv)
    if not args.config and not (args.root and args.source):
        parser.error("give --config, or --root and --source")
    return args


def source(args: argparse.Namespace) -> SourceConfig:
    """The source of the command line: from its file, or from root, source and format."""
    if not args.config:
        return SourceConfig(root=args.root, source=args.source, fmt=args.format)
    params = json.loads(Path(args.config).read_text())
    nested = {"limits": OutlierLimits, "targets": QualityTargets}
    made = {k: nested[k](**v) if k in nested else v for k, v in params.items()}
    if "required" in made:
        made["required"] = tuple(made["required"])
    return SourceConfig.from_mapping(made)


def emit(df: DataFrame, name: str, args: argparse.Namespace) -> None:
    """All rows, to a directory of that name or to standard output, tab-separated."""
    if args.output:
        df.write.mode("overwrite").option("header", True).csv(f"{args.output.rstrip('/')}/{name}")
        return
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if value is None else str(value) for value in row))


def run(spark: SparkSession, args: argparse.Namespace) -> int:
    """Do what the command line asks for; 1 if a month failed."""
    cfg = source(args)
    months = months_between(args.month, args.last or args.month) if args.month else []
    if not months and args.command not in ("watch", "register", "report", "alerts"):
        raise SystemExit(f"{args.command} needs --month")
    match args.command:
        case "status":
            emit(batch_status(spark, cfg, months).orderBy("batch_month"), "status", args)
        case "landing-to-raw":
            emit(pipeline.landing_to_raw(spark, cfg, months).quality(), "quality", args)
        case "raw-to-structured":
            report = pipeline.raw_to_structured(spark, cfg, months, args.mode)
            emit(report.outliers(), "outliers", args)
            emit(report.statistics(), "statistics", args)
        case "run" | "backfill":
            report = pipeline.run_months(spark, cfg, months)
            print(f"done: {report.months}, skipped: {report.skipped}, failed: {report.failed}")
            emit(report.quality(), "quality", args)
            emit(report.outliers(), "outliers", args)
            return int(bool(report.failed))
        case "watch":
            checkpoint = args.checkpoint or f"{cfg.root}/_checkpoints/{cfg.source}"
            ingest_stream(spark, cfg, checkpoint).awaitTermination()
        case "promote":
            done = promote(spark, cfg, months)
            if done:
                judged = remediate(read_quarantine(spark, cfg, done))
                emit(recovery_report(judged), "recovery", args)
        case "register":
            if spark.conf.get("spark.sql.catalogImplementation") == "in-memory":
                raise SystemExit("register needs a lasting catalog: give its settings by --conf")
            register_zone(spark, cfg.table, cfg.zone_root(STRUCTURED))
            register_zone(spark, f"quarantine_{cfg.table}", cfg.zone_root(QUARANTINE), BATCH_KEYS)
        case "report":
            trips = read_structured(spark, cfg, months or None)
            for name in reports.TRIP_REPORTS:
                print(name)
                emit(reports.trip_report(name, trips), name, args)
            known = set(batch_months(spark, cfg, QUARANTINE))
            wanted = sorted(known.intersection(months)) if months else sorted(known)
            for name in reports.QUARANTINE_REPORTS if wanted else ():
                print(name)
                emit(reports.quarantine_report(name, read_quarantine(spark, cfg, wanted)), name, args)
        case "alerts":
            quality = monitoring.quality_over_time(spark, cfg, months or None)
            alerts = monitoring.quality_alerts(quality, cfg.targets)
            emit(alerts.orderBy("batch_month", "alert"), "alerts", args)
    return 0


def main(argv: Sequence[str] | None = None) -> None:
    args = parse(argv)
    settings = dict(pair.split("=", 1) for pair in args.conf)
    spark = build_session(f"zoneflow {args.command}", **settings)
    failed = run(spark, args)
    spark.stop()
    if failed:
        raise SystemExit(failed)


if __name__ == "__main__":
    main()
