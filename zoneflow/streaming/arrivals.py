"""Process months as their files arrive.

A file stream alone knows files by name and by their rows: one without rows brings nothing
to process, and one delivered again under its old name is taken for known. So the landed
files are compared with a ledger of those seen, by path, size and time; what differs is
added to the ledger, and the stream reads the ledger.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from zoneflow import paths
from zoneflow.config import SourceConfig
from zoneflow.plans.pipeline import run_months
from zoneflow.sources.manifest import MANIFEST, landing_manifest

LEDGER = f"{MANIFEST}, seen_at timestamp"
_STATE = ("file_size_bytes", "ingestion_timestamp")


def _ledger_path(spark: SparkSession, checkpoint: str) -> str:
    path = f"{checkpoint.rstrip('/')}/ledger"
    fs, hadoop_path = paths.open_path(spark, path)
    fs.mkdirs(hadoop_path)
    return path


def unseen_files(spark: SparkSession, cfg: SourceConfig, checkpoint: str) -> DataFrame:
    """Landed files that are not in the ledger as they are now. Reads no content."""
    ledger = spark.read.schema(LEDGER).parquet(_ledger_path(spark, checkpoint))
    last = ledger.groupBy("source_file").agg(F.max_by(F.struct(*_STATE), "seen_at").alias("last"))
    known = last.select("source_file", "last.*")
    return landing_manifest(spark, cfg).join(known, ["source_file", *_STATE], "left_anti")


def note_arrivals(spark: SparkSession, cfg: SourceConfig, checkpoint: str) -> None:
    """Add to the ledger what has arrived or changed since it was last looked at.

    A run that dies here has noted some files or none; the next one notes the others.
    """
    fresh = unseen_files(spark, cfg, checkpoint)
    if not fresh.isEmpty():
        noted = fresh.withColumn("seen_at", F.current_timestamp())
        noted.write.mode("append").parquet(_ledger_path(spark, checkpoint))


def arrivals(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Stream of the ledger: a row for each file that arrived or changed."""
    return spark.readStream.schema(LEDGER).parquet(_ledger_path(spark, checkpoint))


def ingest_stream(
    spark: SparkSession,
    cfg: SourceConfig,
    checkpoint: str,
    run_ts: datetime | None = None,
) -> StreamingQuery:
    """Run both jobs for every month with new or changed files, then stop.

    Each month that got a file is processed again as a whole and replaced, so a
    micro-batch that is repeated after a failure does no harm. A file without rows counts,
    and so does one that was delivered again under its old name; files that were taken away
    do not. A month that fails stops the stream after the others are done, and the next run
    with the same ``checkpoint`` tries its files again; otherwise it sees only what arrived
    since.
    """

    def process(batch: DataFrame, _: int) -> None:
        months = sorted(row.date_param for row in batch.select("date_param").distinct().collect())
        if months:
            report = run_months(batch.sparkSession, cfg, months, run_ts)
            if report.failed:
                raise RuntimeError(f"months that failed: {', '.join(report.failed)}")

    note_arrivals(spark, cfg, checkpoint)
    return (
        arrivals(spark, checkpoint)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream")
        .trigger(availableNow=True)
        .start()
    )
