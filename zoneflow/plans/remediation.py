"""Promote repaired quarantine rows.

Quarantine itself is never rewritten: it stays the record of what arrived. Rows
that hold every rule after repair go to the ``promoted`` zone, from where
``raw_to_structured`` takes them along with raw; the rest go to ``unresolved``.
Both zones are replaced per batch, so promoting twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from zoneflow import storage
from zoneflow.config import COPIES, PROMOTED, QUARANTINE, UNRESOLVED, SourceConfig
from zoneflow.operators.contract import missing_columns
from zoneflow.operators.remediation import remediate
from zoneflow.sources.sinks import write_batches
from zoneflow.sources.zones import batches_by_schema, read_batches

ORIGIN = "remediated"


def promote(spark: SparkSession, cfg: SourceConfig, months: Sequence[str]) -> list[str]:
    """Repair the quarantine of ``months``; returns the months looked at.

    Months rejected as a whole for missing columns cannot be repaired row by row
    and are left alone, as are months without a quarantine.
    """
    known = set(storage.batch_months(spark, cfg, QUARANTINE))
    done: list[str] = []
    present = [month for month in months if month in known]
    for group in batches_by_schema(spark, cfg, QUARANTINE, present):
        rejected = read_batches(spark, cfg, QUARANTINE, group).drop(COPIES)
        if missing_columns(rejected, cfg.required):
            continue
        judged = remediate(rejected)
        holds = F.col("quarantine_reason").isNull()
        promoted = judged.filter(holds).drop("quarantine_reason", "original_reason")
        promoted = promoted.withColumn("origin", F.lit(ORIGIN))
        write_batches(promoted, cfg, PROMOTED, group, gather=True)
        write_batches(judged.filter(~holds), cfg, UNRESOLVED, group, gather=True)
        done += group
    return sorted(done)
