"""The jobs: landing → raw and quarantine → structured, for any number of months."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow import versions
from zoneflow.config import (
    COPIES,
    LANDING,
    PROMOTED,
    QUARANTINE,
    RAW,
    STRUCTURED,
    STRUCTURED_COLUMNS,
    UNRESOLVED,
    SourceConfig,
    months_between,
)
from zoneflow.functions.rules import MISSING_COLUMNS
from zoneflow.operators.contract import (
    SchemaContractError,
    canonical_names,
    missing_columns,
    union_all,
    with_maps,
    without_maps,
)
from zoneflow.operators.enrich import structure
from zoneflow.operators.quality import split_counted
from zoneflow.plans import monitoring
from zoneflow.plans.remediation import promote
from zoneflow.sources.manifest import FAILED, READY, SKIP, batch_status
from zoneflow.sources.sinks import DAYS_PER_MONTH, gather_days, write_batches, write_structured
from zoneflow.sources.zones import (
    batch_month,
    batches_by_schema,
    promoted_months,
    read_batches,
)


@dataclass(frozen=True)
class BatchReport:
    """What a run did; its figures are kept beside the zones and read when asked for."""

    spark: SparkSession = field(repr=False)
    cfg: SourceConfig
    months: tuple[str, ...]
    skipped: tuple[str, ...] = ()
    failed: tuple[str, ...] = ()

    def quality(self) -> DataFrame:
        """Input, valid and rejected rows, rates and status per month."""
        return monitoring.quality_over_time(self.spark, self.cfg, self.months)

    def outliers(self) -> DataFrame:
        """Rows before and after outlier removal per month."""
        return monitoring.outliers_over_time(self.spark, self.cfg, self.months)

    def structured(self) -> DataFrame:
        """Outliers and statistics per month, in one scan."""
        return monitoring.structured_over_time(self.spark, self.cfg, self.months)

    def statistics(self) -> DataFrame:
        """Statistics of the structured rows per month."""
        return monitoring.statistics_over_time(self.spark, self.cfg, self.months)


@dataclass
class _Split:
    """What became of the months of a run: groups done, and why others were not."""

    done: list[list[str]] = field(default_factory=list)
    lacking: dict[str, list[str]] = field(default_factory=dict)
    broken: dict[str, str] = field(default_factory=dict)

    def raise_failures(self) -> None:
        if self.broken:
            raise ValueError("; ".join(self.broken[m] for m in sorted(self.broken)))
        if self.lacking:
            names = sorted({name for missing in self.lacking.values() for name in missing})
            raise SchemaContractError(names, sorted(self.lacking))


def _split_landing(
    spark: SparkSession,
    cfg: SourceConfig,
    months: Sequence[str],
    run_ts: datetime | None,
    dedup: bool = False,
) -> _Split:
    """Write raw, quarantine and the run's figures, one group of one schema at a time."""
    run_ts = run_ts or datetime.now(UTC)
    split = _Split()
    for group in batches_by_schema(spark, cfg, LANDING, months, split.broken):
        landed = read_batches(spark, cfg, LANDING, group, run_ts)
        landed = canonical_names(landed, cfg.columns)
        repaired = promoted_months(spark, cfg, group)
        if missing := missing_columns(landed, cfg.required):
            quarantine_batches(landed, cfg, group)
            monitoring.write_metrics(spark, cfg, group)
            split.lacking.update(dict.fromkeys(group, missing))
            for zone in (PROMOTED, UNRESOLVED):
                versions.remove(spark, cfg.zone_root(zone), group)
            continue
        valid, rejected = split_counted(landed)
        if dedup:
            valid = with_maps(without_maps(valid).dropDuplicates(), valid.schema)
        with ThreadPoolExecutor(2) as pool:
            # Both writes at once: the small one runs in the gaps of the large one.
            writes = [
                pool.submit(write_batches, valid, cfg, RAW, group, gather=dedup),
                pool.submit(write_batches, rejected, cfg, QUARANTINE, group, gather=True),
            ]
        for write in writes:
            write.result()
        # Equal valid rows that were dropped are counted from footers, in no column.
        monitoring.write_metrics(spark, cfg, group, landed if dedup else None)
        # What was promoted is judged again and replaced at once: until then the zone says
        # which months that are, so a run that fails here is made good by the next.
        if repaired:
            promote(spark, cfg, repaired)
        split.done.append(group)
    return split


def landing_to_raw(
    spark: SparkSession,
    cfg: SourceConfig,
    months: Sequence[str],
    run_ts: datetime | None = None,
    dedup: bool = False,
) -> BatchReport:
    """Split landed months into raw (valid rows) and quarantine (distinct rejected rows).

    Raw is written straight off the scan, without a shuffle; only rejected rows are
    shuffled. A month that lacks required columns goes to quarantine as a whole; the
    error for it, or for files that cannot be read together, is raised after the other
    months are done. ``dedup`` also keeps equal valid rows only once.
    """
    _split_landing(spark, cfg, months, run_ts, dedup).raise_failures()
    return BatchReport(spark, cfg, tuple(months))


def quarantine_batches(df: DataFrame, cfg: SourceConfig, months: Sequence[str]) -> None:
    """Send whole months to quarantine because columns are missing."""
    versions.remove(df.sparkSession, cfg.zone_root(RAW), months)
    flagged = df.withColumns({COPIES: F.lit(1).cast("bigint"), "quarantine_reason": F.lit(MISSING_COLUMNS)})
    write_batches(flagged, cfg, QUARANTINE, months, gather=False)


def _structure_raw(
    spark: SparkSession,
    cfg: SourceConfig,
    months: Sequence[str],
    groups: Sequence[Sequence[str]],
    mode: str,
) -> dict[str, list[str]]:
    """Write structured from raw months, each group of which has one schema.

    Returns the months that lack columns, which are left as they were, and the columns.
    """
    lacking: dict[str, list[str]] = {}
    parts: list[DataFrame] = []
    scans = [(RAW, group) for group in groups]
    promoted = promoted_months(spark, cfg, months)
    scans += [(PROMOTED, group) for group in batches_by_schema(spark, cfg, PROMOTED, promoted)]
    for zone, group in scans:
        raw = read_batches(spark, cfg, zone, group)
        if missing := missing_columns(raw, STRUCTURED_COLUMNS):
            lacking.update(dict.fromkeys(group, missing))
            continue
        raw = raw.withColumn("batch_month", batch_month()).drop("year", "month")
        parts.append(structure(gather_days(raw, DAYS_PER_MONTH * len(group)), cfg.limits))
    whole = [month for month in months if month not in lacking]
    if parts and whole:
        clean = union_all(parts)
        if lacking:
            clean = clean.filter(F.col("batch_month").isin(whole))
        write_structured(clean, cfg, whole, mode, gather=False)
    return lacking


def raw_to_structured(
    spark: SparkSession, cfg: SourceConfig, months: Sequence[str], mode: str = "replace"
) -> BatchReport:
    """Cast, enrich and clean raw months (with their promoted rows) into structured.

    Months that lack columns raise after the others are done.
    """
    groups = batches_by_schema(spark, cfg, RAW, months)
    _Split(lacking=_structure_raw(spark, cfg, months, groups, mode)).raise_failures()
    return BatchReport(spark, cfg, tuple(months))


def run_months(
    spark: SparkSession,
    cfg: SourceConfig,
    months: Sequence[str],
    run_ts: datetime | None = None,
) -> BatchReport:
    """Both jobs for the months that are ready; the others are reported, not run.

    A month that lacks required columns counts as failed; its rows are in quarantine.
    So does one whose files cannot be read, alone or together.
    """
    status = {row.batch_month: row.status for row in batch_status(spark, cfg, months).collect()}
    ready = [m for m in months if status[m] == READY]
    split = _split_landing(spark, cfg, ready, run_ts)
    versions.remove(spark, cfg.zone_root(STRUCTURED), split.lacking)
    stopped = {*split.lacking, *split.broken}
    taken = [month for month in ready if month not in stopped]
    stopped |= set(_structure_raw(spark, cfg, taken, split.done, "replace"))
    failed = [m for m in months if status[m] == FAILED or m in stopped]
    skipped = [m for m in months if status[m] == SKIP]
    done = [m for m in taken if m not in stopped]
    return BatchReport(spark, cfg, tuple(done), tuple(skipped), tuple(failed))


def run_month(
    spark: SparkSession, cfg: SourceConfig, month: str, run_ts: datetime | None = None
) -> BatchReport:
    """One month end to end; nothing happens if it has not landed."""
    return run_months(spark, cfg, [month], run_ts)


def run_range(
    spark: SparkSession,
    cfg: SourceConfig,
    first: str,
    last: str,
    run_ts: datetime | None = None,
) -> BatchReport:
    """Backfill ``first`` to ``last``: one pass over all months, not one job per month."""
    return run_months(spark, cfg, months_between(first, last), run_ts)
