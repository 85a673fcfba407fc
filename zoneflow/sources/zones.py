"""Readers of the zones."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zoneflow import storage, versions
from zoneflow.config import (
    COPIES,
    LANDING,
    MALFORMED,
    PICKUP,
    PROMOTED,
    QUARANTINE,
    RAW,
    STRUCTURED,
    TRIP_TYPES,
    SourceConfig,
)
from zoneflow.functions.features import time_features, trip_metrics
from zoneflow.operators.contract import canonical_names, retyped_columns, schema_drift, union_all
from zoneflow.sources.survey import first_lines, survey

BATCH_KEYS = ("year", "month")
TRACE_TYPES = {"ingestion_timestamp": "timestamp", "source_file": "string"}


def path_part(name: str, digits: int) -> Column:
    """A path column as text with its leading zeros, whichever type it was read as."""
    return F.lpad(F.col(name).cast("string"), digits, "0")


def batch_month() -> Column:
    """``YYYY-MM`` from the path columns."""
    return F.concat(path_part("year", 4), F.lit("-"), path_part("month", 2))


def with_trace(df: DataFrame, run_ts: datetime) -> DataFrame:
    """When a row was taken in (UTC) and from which file; use it right on a scan."""
    return df.withColumns(
        {
            "ingestion_timestamp": F.lit(run_ts if run_ts.tzinfo else run_ts.replace(tzinfo=UTC)),
            "source_file": F.col("_metadata.file_path"),
        }
    )


def _months(spark: SparkSession, cfg: SourceConfig, zone: str, months: Sequence[str] | None) -> list[str]:
    months = storage.batch_months(spark, cfg, zone) if months is None else list(months)
    if not months:
        raise ValueError(f"{zone} of {cfg.source} holds none of the batches asked for")
    return months


def batch_paths(
    spark: SparkSession, cfg: SourceConfig, zone: str, months: Sequence[str] | None
) -> list[str]:
    """The directories of the months asked for, or of all there are."""
    return [cfg.batch_path(zone, month) for month in _months(spark, cfg, zone, months)]


def _text(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in (*names, MALFORMED)])


def _csv_headers(
    spark: SparkSession, files: Sequence[str]
) -> dict[str, tuple[str, ...] | Exception]:
    """Each file's header as Spark reads it: one job, and one per first line that differs."""

    def header(file: str) -> tuple[str, ...] | Exception:
        try:
            return tuple(spark.read.option("header", True).csv(file).columns)
        except (PySparkException, Py4JError) as error:
            return error

    heads = first_lines(spark, files)
    spoken: dict[str, str] = {}
    for file in files:
        spoken.setdefault(heads.get(file, file), file)
    with ThreadPoolExecutor(storage.THREADS) as pool:
        read = dict(zip(spoken, pool.map(header, spoken.values()), strict=True))
    return {file: read[heads.get(file, file)] for file in files}


def _csv_scans(spark: SparkSession, cfg: SourceConfig, paths: Sequence[str]) -> list[DataFrame]:
    """One scan per header, all columns text, since files may order theirs differently."""
    found = [file for path in paths for file in storage.files(spark, path)]
    groups: dict[tuple[str, ...], list[str]] = {}
    for file, names in _csv_headers(spark, found).items():
        if isinstance(names, Exception):
            raise names
        groups.setdefault(names, []).append(file)
    reader = spark.read.option("header", True).option("enforceSchema", False)
    reader = reader.option("columnNameOfCorruptRecord", MALFORMED)
    reader = reader.option("basePath", cfg.zone_root(LANDING))
    if not groups:
        return [reader.schema(_text(tuple(TRIP_TYPES))).csv(list(paths))]
    return [reader.schema(_text(names)).csv(group) for names, group in groups.items()]


def _json_scan(spark: SparkSession, cfg: SourceConfig, paths: Sequence[str]) -> DataFrame:
    """All keys the files have, as text; one pass over the data finds them."""
    reader = spark.read.option("columnNameOfCorruptRecord", MALFORMED).option("primitivesAsString", True)
    reader = reader.option("basePath", cfg.zone_root(LANDING))
    found = reader.json(list(paths)).drop("year", "month").schema
    fields = [f for f in found if f.name != MALFORMED]
    schema = T.StructType([*fields, T.StructField(MALFORMED, T.StringType())])
    df = reader.schema(schema).json(list(paths))
    nested = {f.name: F.to_json(f"`{f.name}`") for f in fields if not isinstance(f.dataType, T.StringType)}
    return df.withColumns(nested) if nested else df


def read_batches(
    spark: SparkSession,
    cfg: SourceConfig,
    zone: str,
    months: Sequence[str] | None = None,
    run_ts: datetime | None = None,
) -> DataFrame:
    """Rows of a ``year=/month=`` zone, with the path columns ``year`` and ``month``.

    Batches and files may differ in columns: all columns are there, in types that hold
    what all of them hold (see ``contract.merged_type``). Only files of the landing zone
    are opened for that; the other zones have their columns noted down. CSV and JSON come
    as text, with the line in ``MALFORMED`` where it cannot be read. ``run_ts`` adds the
    trace columns.
    """
    root = cfg.zone_root(zone)
    if zone != LANDING and versions.kept(spark, root):
        kept = versions.batches(spark, root)
        return _read_parts(spark, root, {m: kept[m] for m in _months(spark, cfg, zone, months)}, BATCH_KEYS)
    paths = batch_paths(spark, cfg, zone, months)
    if zone == LANDING and cfg.fmt == "csv":
        scans = _csv_scans(spark, cfg, paths)
    elif zone == LANDING and cfg.fmt == "json":
        scans = [_json_scan(spark, cfg, paths)]
    else:
        reader = spark.read.option("mergeSchema", True).option("basePath", root)
        scans = [reader.parquet(*paths)]
    if run_ts is not None:
        scans = [with_trace(scan, run_ts) for scan in scans]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def _read_parts(
    spark: SparkSession, root: str, batches: Mapping[str, Sequence[versions.Part]], keys: Sequence[str]
) -> DataFrame:
    """The rows of some batches: one scan for all parts that were written with one schema."""
    groups: dict[tuple[str, bool], list[str]] = {}
    for month, parts in batches.items():
        for part in parts:
            named = groups.setdefault((part.schema, bool(month)), [])
            if part.path:
                named.append(f"{root}/{part.path}")
    scans = []
    for (schema, by_month), paths in groups.items():
        columns = T.StructType.fromJson(json.loads(schema))
        # Without a month in its path a batch has but the last key.
        for key in keys if by_month else keys[-1:]:
            columns = columns.add(key, T.StringType())
        if paths:
            reader = spark.read.schema(columns).option("basePath", root)
            scans.append(reader.parquet(*paths).drop(versions.KEY))
        else:
            scans.append(spark.createDataFrame([], columns))
    filled = [scan for scan, paths in zip(scans, groups.values(), strict=True) if paths]
    return union_all(filled if filled and len(filled) == len(scans) else scans)


def _with_batch_month(df: DataFrame) -> DataFrame:
    return df.withColumn("batch_month", batch_month()).drop("year", "month")


def _all_batches(
    spark: SparkSession,
    cfg: SourceConfig,
    zone: str,
    months: Sequence[str] | None,
    run_ts: datetime | None = None,
) -> DataFrame:
    """Batches brought together by name, also those that lack columns of others."""
    groups = batches_by_schema(spark, cfg, zone, _months(spark, cfg, zone, months))
    parts = [
        canonical_names(read_batches(spark, cfg, zone, group, run_ts), cfg.columns) for group in groups
    ]
    return _with_batch_month(union_all(parts))


def read_landing(
    spark: SparkSession,
    cfg: SourceConfig,
    months: Sequence[str] | None = None,
    run_ts: datetime | None = None,
) -> DataFrame:
    """Landed rows in contract spelling; ``run_ts`` adds the trace columns."""
    return _all_batches(spark, cfg, LANDING, months, run_ts)


def read_raw(
    spark: SparkSession, cfg: SourceConfig, months: Sequence[str] | None = None
) -> DataFrame:
    """Valid rows, and promoted ones: those have an ``origin``."""
    raw = _all_batches(spark, cfg, RAW, months)
    repaired = promoted_months(spark, cfg, _months(spark, cfg, RAW, months))
    if not repaired:
        return raw
    return union_all([raw, _all_batches(spark, cfg, PROMOTED, repaired)])


def read_quarantine(
    spark: SparkSession, cfg: SourceConfig, months: Sequence[str] | None = None
) -> DataFrame:
    """Rejected rows with ``batch_month`` and ``ds``, NULL where the pickup is.

    Batches that lack columns, or hold them in other types, are brought together.
    """
    df = _all_batches(spark, cfg, QUARANTINE, months).drop(COPIES)
    if PICKUP not in df.columns:
        return df.withColumn("ds", F.lit(None).cast("string"))
    return df.withColumn("ds", F.date_format(F.col(PICKUP).try_cast("timestamp"), "yyyy-MM-dd"))


def structured_schema() -> T.StructType:
    """Schema of a structured zone that holds no row yet."""
    names = {**TRIP_TYPES, **TRACE_TYPES}
    empty = T.StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in names.items()))
    session = SparkSession.getActiveSession()
    derived = session.createDataFrame([], empty).withColumns({**time_features(), **trip_metrics()})
    return derived.withColumn("batch_month", F.lit("")).schema


def read_structured(
    spark: SparkSession, cfg: SourceConfig, months: Sequence[str] | None = None
) -> DataFrame:
    """The structured table, or some batches of it; ``ds`` and ``batch_month`` are text.

    The columns are those of all batches. One that is a number here and text there is
    text; see ``structured_drift``. No data file is opened to know that, and a filter on
    ``ds`` or ``batch_month`` keeps all other days' files closed.
    """
    root = cfg.zone_root(STRUCTURED)
    if versions.kept(spark, root):
        kept = versions.batches(spark, root)
        wanted = {m: p for m, p in kept.items() if months is None or m in set(months)}
        if wanted:
            return _read_parts(spark, root, wanted, ("batch_month", "ds"))
    elif storage.directories(spark, f"{root}/*=*"):
        df = spark.read.option("basePath", root).option("mergeSchema", True).parquet(root)
        partitions = {n: F.col(n).cast("string") for n in ("ds", "batch_month") if n in df.columns}
        df = df.withColumns(partitions)
        return df if months is None else df.filter(F.col("batch_month").isin(list(months)))
    return spark.createDataFrame([], structured_schema())


def structured_drift(spark: SparkSession, cfg: SourceConfig) -> DataFrame:
    """How the structured table's columns differ from the contract, with filled rows.

    As ``contract.schema_drift``, and ``retyped`` also for a column that raw or structured
    batches were written with in different types. ``types`` lists those.
    """
    trips = read_structured(spark, cfg)
    known = {**TRIP_TYPES, **{f.name: f.dataType.simpleString() for f in structured_schema()}}
    drift = schema_drift(trips, known)
    contract = {name.lower() for name in known}
    met = {
        name: types
        for zone in (RAW, STRUCTURED)
        for name, types in retyped_columns(
            part.columns
            for parts in versions.batches(spark, cfg.zone_root(zone)).values()
            for part in parts
        ).items()
        if name not in contract
    }
    types = F.create_map(*(F.lit(x) for name, kinds in met.items() for x in (name, ",".join(kinds))))
    clash = F.try_element_at(types, F.lower("column_name")) if met else F.lit(None).cast("string")
    return drift.select(
        "column_name",
        F.when(clash.isNotNull(), "retyped").otherwise(F.col("kind")).alias("kind"),
        "filled_rows",
        clash.alias("types"),
    )


def trips_between(spark: SparkSession, cfg: SourceConfig, first: str, last: str) -> DataFrame:
    """Structured trips of the days ``first`` to ``last`` (``YYYY-MM-DD``, inclusive)."""
    return read_structured(spark, cfg).filter(F.col("ds").between(first, last))


def batches_by_schema(
    spark: SparkSession,
    cfg: SourceConfig,
    zone: str,
    months: Sequence[str],
    broken: dict[str, str] | None = None,
) -> list[list[str]]:
    """Group months whose files have one schema, so that each group is one scan.

    Monthly deliveries change spelling, types and columns over the years, and one
    scan cannot mix them. A month whose own files cannot be brought together is an
    error, or goes to ``broken`` with its message. Months of the landing zone are told
    apart by one pass over all footers, those of the others by what was noted down.
    """
    months = list(months)
    root = cfg.zone_root(zone)
    if zone != LANDING and versions.kept(spark, root):
        kept = versions.batches(spark, root)
        schemas = {m: json.dumps(sorted({p.schema for p in kept[m]})) for m in months}
    else:
        schemas = _surveyed(spark, cfg, zone, months)
    groups: dict[str, list[str]] = {}
    for month in months:
        if not isinstance(schemas[month], Exception):
            groups.setdefault(schemas[month], []).append(month)
            continue
        message = f"files of {cfg.batch_path(zone, month)} cannot be read together: {schemas[month]}"
        if broken is None:
            raise ValueError(message) from schemas[month]
        broken[month] = message
    return list(groups.values())


def _surveyed(
    spark: SparkSession, cfg: SourceConfig, zone: str, months: Sequence[str]
) -> dict[str, str | Exception]:
    """Per month what its files' columns are, or why they cannot be read together."""

    def by_reading(month: str) -> str | Exception:
        try:
            schema = read_batches(spark, cfg, zone, [month]).schema
        except (PySparkException, Py4JError) as error:
            return error
        return json.dumps([[f.name, f.dataType.simpleString()] for f in schema])

    if zone == LANDING and cfg.fmt == "csv":
        return _csv_columns(spark, cfg, months)
    facts = survey(spark, cfg, months) if zone == LANDING and cfg.fmt == "parquet" else {}
    known: dict[str, str | Exception] = {}
    for month, landed in facts.items():
        if landed.errors:
            known[month] = ValueError("; ".join(f"{p}: {e}" for p, e in sorted(landed.errors.items())))
        elif landed.reached and len(landed.columns) == 1:
            (known[month],) = landed.columns
    # Files that differ, or that only Spark can open, are for Spark to bring together.
    rest = [month for month in months if month not in known]
    with ThreadPoolExecutor(storage.THREADS) as pool:
        known.update(zip(rest, pool.map(by_reading, rest), strict=True))
    return known


def _csv_columns(
    spark: SparkSession, cfg: SourceConfig, months: Sequence[str]
) -> dict[str, str | Exception]:
    """Per month the names its headers hold, whatever their order, or why one cannot be read."""
    with ThreadPoolExecutor(storage.THREADS) as pool:
        listed = list(pool.map(lambda m: list(storage.files(spark, cfg.batch_path(LANDING, m))), months))
    headers = _csv_headers(spark, [file for files in listed for file in files])
    known: dict[str, str | Exception] = {}
    for month, files in zip(months, listed, strict=True):
        found = [headers[file] for file in files]
        failed = [names for names in found if isinstance(names, Exception)]
        known[month] = failed[0] if failed else json.dumps(sorted({n for names in found for n in names}))
    return known


def promoted_months(spark: SparkSession, cfg: SourceConfig, months: Sequence[str]) -> list[str]:
    known = set(storage.batch_months(spark, cfg, PROMOTED))
    return [month for month in months if month in known]
