"""Writers of the zones.

Every write goes to a version directory of its own and counts once it is committed (see
``zoneflow.versions``): writers do not meet, a write that fails or is killed leaves the
batches as they were, and all months of a write change at once. Running a job again
replaces its batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import AbstractContextManager, contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zoneflow import paths, versions
from zoneflow.config import PICKUP, STRUCTURED, TRIP_TYPES, SourceConfig
from zoneflow.operators.casts import to_type
from zoneflow.operators.contract import merged_schema
from zoneflow.sources.zones import BATCH_KEYS, path_part

STRUCTURED_KEYS = ("batch_month", "ds")
DAYS_PER_MONTH = 31


UNBUFFERED = "spark.shuffle.sort.bypassMergeThreshold"
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"
FILES_AT_ONCE = 64
MERGED = "spark.sql.adaptive.coalescePartitions.enabled"

_writes: Counter[tuple[int, str]] = Counter()
_writes_lock = Lock()


def size_for_write(df: DataFrame, *keys: str, directories: int = 1) -> DataFrame:
    """Bring the rows of a partition directory together, in files of even size.

    A rebalance, unlike ``repartition``, splits a directory that outgrows the
    advisory partition size over several tasks and merges small ones into one. More
    shuffle partitions than directories would stay empty, so their number follows
    the directories, not the bytes, beyond the session's own setting. It ends where a
    shuffle would have to hold a task's rows in memory, and spill them, to part them:
    large partitions are split anyhow.
    """
    conf = df.sparkSession.conf
    partitions = max(int(conf.get("spark.sql.shuffle.partitions")), directories)
    return df.hint("rebalance", min(partitions, int(conf.get(UNBUFFERED, "200"))), *keys)


def gather_days(raw: DataFrame, directories: int) -> DataFrame:
    """Bring raw rows together by batch and day, as ``write_structured`` writes them.

    Done before the columns that follow from a row are added, so they are not shuffled.
    """
    pickup = to_type(F.col(PICKUP), raw.schema[PICKUP].dataType, TRIP_TYPES[PICKUP])
    keyed = raw.withColumn("_day", F.to_date(pickup))
    return size_for_write(keyed, "batch_month", "_day", directories=directories).drop("_day")


@contextmanager
def _set_for_writes(spark: SparkSession, name: str, value: object, usual: str) -> Iterator[None]:
    """A setting of the session while any write in here runs; one that is not as usual stays."""
    key = (spark._jsparkSession.hashCode(), name)
    with _writes_lock:
        ours = _writes[key] > 0 or spark.conf.get(name, usual) == usual
        if ours:
            _writes[key] += 1
            spark.conf.set(name, value)
    try:
        yield
    finally:
        if ours:
            with _writes_lock:
                _writes[key] -= 1
                if not _writes[key]:
                    del _writes[key]
                    spark.conf.set(name, usual)


def files_kept_open(spark: SparkSession) -> AbstractContextManager[None]:
    """Writes in here keep a file open for each of a task's directories.

    A task that meets ``FILES_AT_ONCE`` directories or fewer then needs no sort by them,
    which would hold all its rows in memory and spill them; beyond that Spark sorts the rest.
    A session that has a number of its own keeps it.
    """
    return _set_for_writes(spark, OPEN_FILES, FILES_AT_ONCE, "0")


def partitions_unmerged(spark: SparkSession) -> AbstractContextManager[None]:
    """Writes in here leave the small partitions of a rebalance as they are; large ones are split.

    Merged up to the advisory size, a task meets hundreds of days and has to sort its rows by
    them. The directories are as many either way, and so are the files.
    """
    return _set_for_writes(spark, MERGED, False, "true")


def _batch_columns(df: DataFrame, *without: str) -> str:
    """The schema to note down: what the files of a batch hold."""
    fields = [T.StructField(f.name, f.dataType) for f in df.schema if f.name not in without]
    return T.StructType(fields).json()


def write_batches(
    df: DataFrame, cfg: SourceConfig, zone: str, months: Sequence[str], gather: bool
) -> None:
    """Replace ``months`` of a ``year=/month=`` zone by ``df``.

    A month without rows is there too, as an empty batch with its columns, so nothing
    stale survives. ``gather`` shuffles rows to their month first; leave it out where
    the scan already delivers month by month.
    """
    spark, root = df.sparkSession, cfg.zone_root(zone)
    version = versions.new_version(root)
    if len(months) == 1:
        # One directory: no path columns, hence neither a shuffle nor a sort by them.
        single = df.drop(*BATCH_KEYS).write.option("maxRecordsPerFile", cfg.rows_per_file)
        single.parquet(cfg.batch_path(zone, *months).replace(root, version, 1))
    else:
        if gather:
            df = size_for_write(df, *BATCH_KEYS, directories=len(months))
        named = df.withColumns({"year": path_part("year", 4), "month": path_part("month", 2)})
        with files_kept_open(spark):
            (
                named.write.option("maxRecordsPerFile", cfg.rows_per_file)
                .partitionBy(*BATCH_KEYS)
                .parquet(version)
            )
    columns = _batch_columns(df, *BATCH_KEYS)
    found = paths.directories(spark, f"{version}/year=*/month=*")
    written = {"-".join(part.split("=")[1] for part in path.rsplit("/", 2)[1:]): path for path in found}
    parts = {m: [_part(version, written.get(m), columns)] for m in {*months, *written}}
    versions.commit(spark, root, parts)


def _part(version: str, path: str | None, columns: str) -> versions.Part:
    """A batch's part of a version, named from the zone on."""
    name = version.rsplit("/", 1)[1]
    return versions.Part(None if path is None else path[path.index(f"/{name}") + 1 :], columns)


def write_structured(
    df: DataFrame,
    cfg: SourceConfig,
    months: Sequence[str] = (),
    mode: str = "replace",
    keys: Sequence[str] = STRUCTURED_KEYS,
    gather: bool = True,
) -> None:
    """Write structured rows, partitioned by ``keys``.

    ``replace`` needs ``batch_month`` among the keys and puts ``df`` in the place
    of ``months``; ``append`` adds to what is there, so a second run doubles it.
    ``gather`` shuffles rows to their day first; leave it out after ``gather_days``.
    """
    if mode not in ("replace", "append"):
        raise ValueError(f"mode {mode!r} is neither replace nor append")
    if mode == "replace" and "batch_month" not in keys:
        raise ValueError("replace works on whole batches: partition by batch_month")
    spark, root = df.sparkSession, cfg.zone_root(STRUCTURED)
    version = versions.new_version(root)
    if gather:
        df = size_for_write(df, *keys, directories=DAYS_PER_MONTH * len(months))
    with partitions_unmerged(spark), files_kept_open(spark):
        (
            df.write.option("maxRecordsPerFile", cfg.rows_per_file)
            .partitionBy(*keys)
            .parquet(version)
        )
    columns = _batch_columns(df, *keys)
    if "batch_month" in keys:
        found = paths.directories(spark, f"{version}/batch_month=*")
        written = {path.rsplit("batch_month=", 1)[1]: path for path in found}
    else:
        written = {"": version} if paths.directories(spark, f"{version}/*=*") else {}
    parts = {m: [_part(version, path, columns)] for m, path in written.items()}
    if mode == "replace":
        parts = {**dict.fromkeys(months, ()), **parts}
    versions.commit(spark, root, parts, mode)


# -- the catalog

PARTITIONS_AT_ONCE = 500


def register_zone(
    spark: SparkSession, name: str, path: str, keys: Sequence[str] = STRUCTURED_KEYS
) -> None:
    """Bring catalog table ``name`` up to date with a zone; make it if there is none.

    The table stays while it grows: new columns are added, partitions come and go as
    batches do, nothing is dropped and made again, and the columns are those noted down
    at the writes, so no data file is opened. A column of the table that no batch has any
    more stays, NULL in all rows. Keys are declared as text; a zone kept in versions has
    ``version`` as its first. A column that changed its type keeps the table's first one,
    and the batches that hold it otherwise can be read by ``read_structured`` only.
    """
    if not versions.kept(spark, path):
        found = spark.read.option("mergeSchema", True).parquet(path).schema
        _create_or_extend(spark, name, path, found, keys)
        spark.sql(f"MSCK REPAIR TABLE `{name}`")
        return
    parts = [part for batch in versions.batches(spark, path).values() for part in batch]
    _create_or_extend(spark, name, path, merged_schema(p.columns for p in parts), (versions.KEY, *keys))
    _sync_partitions(spark, name, path, parts)


def _create_or_extend(
    spark: SparkSession, name: str, path: str, found: T.StructType, keys: Sequence[str]
) -> None:
    columns = [f for f in found if f.name not in keys]

    def declared(fields: Sequence[T.StructField]) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    if not spark.catalog.tableExists(name):
        location = path.replace("'", "\\'")
        partitions = ", ".join(f"`{key}` string" for key in keys)
        names = ", ".join(f"`{key}`" for key in keys)
        every = ", ".join(filter(None, (declared(columns), partitions)))
        spark.sql(
            f"CREATE TABLE `{name}` ({every}) USING parquet PARTITIONED BY ({names}) LOCATION '{location}'"
        )
        return
    known = {column.lower() for column in spark.table(name).columns}
    if new := [f for f in columns if f.name.lower() not in known]:
        spark.sql(f"ALTER TABLE `{name}` ADD COLUMNS ({declared(new)})")


def _sync_partitions(spark: SparkSession, name: str, path: str, parts: Sequence[versions.Part]) -> None:
    """Add the partitions of the parts and drop those that are none of theirs."""
    root = path.rstrip("/")
    batches = [part.path for part in parts if part.path]
    wanted: set[str] = set()
    with ThreadPoolExecutor(paths.THREADS) as pool:
        for batch, inner in zip(
            batches, pool.map(lambda b: paths.directories(spark, f"{root}/{b}/*=*"), batches), strict=True
        ):
            wanted |= {f"{batch}/{d.rsplit('/', 1)[1]}" for d in inner} or {batch}
    present = {row[0] for row in spark.sql(f"SHOW PARTITIONS `{name}`").collect()}

    def spec(partition: str) -> str:
        pairs = (part.split("=", 1) for part in partition.split("/"))
        return "PARTITION (" + ", ".join(f"`{k}`='{v}'" for k, v in pairs) + ")"

    for change, partitions, between in (
        ("ADD IF NOT EXISTS", sorted(wanted - present), " "),
        ("DROP IF EXISTS", sorted(present - wanted), ", "),
    ):
        for start in range(0, len(partitions), PARTITIONS_AT_ONCE):
            some = between.join(map(spec, partitions[start : start + PARTITIONS_AT_ONCE]))
            spark.sql(f"ALTER TABLE `{name}` {change} {some}")


def repair_table(spark: SparkSession, name: str) -> None:
    """Make visible what was written since the table was last brought up to date."""
    described = spark.sql(f"DESCRIBE TABLE EXTENDED `{name}`").collect()
    path = next(row["data_type"] for row in described if row["col_name"] == "Location")
    keys = [c.name for c in spark.catalog.listColumns(name) if c.isPartition and c.name != versions.KEY]
    register_zone(spark, name, path, keys)
