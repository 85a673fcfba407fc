"""What the landed files say of themselves: columns, rows, or that they are broken.

One pass over the list of files, spread over the executors, that reads the footers of
Parquet files, or the first lines of CSV files. A file system that the workers cannot
reach by themselves leaves a month, or a file, to the caller.
"""

from __future__ import annotations

import hashlib
import io
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from zoneflow import paths
from zoneflow.config import LANDING, SourceConfig

_HEADS = "path string, head string"
_HEAD_CHARS = 1 << 20  # a first line beyond that is left to Spark
_FACTS = "month string, path string, columns string, rows bigint, error string, reached boolean"


@dataclass
class Landed:
    """The files of one landed month."""

    files: list[str] = field(default_factory=list)
    columns: set[str] = field(default_factory=set)
    rows: int = 0
    errors: dict[str, str] = field(default_factory=dict)
    reached: bool = True


def _open_native(path: str) -> tuple[pa.fs.FileSystem, str]:
    if local := re.fullmatch(r"(?:file:/*)?(/.*|[^/:][^:]*)", path):
        plain = local.group(1)
        return pa.fs.LocalFileSystem(), plain if plain.startswith("/") else f"/{plain}"
    return pa.fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for month, path in zip(batch["month"], batch["path"], strict=True):
            try:
                system, name = _open_native(path)
                found = pq.read_metadata(name, filesystem=system)
                schema = found.schema.to_arrow_schema()
                columns = repr([(f.name, str(f.type)) for f in schema])
                rows.append((month, path, columns, found.num_rows, None, True))
            except pa.ArrowInvalid as error:
                rows.append((month, path, None, 0, str(error), True))
            except (OSError, ValueError, NotImplementedError):
                rows.append((month, path, None, 0, None, False))
        yield pd.DataFrame(rows, columns=["month", "path", "columns", "rows", "error", "reached"])


def survey(spark: SparkSession, cfg: SourceConfig, months: Sequence[str]) -> dict[str, Landed]:
    """The facts of each month, by one job; a month without files has none."""
    with ThreadPoolExecutor(paths.THREADS) as pool:
        listed = list(pool.map(lambda m: list(paths.files(spark, cfg.batch_path(LANDING, m))), months))
    found = {m: Landed(names) for m, names in zip(months, listed, strict=True)}
    every = [(m, name) for m, landed in found.items() for name in landed.files]
    if cfg.fmt != "parquet":
        for landed in found.values():
            landed.reached = not landed.files
        return found
    if not every:
        return found
    for row in spark.createDataFrame(every, "month string, path string").mapInPandas(_footers, _FACTS).collect():
        landed = found[row["month"]]
        landed.reached &= row["reached"]
        landed.rows += row["rows"]
        if row["error"] is not None:
            landed.errors[row["path"]] = row["error"]
        elif row["columns"]:
            landed.columns.add(row["columns"])
    return found


def _first_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path in batch["path"]:
            try:
                system, name = _open_native(path)
                with system.open_input_stream(name, compression="detect") as stream:
                    lines = io.TextIOWrapper(stream, encoding="utf-8", errors="surrogateescape")
                    line = lines.readline(_HEAD_CHARS)
                    while line and not line.strip():
                        line = lines.readline(_HEAD_CHARS)
            except (pa.ArrowInvalid, OSError, ValueError, NotImplementedError):
                continue
            if len(line) < _HEAD_CHARS:
                text = line.rstrip("\r\n").encode("utf-8", "surrogateescape")
                rows.append((path, hashlib.sha256(text).hexdigest()))
        yield pd.DataFrame(rows, columns=["path", "head"])


def first_lines(spark: SparkSession, files: Sequence[str]) -> dict[str, str]:
    """A digest of each text file's first line that is not blank, by one job.

    A file that the workers cannot open, or whose first line is very long, is not there.
    """
    if not files:
        return {}
    listed = spark.createDataFrame([(name,) for name in files], "path string")
    return {row["path"]: row["head"] for row in listed.mapInPandas(_first_lines, _HEADS).collect()}
