"""Batches of the zones by month, and scratch folders: names only, never data."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from zoneflow import versions
from zoneflow.config import LANDING, MONTH, SourceConfig
from zoneflow.paths import THREADS, delete, directories, exists, files, matching, open_path

__all__ = ["THREADS", "batch_months", "delete", "directories", "exists", "files", "scratch_dir"]


def batch_months(spark: SparkSession, cfg: SourceConfig, zone: str) -> list[str]:
    """Months of a zone: those committed, or those that have a ``year=/month=`` directory.

    Names that are no number, as job leftovers have, are passed over. A month that is
    not written ``YYYY`` and ``MM`` is an error, since readers could not agree on it.
    """
    root = cfg.zone_root(zone)
    if zone != LANDING and versions.kept(spark, root):
        return [month for month in versions.batches(spark, root) if month]
    found = [s.getPath() for s in matching(spark, f"{root}/year=*/month=*")]
    names = [
        f"{p.getParent().getName().removeprefix('year=')}-{p.getName().removeprefix('month=')}"
        for p in found
    ]
    for name, path in zip(names, found, strict=True):
        if name.replace("-", "", 1).isdigit() and not MONTH.fullmatch(name):
            raise ValueError(f"{path} should be named year=YYYY/month=MM")
    return sorted(name for name in names if MONTH.fullmatch(name))


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh directory every executor can reach, removed when the session ends.

    It lies in the folder the session names in ``spark.checkpoint.dir``, else beneath
    the warehouse, which executors share too.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or (
        f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    )
    path = f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    fs, hadoop_path = open_path(spark, path)
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path
