"""The session's file system: names, sizes and small notes, never data."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

THREADS = 16


def open_path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = open_path(spark, path)
    return fs.exists(hadoop_path)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete files and directories that exist, several at a time."""

    def drop(path: str) -> None:
        fs, hadoop_path = open_path(spark, path)
        fs.delete(hadoop_path, True)

    with ThreadPoolExecutor(THREADS) as pool:
        list(pool.map(drop, paths))


def matching(spark: SparkSession, pattern: str) -> list:
    """Status of everything a glob pattern meets."""
    fs, path = open_path(spark, pattern)
    return list(fs.globStatus(path) or [])


def directories(spark: SparkSession, pattern: str) -> list[str]:
    """Paths of the directories a glob pattern meets."""
    return [str(s.getPath()) for s in matching(spark, pattern) if s.isDirectory()]


def files(spark: SparkSession, path: str) -> Iterator[str]:
    """Paths of the data files beneath a directory."""
    fs, root = open_path(spark, path)
    if not fs.exists(root):
        return
    found = fs.listFiles(root, True)
    while found.hasNext():
        file = found.next().getPath()
        if not file.getName().startswith(("_", ".")):
            yield file.toString()


def read_note(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, hadoop_path = open_path(spark, path)
    stream = fs.open(hadoop_path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_note(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    fs, target = open_path(spark, path)
    _, part = open_path(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(part, target):
        fs.delete(part, False)
        raise OSError(f"cannot write {path}")
