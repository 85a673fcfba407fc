"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow import storage


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, whole."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the folder all executors share and read it again.

    Cuts the lineage: what was computed once is not computed again when an executor
    is lost, and several readers see the same rows.
    """
    spark = df.sparkSession
    path = f"{storage.scratch_dir(spark, label)}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"_{name}_{uuid.uuid4().hex[:12]}"


def with_results(df: DataFrame, results: Column, fields: list[str]) -> DataFrame:
    """Add the fields of a struct column; columns of the same names are replaced."""
    at = fresh("results")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {f.lower() for f in fields}]
    return df.select(*kept, results.alias(at)).select(
        *kept, *[F.col(f"{at}.{f}").alias(f) for f in fields]
    )


def remainder(id_col: str, divisor: int) -> Column:
    """crc32 of an id's decimal text, modulo ``divisor``; NULL for a NULL id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str, text_col: str
) -> DataFrame:
    """Texts and 0/1 labels of at most ``rows`` labelled documents.

    Which ones is decided by a hash of the id, so it is the same in every run. Only
    the sample of labels is sent to the executors, its size is bound by ``rows``.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
        .select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("_id"), "_id", "label")
        .limit(rows)
    )
    return (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "_id")
        .select("_id", "text", "label")
    )


def slices(texts: pd.Series, limit: int = 1 << 20) -> Iterator[list[str]]:
    """The texts in runs of about ``limit`` characters; NULL counts as empty."""
    run: list[str] = []
    size = 0
    for text in texts:
        text = text if isinstance(text, str) else ""
        if run and size + len(text) > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


MEMBERSHIP_WORDS = 1 << 17


def membership_bits(keys: DataFrame, key: str) -> DataFrame:
    """A bit set of the keys' hashes, at most ``MEMBERSHIP_WORDS`` rows of 64 bits.

    It is safe to broadcast, however many keys there are: the more there are, the
    less it rules out.
    """
    code = F.xxhash64(key)
    return keys.groupBy(F.pmod(code, F.lit(MEMBERSHIP_WORDS)).cast("int").alias("_word")).agg(
        F.bit_or(_bit(key)).alias("_bits")
    )


def _bit(key: str) -> Column:
    place = F.pmod(F.shiftright(F.xxhash64(key), 32), F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def might_be_in(df: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """The rows whose key is in the set, and few others."""
    word = F.pmod(F.xxhash64(key), F.lit(MEMBERSHIP_WORDS)).cast("int")
    return (
        df.withColumn("_word", word)
        .join(F.broadcast(bits), "_word")
        .where(F.col("_bits").bitwiseAND(_bit(key)) != 0)
        .drop("_word", "_bits")
    )
