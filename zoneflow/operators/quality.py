"""Tag, split and measure the rows of a batch by the quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from zoneflow.config import COPIES, MALFORMED, QualityTargets
from zoneflow.functions.numeric import percentage
from zoneflow.functions.rules import all_hold, failed_rules, is_valid, reason, trip_rules
from zoneflow.operators.contract import with_maps, without_maps


def tag_quality(df: DataFrame) -> DataFrame:
    """Add ``failed_rules`` and ``quarantine_reason`` (NULL on a valid row)."""
    rules = trip_rules(df.schema)
    return df.withColumns(
        {
            "failed_rules": failed_rules(rules),
            "quarantine_reason": F.when(~is_valid(rules), reason(rules)),
        }
    )


def valid_rows(df: DataFrame) -> DataFrame:
    """Rows that hold every rule; none of them is malformed."""
    return df.filter(all_hold(trip_rules(df.schema))).drop(MALFORMED)


def rejected_rows(df: DataFrame, distinct: bool = True) -> DataFrame:
    """The rows that are not valid; equal ones are kept once unless told otherwise.

    Only rejected rows are shuffled, and equal rows collapse before the shuffle.
    """
    rejected = df.filter(~is_valid(trip_rules(df.schema)))
    return with_maps(without_maps(rejected).dropDuplicates(), df.schema) if distinct else rejected


def counted_rejects(df: DataFrame) -> DataFrame:
    """The distinct rejected rows, each with its number in ``COPIES``.

    Equal rows are counted where they are collapsed, before the shuffle, so what was
    rejected in all needs no further pass over the data.
    """
    rejected = df.filter(~is_valid(trip_rules(df.schema)))
    names = [F.col(f"`{name}`") for name in df.columns]
    counted = without_maps(rejected).groupBy(*names).agg(F.count(F.lit(1)).alias(COPIES))
    return with_maps(counted, df.schema)


def rejected_by_set_operation(df: DataFrame) -> DataFrame:
    """The same distinct rejected rows, stated as ``df EXCEPT valid rows``."""
    valid = valid_rows(df)
    every = df.select(*(F.col(f"`{c}`") for c in valid.columns))
    return with_maps(without_maps(every).subtract(without_maps(valid)), df.schema)


def split_quality(df: DataFrame, distinct: bool = True) -> tuple[DataFrame, DataFrame]:
    """Valid rows as they are, and rejected rows with their tags."""
    return valid_rows(df), tag_quality(rejected_rows(df, distinct))


def split_counted(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``split_quality``, rejected rows with ``COPIES``."""
    return valid_rows(df), tag_quality(counted_rejects(df))


def rule_results(df: DataFrame, group: str | None = None) -> DataFrame:
    """Per rule: how many rows pass, break it, or leave it undecided (NULL)."""
    rules = [r for r in trip_rules(df.schema) if group in (None, r.group)]
    counts = df.agg(
        *(
            F.struct(
                F.lit(rule.group).alias("rule_group"),
                F.lit(rule.name).alias("rule"),
                F.count_if(rule.holds).alias("passed"),
                F.count_if(~rule.holds).alias("broken"),
                F.count_if(rule.holds.isNull()).alias("undecided"),
            ).alias(rule.name)
            for rule in rules
        )
    )
    return counts.select(F.inline(F.array(*(F.col(rule.name) for rule in rules))))


def failures_by_rule(df: DataFrame) -> DataFrame:
    """Rows per failed rule, all failing rules of a row counted; none left out."""
    return rule_results(df).select("rule", (F.col("broken") + F.col("undecided")).alias("failures"))


def failed_rule_rows(df: DataFrame, *keys: str) -> DataFrame:
    """One row per trip and failed rule."""
    tagged = tag_quality(df).filter(F.col("quarantine_reason").isNotNull())
    return tagged.select(*keys, "quarantine_reason", F.explode("failed_rules").alias("rule"))


def reason_share(rejected: DataFrame) -> DataFrame:
    """Rejected rows per reason and its share; the window sees one row per reason."""
    counts = rejected.groupBy("quarantine_reason").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())
    return counts.withColumn("share_pct", percentage(F.col("count"), total))


def rates(
    input_rows: Column, valid_rows: Column, targets: QualityTargets = QualityTargets()
) -> dict[str, Column]:
    """Quality rate, its complement and the status they lead to."""
    quality = percentage(valid_rows, input_rows)
    return {
        "quality_rate": quality,
        "invalid_rate": 100 - quality,
        "status": F.when(quality >= targets.min_quality, "SUCCESS").otherwise("WARNING"),
    }


def quality_metrics(df: DataFrame, targets: QualityTargets = QualityTargets()) -> DataFrame:
    """Input, valid, rejected and distinct rejected rows with rates and status.

    One scan and one shuffle: rows are grouped by their whole content if rejected
    and by NULL if valid, so all valid rows of a task leave it as a single count.
    """
    plain = without_maps(df)
    rejected_key = F.when(~is_valid(trip_rules(df.schema)), F.struct(*plain.columns))
    copies = plain.groupBy(rejected_key.alias("rejected")).agg(F.count(F.lit(1)).alias("n"))
    is_rejected = F.col("rejected").isNotNull()

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))

    counts = copies.agg(
        total(F.lit(True)).alias("input_rows"),
        total(~is_rejected).alias("valid_rows"),
        total(is_rejected).alias("rejected_rows"),
        F.count("rejected").alias("invalid_rows"),
    )
    return counts.withColumns(rates(F.col("input_rows"), F.col("valid_rows"), targets))
