"""Sums that do not depend on the order in which tasks deliver their rows.

Adding doubles gives another last digit for every partitioning, and over 10^12 rows the
error reaches whole cents. Here each value is split exactly into two whole numbers: those
of its size, a bin of 32 powers of two, are added as whole numbers, which loses nothing
and knows no order. At the end a group has a handful of bins, brought together from the
smallest up. There is no smallest or largest value that it works for (below 2^-1053 a
double's last digits are cut). NaN and infinities make the sum what they make it for
doubles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WIDTH = 32
_LOWEST = -1000
_FINE = 53  # binary digits of the second whole number
_WHOLE = "decimal(20,0)"


def _split(value: Column) -> tuple[Column, Column, Column]:
    """Bin of a finite value, and value / 2^bin as a whole number and 2^-53ths beyond it."""
    size = F.abs(value)
    power = F.floor(F.log2(F.when(size > 0, size)) / _WIDTH).cast("int") * _WIDTH
    bin_ = F.greatest(F.coalesce(power, F.lit(0)), F.lit(_LOWEST))
    scaled = value / F.pow(F.lit(2.0), bin_)
    whole = F.floor(scaled)
    fine = F.floor((scaled - whole) * float(2**_FINE))
    return bin_, whole.cast(_WHOLE), fine.cast(_WHOLE)


def exact_sums(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per group: ``rows``, and ``sum_<c>``, ``count_<c>``, ``avg_<c>`` of each column.

    NULLs are passed over; the sum and the average of none is NULL. One pass: rows are
    grouped by ``keys`` and the bins of their values first, of which there are few.
    Without keys there is one row, also for no rows.
    """
    values = {c: F.col(c).cast("double") for c in columns}
    special = {c: F.isnan(v) | (F.abs(v) == float("inf")) for c, v in values.items()}
    parts = {c: _split(F.when(~special[c], v)) for c, v in values.items()}
    binned = df.groupBy(*keys, *(parts[c][0].alias(f"_bin_{c}") for c in columns)).agg(
        F.count(F.lit(1)).alias("_rows"),
        *(F.sum(parts[c][1]).alias(f"_whole_{c}") for c in columns),
        *(F.sum(parts[c][2]).alias(f"_fine_{c}") for c in columns),
        *(F.sum(F.when(special[c], values[c])).alias(f"_special_{c}") for c in columns),
        *(F.count(values[c]).alias(f"_count_{c}") for c in columns),
    )

    def listed(c: str) -> Column:
        entry = F.struct(
            F.col(f"_bin_{c}").alias("bin"), F.col(f"_whole_{c}").alias("whole"), F.col(f"_fine_{c}").alias("fine")
        )
        return F.collect_list(F.when(F.col(f"_whole_{c}").isNotNull(), entry)).alias(f"_bins_{c}")

    grouped = binned.groupBy(*keys).agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        *(listed(c) for c in columns),
        *(F.sum(f"_special_{c}").alias(f"_special_{c}") for c in columns),
        *(F.coalesce(F.sum(f"_count_{c}"), F.lit(0)).alias(f"count_{c}") for c in columns),
    )
    totals = {c: F.coalesce(f"_special_{c}", _brought_together(f"_bins_{c}")) for c in columns}
    made = []
    for c in columns:
        made += [
            totals[c].alias(f"sum_{c}"),
            f"count_{c}",
            F.try_divide(totals[c], F.col(f"count_{c}")).alias(f"avg_{c}"),
        ]
    return grouped.select(*keys, "rows", *made)


def _brought_together(bins: str) -> Column:
    """The bins' sums as one double, NULL if there are none."""

    def added(b: Column, name: str) -> Column:
        own = F.filter(bins, lambda e: e["bin"] == b)
        zero = F.lit(0).cast("decimal(38,0)")
        return F.aggregate(own, zero, lambda s, e: (s + e[name]).cast("decimal(38,0)")).cast("double")

    def value(b: Column) -> Column:
        unit = F.pow(F.lit(2.0), b)
        return added(b, "fine") * (unit / float(2**_FINE)) + added(b, "whole") * unit

    each = F.transform(F.array_sort(F.array_distinct(F.col(bins)["bin"])), value)
    return F.when(F.size(bins) > 0, F.aggregate(each, F.lit(0.0), lambda s, x: s + x))


def percentage(part: Column, whole: Column) -> Column:
    """``part / whole * 100``, and 0 where there is nothing to divide by."""
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))
