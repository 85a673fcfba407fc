"""Repair quarantined rows and find out which of them now hold every rule.

The repairs are business rules of this package, not of the data's publisher:

* ``number_format`` / ``time_format``: text that only reads as its type once
  blanks, currency signs and commas between groups of three digits are gone, or as
  a US date; any other comma leaves the text unrepaired;
* ``default_passengers``: no or zero passengers become 1;
* ``unknown_payment``: a payment code outside 1 to 6 becomes 5 (unknown);
* ``swapped_times``: a dropoff before the pickup trades places with it.

Nothing else is touched; a negative fare, say, stays rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zoneflow.config import DROPOFF, PICKUP, TRIP_TYPES
from zoneflow.functions.rules import is_valid, reason, trip_rules

# Fixed values of the repairs.
DEFAULT_PASSENGERS = 1
FIRST_PAYMENT, LAST_PAYMENT, UNKNOWN_PAYMENT = 1, 6, 5
US_TIME = "MM/dd/yyyy HH:mm:ss"
NOISE = r"[\s$]"
THOUSANDS = r"^[-+]?\d{1,3}(,\d{3})+(\.\d*)?$"


def _note(changed: Column, name: str) -> Column:
    return F.when(changed, name)


def _text_columns(df: DataFrame) -> dict[str, str]:
    return {
        f.name: TRIP_TYPES[f.name]
        for f in df.schema
        if f.name in TRIP_TYPES and isinstance(f.dataType, T.StringType)
    }


def repair_types(df: DataFrame) -> DataFrame:
    """Read text columns as their contract type, forgiving about format.

    Adds ``remediation``, the names of the repairs that made a difference.
    """
    text = _text_columns(df)
    parsed, changed = {}, {"number_format": [], "time_format": []}
    for name, wanted in text.items():
        column = F.col(name)
        if wanted == "timestamp":
            strict = column.try_cast("timestamp_ntz")
            lenient = F.try_to_timestamp(F.trim(column), F.lit(US_TIME)).cast("timestamp_ntz")
            kind = "time_format"
        else:
            strict = column.try_cast("double")
            bare = F.regexp_replace(column, NOISE, "")
            grouped = F.when(bare.rlike(THOUSANDS), F.replace(bare, F.lit(","), F.lit("")))
            lenient = F.coalesce(grouped, bare).try_cast("double")
            kind = "number_format"
        changed[kind].append(strict.isNull() & lenient.isNotNull())
        parsed[name] = F.coalesce(strict, lenient).try_cast(wanted)
    notes = [
        _note(F.greatest(*flags) if len(flags) > 1 else flags[0], kind)
        for kind, flags in changed.items()
        if flags
    ]
    done = F.array_compact(F.array(*notes)) if notes else F.array().cast("array<string>")
    return df.withColumns({**parsed, "remediation": done})


def repair_values(df: DataFrame) -> DataFrame:
    """Fill, normalise and reorder values; extends ``remediation``."""
    passengers, pickup, dropoff = F.col("passenger_count"), F.col(PICKUP), F.col(DROPOFF)
    no_passengers = passengers.isNull() | (passengers == 0)
    swapped = dropoff < pickup
    fixes: dict[str, Column] = {
        "passenger_count": F.when(no_passengers, DEFAULT_PASSENGERS).otherwise(passengers),
        PICKUP: F.when(swapped, dropoff).otherwise(pickup),
        DROPOFF: F.when(swapped, pickup).otherwise(dropoff),
    }
    notes = [_note(no_passengers, "default_passengers"), _note(swapped, "swapped_times")]
    if "payment_type" in df.columns:
        payment = F.col("payment_type")
        unknown = ~payment.between(FIRST_PAYMENT, LAST_PAYMENT)
        fixes["payment_type"] = F.when(unknown, UNKNOWN_PAYMENT).otherwise(payment)
        notes.append(_note(unknown, "unknown_payment"))
    fixes = {n: c.cast(df.schema[n].dataType) for n, c in fixes.items()}
    done = F.array_compact(F.array(*notes))
    if "remediation" in df.columns:
        done = F.concat("remediation", done)
    return df.withColumns({**fixes, "remediation": done})


def remediate(quarantine: DataFrame) -> DataFrame:
    """Repair rejected rows and judge them again by the same rules.

    ``original_reason`` is why a row was rejected; ``quarantine_reason`` is why it
    still is, NULL if it now holds every rule.
    """
    named = quarantine.drop("failed_rules").withColumnRenamed("quarantine_reason", "original_reason")
    repaired = repair_values(repair_types(named))
    rules = trip_rules(repaired.schema)
    return repaired.withColumn("quarantine_reason", F.when(~is_valid(rules), reason(rules)))


def recovery_report(remediated: DataFrame) -> DataFrame:
    """Rows recovered and remaining, by the reason they were rejected for."""
    recovered = F.col("quarantine_reason").isNull()
    return (
        remediated.groupBy("original_reason")
        .agg(
            F.count_if(recovered).alias("recovered"),
            F.count_if(~recovered).alias("remaining"),
        )
        .orderBy("original_reason")
    )
