"""The quality rules of a trip row, as one registry of boolean columns.

A row is valid when every rule is TRUE. A rule that is FALSE *or NULL* counts as
failed; the quarantine reason is the label of the first rule that is FALSE, so a
row rejected only through NULLs, or through a rule without a label, gets
``multiple_issues``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from zoneflow.config import DROPOFF, MALFORMED, PICKUP, TRIP_TYPES

# Bounds and labels.
MAX_PASSENGERS = 8
MAX_DISTANCE = 500
MAX_FARE = 1000
FIRST_LOCATION, LAST_LOCATION = 1, 263
OTHER_REASON = "multiple_issues"
MISSING_COLUMNS = "missing_columns"


@dataclass(frozen=True)
class Rule:
    name: str
    group: str
    holds: Column
    label: str | None = None

    @property
    def passed(self) -> Column:
        """``holds`` with NULL read as failed."""
        return F.coalesce(self.holds, F.lit(False))


def typed(schema: T.StructType, name: str) -> Column:
    """A contract column ready to compare: text is read as its contract type."""
    column = F.col(name)
    if not isinstance(schema[name].dataType, T.StringType):
        return column
    wanted = TRIP_TYPES[name]
    return column.try_cast("double" if wanted == "int" else wanted)


def trip_rules(schema: T.StructType) -> tuple[Rule, ...]:
    """All rules, in the order in which they name the quarantine reason.

    Rows of a text format may carry their line if it is malformed; such a row breaks
    ``readable`` before anything else.
    """
    readable = (
        (Rule("readable", "format", F.col(MALFORMED).isNull(), OTHER_REASON),)
        if MALFORMED in schema.names
        else ()
    )
    pickup, dropoff, passengers, distance, fare, pickup_zone, dropoff_zone = (
        typed(schema, name)
        for name in (
            PICKUP,
            DROPOFF,
            "passenger_count",
            "trip_distance",
            "fare_amount",
            "PULocationID",
            "DOLocationID",
        )
    )
    return (
        *readable,
        Rule("pickup_present", "nulls", pickup.isNotNull(), "null_pickup_datetime"),
        Rule("dropoff_present", "nulls", dropoff.isNotNull(), "null_dropoff_datetime"),
        Rule("fare_present", "nulls", fare.isNotNull(), "null_fare"),
        Rule("distance_present", "nulls", distance.isNotNull(), "null_distance"),
        Rule("fare_sign", "non_negative", fare >= 0, "negative_fare"),
        Rule("distance_sign", "non_negative", distance >= 0, "negative_distance"),
        Rule("passengers_sign", "non_negative", passengers > 0, "invalid_passenger_count"),
        Rule("time_order", "temporal", dropoff > pickup, "temporal_inconsistency"),
        Rule("passengers_range", "range", passengers <= MAX_PASSENGERS),
        Rule("distance_range", "range", distance < MAX_DISTANCE, "excessive_distance"),
        Rule("fare_range", "range", fare < MAX_FARE, "excessive_fare"),
        Rule(
            "pickup_zone",
            "location",
            pickup_zone.between(FIRST_LOCATION, LAST_LOCATION),
            "invalid_pickup_location",
        ),
        Rule(
            "dropoff_zone",
            "location",
            dropoff_zone.between(FIRST_LOCATION, LAST_LOCATION),
            "invalid_dropoff_location",
        ),
    )


def all_hold(rules: Sequence[Rule]) -> Column:
    """TRUE, FALSE or NULL; a filter on it may be pushed into the scan."""
    return reduce(and_, (rule.holds for rule in rules))


def is_valid(rules: Sequence[Rule]) -> Column:
    """``all_hold`` with NULL read as not valid, so that it may be negated."""
    return F.coalesce(all_hold(rules), F.lit(False))


def reason(rules: Sequence[Rule]) -> Column:
    """Label of the first broken rule; meaningful on rejected rows only."""
    labels = [F.when(~rule.holds, rule.label) for rule in rules if rule.label]
    return F.coalesce(*labels, F.lit(OTHER_REASON))


def failed_rules(rules: Sequence[Rule]) -> Column:
    """Names of all rules a row fails, empty on a valid row."""
    return F.array_compact(F.array(*(F.when(~rule.passed, rule.name) for rule in rules)))
