"""What a trip source looks like: its columns, its limits and where its zones lie."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import MISSING, dataclass, field, fields

LANDING = "landing"
RAW = "raw"
QUARANTINE = "quarantine"
STRUCTURED = "structured"
PROMOTED = "promoted"
UNRESOLVED = "unresolved"
METRICS = "metrics"

MALFORMED = "_malformed"  # the text of a landed line that could not be read as a row

COPIES = "_copies"  # how many equal rejected rows of one file a quarantined row stands for

PICKUP = "tpep_pickup_datetime"
DROPOFF = "tpep_dropoff_datetime"

# Column names, their types in the structured zone and how binding they are.
TRIP_TYPES: dict[str, str] = {
    "VendorID": "int",
    PICKUP: "timestamp",
    DROPOFF: "timestamp",
    "passenger_count": "int",
    "trip_distance": "double",
    "RatecodeID": "int",
    "PULocationID": "int",
    "DOLocationID": "int",
    "payment_type": "int",
    "fare_amount": "double",
    "extra": "double",
    "mta_tax": "double",
    "tip_amount": "double",
    "tolls_amount": "double",
    "improvement_surcharge": "double",
    "total_amount": "double",
    "congestion_surcharge": "double",
    "airport_fee": "double",
}
REQUIRED_COLUMNS: tuple[str, ...] = (
    "VendorID",
    PICKUP,
    DROPOFF,
    "passenger_count",
    "trip_distance",
    "fare_amount",
    "PULocationID",
    "DOLocationID",
)
OPTIONAL_COLUMNS: tuple[str, ...] = ("congestion_surcharge", "airport_fee")

# What the structured zone is made from; a raw batch must hold all of it.
STRUCTURED_COLUMNS = tuple(name for name in TRIP_TYPES if name not in OPTIONAL_COLUMNS)

TEXT_FORMATS = ("csv", "json")
FORMATS = ("parquet", *TEXT_FORMATS)

MONTH = re.compile(r"\d{4}-(0[1-9]|1[0-2])")


@dataclass(frozen=True)
class OutlierLimits:
    """Open intervals a structured row must lie in; the defaults are fixed values."""

    min_minutes: float = 0
    max_minutes: float = 1440
    min_distance: float = 0
    max_distance: float = 100
    min_fare: float = 0
    max_fare: float = 500
    min_speed: float = 0
    max_speed: float = 100


@dataclass(frozen=True)
class QualityTargets:
    """Percentages a batch is held to; the defaults are fixed values."""

    min_quality: float = 95.0
    max_quarantine: float = 5.0


def split_month(month: str) -> tuple[str, str]:
    """``'2024-01'`` → ``('2024', '01')``."""
    if not MONTH.fullmatch(month):
        raise ValueError(f"a batch month is written YYYY-MM, not {month!r}")
    year, number = month.split("-")
    return year, number


def months_between(first: str, last: str) -> list[str]:
    """All batch months from ``first`` to ``last``, both included."""
    (y0, m0), (y1, m1) = (map(int, split_month(m)) for m in (first, last))
    return [f"{n // 12:04d}-{n % 12 + 1:02d}" for n in range(y0 * 12 + m0 - 1, y1 * 12 + m1)]


def expand_path(pattern: str, **values: str) -> str:
    """Fill the ``{placeholders}`` of a path pattern; an unknown one is an error."""
    try:
        return pattern.format(**values)
    except KeyError as missing:
        raise ValueError(f"path pattern {pattern!r} needs a value for {missing}") from None


def file_name(prefix: str, date_param: str, extension: str) -> str:
    """Name under which one delivery of a source lands."""
    return f"{prefix}_{date_param}.{extension}"


@dataclass(frozen=True)
class SourceConfig:
    """One source. A new source is a new value of this class, not new code.

    ``columns`` maps the source's own column names to the names of ``TRIP_TYPES``;
    ``landing_root`` is for a source that lands elsewhere than in the lake.
    """

    root: str
    source: str
    fmt: str = "parquet"
    pattern: str = "{root}/{zone}/{source}/year={year}/month={month}"
    columns: Mapping[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = REQUIRED_COLUMNS
    limits: OutlierLimits = OutlierLimits()
    targets: QualityTargets = QualityTargets()
    rows_per_file: int = 5_000_000
    landing_root: str | None = None

    def __post_init__(self) -> None:
        if self.fmt not in FORMATS:
            raise ValueError(f"format {self.fmt!r} is not one of {', '.join(FORMATS)}")
        if "/year={year}/month={month}" not in self.pattern:
            raise ValueError("a path pattern holds '/year={year}/month={month}'")

    @classmethod
    def from_mapping(cls, params: Mapping[str, object]) -> SourceConfig:
        """Build from job parameters; names all that are missing or unknown."""
        known = {f.name: f for f in fields(cls)}
        needed = [
            n for n, f in known.items() if f.default is MISSING and f.default_factory is MISSING
        ]
        if missing := [n for n in needed if params.get(n) in (None, "")]:
            raise ValueError(f"missing required parameters: {', '.join(missing)}")
        if unknown := sorted(set(params) - set(known)):
            raise ValueError(f"unknown parameters: {', '.join(unknown)}")
        return cls(**params)

    @property
    def table(self) -> str:
        """Catalog name of the structured table: ``yellow-trips`` → ``yellow_trips``."""
        return re.sub(r"\W", "_", self.source)

    def _places(self, zone: str) -> dict[str, str]:
        root = self.landing_root if zone == LANDING and self.landing_root else self.root
        return {"root": root.rstrip("/"), "zone": zone, "source": self.source}

    def zone_root(self, zone: str) -> str:
        """Directory that holds all batches of a zone."""
        return expand_path(self.pattern.split("/year={year}", 1)[0], **self._places(zone))

    def batch_path(self, zone: str, month: str) -> str:
        """Directory that holds one batch of a zone."""
        year, number = split_month(month)
        if zone == STRUCTURED:
            return f"{self.zone_root(zone)}/batch_month={month}"
        return expand_path(self.pattern, year=year, month=number, **self._places(zone))
