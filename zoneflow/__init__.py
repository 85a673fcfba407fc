"""Layered trip data on Spark: landing, raw, quarantine and structured zones."""

from zoneflow.config import OutlierLimits, QualityTargets, SourceConfig
from zoneflow.plans.pipeline import (
    BatchReport,
    landing_to_raw,
    raw_to_structured,
    run_month,
    run_range,
)
from zoneflow.session import build_session

__all__ = [
    "BatchReport",
    "OutlierLimits",
    "QualityTargets",
    "SourceConfig",
    "build_session",
    "landing_to_raw",
    "raw_to_structured",
    "run_month",
    "run_range",
]
