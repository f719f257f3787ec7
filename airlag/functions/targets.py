"""Targets and delay categories derived from the arrival delay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DELAY_THRESHOLD_MIN = 15


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_delayed(delay_col="arr_delay_min", threshold: float = DELAY_THRESHOLD_MIN) -> Column:
    """1 when delay is strictly above the threshold; null delay -> 0."""
    return F.coalesce(_c(delay_col) > F.lit(threshold), F.lit(False)).cast("int")


def delay_bucket3(delay_col="arr_delay_min") -> Column:
    d = _c(delay_col)
    return (F.when(d < 0, "early").when(d <= DELAY_THRESHOLD_MIN, "on_time")
            .when(d > DELAY_THRESHOLD_MIN, "delayed"))


def delay_bucket4(delay_col="arr_delay_min") -> Column:
    d = _c(delay_col)
    return (F.when(d < 0, "early").when(d <= 15, "on_time")
            .when(d <= 60, "minor").when(d > 60, "major"))
