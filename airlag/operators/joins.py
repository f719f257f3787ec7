"""Join helpers with an explicit size check before any broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def row_count_at_most(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    ``take`` scans partitions incrementally and stops as soon as
    ``max_rows + 1`` rows are seen (a ``limit(..).count()`` would run a local
    limit in every partition), and only a constant column is fetched, so the
    check costs O(max_rows) on a small dimension and on a huge table alike.
    """
    return len(df.select(F.lit(1)).take(max_rows + 1)) <= max_rows


def broadcast_if_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only for a side proven to be small.

    Otherwise the frame is returned unchanged and the planner (with AQE)
    chooses a shuffle join, converting to broadcast at runtime only if the
    measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
    """
    return F.broadcast(df) if row_count_at_most(df, max_rows) else df
