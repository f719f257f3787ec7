"""Z-score scaling fitted on a subset (the training split)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def standard_scale(df: DataFrame, cols: list[str], fit_filter: Column | None = None, copies: str | None = None):
    """(x - mean) / population std from the fit rows; zero variance -> 1.

    Returns (scaled frame, {col: (mean, std)}); the statistics are one
    aggregate row.  ``copies``: column with the number of rows that a row stands for."""
    fit = df.where(fit_filter) if fit_filter is not None else df
    if copies:
        return _scale_merged(df, fit, cols, copies)
    row = fit.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in cols],
                  *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in cols]).first()
    stats = {}
    for c in cols:
        s = row[f"s_{c}"]
        stats[c] = (row[f"m_{c}"], 1.0 if (s is None or s == 0) else s)
    return apply_scale(df, stats), stats


def _scale_merged(df: DataFrame, fit: DataFrame, cols: list[str], copies: str):
    n, x = F.col(copies), {c: F.col(c).cast("double") for c in cols}
    of = {c: F.sum(F.when(x[c].isNotNull(), n)) for c in cols}
    means = fit.agg(*[(F.sum(n * x[c]) / of[c]).alias(c) for c in cols]).first()
    off = {c: F.sum(n * F.pow(x[c] - F.lit(means[c]), F.lit(2.0))) for c in cols}
    devs = fit.agg(*[F.sqrt(off[c] / of[c]).alias(c) for c in cols]).first()
    stats = {c: (means[c], devs[c] or 1.0) for c in cols}
    return apply_scale(df, stats), stats


def apply_scale(df: DataFrame, stats: dict) -> DataFrame:
    """Scale by statistics that were fitted (or loaded) before."""
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(float(m))) / F.lit(float(s)) for c, (m, s) in stats.items()})


def save_scaler(spark: SparkSession, stats: dict, path: str) -> str:
    rows = [(c, float(m), float(s)) for c, (m, s) in stats.items()]
    spark.createDataFrame(rows, "column string, mean double, std double").coalesce(1).write.mode("overwrite").parquet(path)
    return path


def load_scaler(spark: SparkSession, path: str) -> dict:
    return {r["column"]: (r["mean"], r["std"]) for r in spark.read.parquet(path).collect()}  # a row per feature
