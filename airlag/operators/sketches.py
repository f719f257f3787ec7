"""Profiles of any date range from stored monthly sketches.

One pass over the rows leaves a row per month and column: counts, moments, a
quantile sketch (KLL) and a sketch of distinct values (HyperLogLog).  Sketches
of months merge, so the profile of any range of months reads these few rows and
none of the data; a new month is one more file.

Bounds: a quantile's rank is within about ``RANK_ERROR`` of the asked one, and a
distinct count within about ``3 * DISTINCT_ERROR`` of the exact one, each with a
probability of 99 %, however many months are merged.  Counts, smallest and
largest values are exact, mean and deviation up to rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of the quantile sketches, and the rank error that goes with it.
QUANTILE_SIZE, RANK_ERROR = 2048, 0.0025
#: Binary logarithm of the registers, and the relative standard error that goes with it.
DISTINCT_LOG, DISTINCT_ERROR = 14, 0.0082
#: Names that a report gives its quartiles.
QUARTILES = (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))


def monthly_sketches(df: DataFrame, cols: list[str], month: Column) -> DataFrame:
    """``month, column, rows, count, mean, m2, min, max, quantiles, distinct`` of
    numeric columns.  A null month is a month of its own; values that are null or
    NaN count as missing; an empty table gives no rows."""
    aggs = [F.count(F.lit(1)).alias("rows")]
    for c in cols:
        x = F.col(c).cast("double")
        x = F.when(~F.isnan(x), x)
        aggs.append(F.struct(
            F.lit(c).alias("column"), F.count(x).alias("count"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"),
            F.min(x).alias("min"), F.max(x).alias("max"), F.kll_sketch_agg_double(x, QUANTILE_SIZE).alias("quantiles"),
            F.hll_sketch_agg(x.cast("string"), DISTINCT_LOG).alias("distinct")).alias(f"c__{c}"))
    wide = df.groupBy(month.alias("month")).agg(*aggs)
    return wide.select("month", "rows", F.explode(F.array(*[F.col(f"c__{c}") for c in cols])).alias("r")).select("month", "rows", "r.*")


def write_sketches(sketches: DataFrame, path: str) -> None:
    """Store sketches as one Parquet folder a month; months written again replace their folder."""
    (sketches.repartition("month").write.option("partitionOverwriteMode", "dynamic")
     .mode("overwrite").partitionBy("month").parquet(path))


def read_sketches(spark: SparkSession, path: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """Stored sketches of the months from ``first`` to ``last`` (both included);
    only their folders are read."""
    out = spark.read.parquet(path)
    if first is not None:
        out = out.where(F.col("month") >= first)
    return out.where(F.col("month") <= last) if last is not None else out


def describe_sketched(sketches: DataFrame) -> DataFrame:
    """``column, rows, count, mean, std, min, p25, p50, p75, max, n_distinct`` of all
    months in ``sketches``; quartiles and ``n_distinct`` within the module's bounds.
    A column without values has null statistics and no distinct values."""
    n = F.col("count")
    merged = sketches.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum(n).alias("count"), F.sum(n * F.col("mean")).alias("s"),
        F.sum(F.col("m2") + n * F.col("mean") * F.col("mean")).alias("q"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double(F.when(n > 0, F.col("quantiles")), QUANTILE_SIZE).alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"))
    mean = F.try_divide(F.col("s"), n)
    spread = F.greatest(F.col("q") - F.col("s") * mean, F.lit(0.0))
    return merged.select(
        "column", "rows", "count", mean.alias("mean"), F.when(n > 1, F.sqrt(spread / (n - 1))).alias("std"), "min",
        *[F.when(n > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(p))).alias(name) for name, p in QUARTILES],
        "max", F.hll_sketch_estimate("distinct").alias("n_distinct"))
