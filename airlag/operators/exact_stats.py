"""Exact quantiles and modes of many columns, without a value map in one task.

The distinct (column, value) pairs of all columns are counted in one job
(partial aggregation first) and stored in range order.  One small total per
column and range partition gives the ranks at which each partition starts, so
a quantile touches only the partitions that hold its ranks, and only the (at
most two) values of each rank reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlag.session import stored


def _counts(df: DataFrame, cols: list[str], kind: str) -> DataFrame:
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast(kind).alias("v"))
                                for i, c in enumerate(cols)])).alias("p")
    return (df.select(pairs).where(F.col("p.v").isNotNull()).groupBy(F.col("p.c").alias("c"), F.col("p.v").alias("v"))
            .agg(F.count(F.lit(1)).alias("n")))


def exact_quantiles_many(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Linear-interpolation quantiles (numpy 'linear', SQL quantile_cont) of
    every column; None for a column without values."""
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    if not cols or not probs:
        return out
    with stored(_counts(df, cols, "double").repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()),
                "value-counts") as counts:
        run = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        every = Window.partitionBy("c")
        # one row per column and range partition
        spans = counts.groupBy("c", "part").agg(F.sum("n").alias("m")).select(
            "c", "part", "m", (F.sum("m").over(run) - F.col("m")).alias("before"), F.sum("m").over(every).alias("total"))
        at = [F.floor((F.col("total") - 1) * F.lit(float(p))) for p in probs]
        ranks = F.array_distinct(F.array(*at, *[F.least(r + 1, F.col("total") - 1) for r in at]))
        asked = spans.select("c", "part", "before", "m", "total", F.explode(ranks).alias("r")).where(
            (F.col("before") <= F.col("r")) & (F.col("r") < F.col("before") + F.col("m")))
        # at most two rows per column and probability
        asked = F.broadcast(asked.select("c", "part", "before", "total", "r"))
        inside = Window.partitionBy("c", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        touched = counts.join(asked.select("c", "part").distinct(), ["c", "part"], "left_semi").withColumn("cum", F.sum("n").over(inside))
        hit = touched.join(asked, ["c", "part"]).withColumn("end", F.col("before") + F.col("cum")).where(
            (F.col("end") - F.col("n") <= F.col("r")) & (F.col("r") < F.col("end")))
        found = hit.select("c", "r", "v", "total").collect()
    value = {(x["c"], x["r"]): x["v"] for x in found}
    total = {x["c"]: x["total"] for x in found}
    for i, c in enumerate(cols):
        if i not in total:
            continue
        for k, p in enumerate(probs):
            h = (total[i] - 1) * p
            lo = int(h)
            hi, frac = min(lo + 1, total[i] - 1), h - lo
            out[c][k] = value[i, lo] + (value[i, hi] - value[i, lo]) * frac if frac else value[i, lo]
    return out


def modes(df: DataFrame, cols: list[str]) -> dict[str, str | None]:
    """Most frequent value of every column (the smallest on ties), as string."""
    if not cols:
        return {}
    best = _counts(df, cols, "string").groupBy("c").agg(F.min(F.struct((-F.col("n")).alias("minus"), "v")).alias("b"))
    found = {x["c"]: x["b"]["v"] for x in best.collect()}  # one row per column
    return {c: found.get(i) for i, c in enumerate(cols)}
