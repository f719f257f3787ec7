"""Pairwise-complete correlations from masked Gram blocks.

Columns travel to the tasks as Arrow batches.  With X the values (0 where null)
and M the marks of what is there, the joint counts, sums, squares and products
of all pairs of columns are the matrix products M'M, X'M, (XX)'M and X'X, added
up batch by batch.  A task returns a row per pair of columns, and these are
summed by pair, so the plan has the same size for any number of columns.
Values are taken relative to a value of their column, which keeps the sums
small against the spread.  Beyond ``WIDTH`` columns, pairs of blocks of
columns are added up one after the other, which bounds a task's matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlag.session import ship_package

#: Columns of a block; a task holds six matrices of so many rows and columns, or two blocks' worth.
WIDTH = 512
#: Share of the sum of squares below which a spread is rounding.
ROUNDING = 1e-13
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy", "bad")


def _anchors(df: DataFrame, cols: list[str]) -> np.ndarray:
    """A finite value of every column, 0 where there is none."""
    d = [F.col(c).cast("double") for c in cols]
    row = df.agg(*[F.first(F.when(F.abs(x) < F.lit(float("inf")), x), ignorenulls=True).alias(f"a{i}") for i, x in enumerate(d)]).first()
    return np.array([0.0 if v is None else v for v in row])


def _sums(left: list[int], right: list[int], anchors: np.ndarray):
    """Sums of a task for the pairs (a, b), a from ``left``, b from ``right``, a <= b."""
    def run(batches):
        own = sorted({*left, *right})
        la, ra = ([own.index(i) for i in side] for side in (left, right))
        total = np.zeros((len(SUMS), len(left), len(right)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)
            there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns], axis=1).astype(float)
            odd = (there > 0) & ~np.isfinite(x)
            x = np.where((there > 0) & ~odd, x - anchors[own], 0.0)
            xl, xr, ml, mr = x[:, la], x[:, ra], there[:, la], there[:, ra]
            for k, m in enumerate((ml.T @ mr, xl.T @ mr, ml.T @ xr, (xl * xl).T @ mr, ml.T @ (xr * xr), xl.T @ xr)):
                total[k] += m
            if odd.any():
                ol, o_r = odd[:, la].astype(float), odd[:, ra].astype(float)
                total[6] += ol.T @ mr + ml.T @ o_r
        a, b = np.meshgrid(left, right, indexing="ij")
        kept = a <= b
        yield pa.RecordBatch.from_arrays([pa.array(a[kept]), pa.array(b[kept]), *[pa.array(t[kept]) for t in total]], ["a", "b", *SUMS])
    return run


def pairwise_pearson(df: DataFrame, cols: list[str]) -> DataFrame:
    """``col_a, col_b, r`` of every pair of columns in their order, and of each
    with itself.  An empty table has the same rows, with null."""
    spark = df.sparkSession
    ship_package(spark)
    anchors = _anchors(df, cols)
    blocks = [list(range(lo, min(lo + WIDTH, len(cols)))) for lo in range(0, len(cols), WIDTH)]
    names = F.array(*[F.lit(c) for c in cols])
    schema = "a long, b long, " + ", ".join(f"{s} double" for s in SUMS)
    sums = spark.range(len(cols)).select(F.col("id").alias("a"), F.explode(F.sequence("id", F.lit(len(cols) - 1).cast("long"))).alias("b"),
                                         *[F.lit(0.0).alias(s) for s in SUMS])
    for i, left in enumerate(blocks):
        for right in blocks[i:]:
            own = sorted({*left, *right})
            part = df.select(*[F.col(cols[c]).cast("double").alias(f"x{c}") for c in own])
            sums = sums.unionByName(part.mapInArrow(_sums(left, right, anchors), schema))
    found = sums.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in SUMS])
    spread = lambda q, t: F.when(F.col("n") * F.col(q) - F.col(t) * F.col(t) > ROUNDING * F.col("n") * F.col(q),
                                 F.col("n") * F.col(q) - F.col(t) * F.col(t))
    r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / (F.sqrt(spread("sxx", "sx")) * F.sqrt(spread("syy", "sy")))
    return found.select(F.element_at(names, (F.col("a") + 1).cast("int")).alias("col_a"),
                        F.element_at(names, (F.col("b") + 1).cast("int")).alias("col_b"),
                        F.when(F.col("bad") > 0, F.lit(float("nan"))).otherwise(r).alias("r"))
