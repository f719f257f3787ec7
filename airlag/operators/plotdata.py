"""Data behind the reference's plots (the drawing itself is not built)."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlag.functions.hashing import hash_bucket
from airlag.operators.exact_stats import exact_quantiles_many


def r6(c):
    return F.round(c.cast("double"), 6)


def histogram(df: DataFrame, col: str, bins: int = 50, lo: float | None = None,
              hi: float | None = None, by: str | None = None) -> DataFrame:
    """Equal-width bins over [lo, hi] (default min..max), last bin closed;
    values outside are ignored; every bin is reported (zeros included)."""
    x = F.col(col).cast("double")
    if lo is None or hi is None:
        mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
        if mm["lo"] is None:  # no values: bins of width one from the given end or 0, all empty
            mm = {"lo": 0.0 if hi is None else hi, "hi": 0.0 if lo is None else lo}
        lo = float(mm["lo"]) if lo is None else lo
        hi = float(mm["hi"]) if hi is None else hi
    width = (hi - lo) / bins if hi > lo else 1.0
    keys = [by] if by else []
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = (df.where(x.between(lo, hi)).groupBy(*keys, b.alias("bin"))
              .agg(F.count(F.lit(1)).alias("n")))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    if by:
        grid = grid.crossJoin(df.select(by).where(F.col(by).isNotNull()).distinct())
    out = grid.join(counts, [*keys, "bin"], "left").fillna(0, ["n"])
    return out.select(*keys, "bin", r6(F.lit(lo) + F.col("bin") * F.lit(width)).alias("bin_lo"),
                      r6(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("bin_hi"), "n")


def box_stats(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Quartiles, whiskers at the most extreme data inside the fences,
    outlier count."""
    x = F.col(col).cast("double")
    q = dict(zip(("q1", "median", "q3"), exact_quantiles_many(df, [col], [0.25, 0.5, 0.75])[col], strict=True))
    lo, hi = (None, None) if q["q1"] is None else (q["q1"] - k * (q["q3"] - q["q1"]), q["q3"] + k * (q["q3"] - q["q1"]))
    lo, hi = F.lit(lo).cast("double"), F.lit(hi).cast("double")
    agg = df.agg(F.min(F.when(x >= lo, x)).alias("whisker_lo"), F.max(F.when(x <= hi, x)).alias("whisker_hi"),
                 F.count_if((x < lo) | (x > hi)).alias("n_outliers"))
    agg = agg.withColumns({n: F.lit(v).cast("double") for n, v in q.items()})
    return agg.select(*[r6(F.col(c)).alias(c) for c in
                        ["q1", "median", "q3", "whisker_lo", "whisker_hi"]], "n_outliers")


def qq_points(df: DataFrame, col: str, n_points: int = 100) -> DataFrame:
    """Sample quantiles on a probability grid vs standard-normal quantiles
    (the grid has n_points entries, computed on the driver)."""
    probs = [(i + 0.5) / n_points for i in range(n_points)]
    theo = [NormalDist().inv_cdf(p) for p in probs]
    x = F.col(col).cast("double")
    quantiles = exact_quantiles_many(df, [col], probs)[col]
    row = df.agg(F.avg(x).alias("mu"), F.stddev_samp(x).alias("sd")).withColumn(
        "q", F.array(*[F.lit(q).cast("double") for q in quantiles]))
    pts = row.select(F.posexplode("q").alias("i", "sample_q"), "mu", "sd")
    theo_arr = F.array(*[F.lit(t) for t in theo])
    prob_arr = F.array(*[F.lit(p) for p in probs])
    return pts.select(F.element_at(prob_arr, F.col("i") + 1).alias("p"),
                      r6(F.element_at(theo_arr, F.col("i") + 1)).alias("theoretical"),
                      r6(F.col("sample_q")).alias("sample"),
                      r6((F.col("sample_q") - F.col("mu")) / F.col("sd")).alias("sample_z"))


def scatter_bins(df: DataFrame, x: str, y: str, bins: int = 50) -> DataFrame:
    """2-D equal-width bin counts of (x, y): the scatter plot at any scale."""
    mm = df.agg(F.min(F.col(x).cast("double")).alias("x0"), F.max(F.col(x).cast("double")).alias("x1"),
                F.min(F.col(y).cast("double")).alias("y0"), F.max(F.col(y).cast("double")).alias("y1")).first()
    if mm["x0"] is None or mm["y0"] is None:  # no points
        mm = {"x0": 0.0, "x1": 0.0, "y0": 0.0, "y1": 0.0}
    wx = (mm["x1"] - mm["x0"]) / bins if mm["x1"] > mm["x0"] else 1.0
    wy = (mm["y1"] - mm["y0"]) / bins if mm["y1"] > mm["y0"] else 1.0
    bx = F.least(F.floor((F.col(x).cast("double") - F.lit(float(mm["x0"]))) / F.lit(wx)), F.lit(bins - 1))
    by = F.least(F.floor((F.col(y).cast("double") - F.lit(float(mm["y0"]))) / F.lit(wy)), F.lit(bins - 1))
    return (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
            .groupBy(bx.cast("int").alias("x_bin"), by.cast("int").alias("y_bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def scatter_sample(df: DataFrame, key_col: str, fraction: float = 0.01, seed: int = 7) -> DataFrame:
    """Seeded hash sample of rows for point plots (a sampling operator)."""
    return df.where(hash_bucket(key_col, seed) < int(round(fraction * 10000)))
