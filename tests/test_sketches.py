"""Merged monthly sketches against exact statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlag.operators import sketches as K


def test_ranges_of_months(spark, tmp_path):
    rng = np.random.default_rng(3)
    month = rng.integers(1, 7, 30_000)
    a, b = rng.normal(5, 40, 30_000).round(1), rng.integers(0, 3000, 30_000).astype(float)
    b[rng.random(30_000) < 0.3] = np.nan
    rows = [(f"2024-{m:02d}", float(x), None if np.isnan(y) else int(y)) for m, x, y in zip(month, a, b)]
    df = spark.createDataFrame(rows, "m string, a double, b int").withColumn("none", F.lit(None).cast("double")).repartition(6)
    path = str(tmp_path / "sketches")
    K.write_sketches(K.monthly_sketches(df, ["a", "b", "none"], F.col("m")), path)
    for first, last in ((1, 6), (2, 3), (5, 5)):
        got = {r["column"]: r for r in K.describe_sketched(K.read_sketches(spark, path, f"2024-{first:02d}", f"2024-{last:02d}")).collect()}
        here = (month >= first) & (month <= last)
        for name, all_x in (("a", a), ("b", b)):
            x, r = np.sort(all_x[here & ~np.isnan(all_x)]), got[name]
            assert (r["rows"], r["count"], r["min"], r["max"]) == (here.sum(), len(x), x[0], x[-1])
            assert r["mean"] == pytest.approx(x.mean()) and r["std"] == pytest.approx(x.std(ddof=1))
            for q, p in K.QUARTILES:
                lo, hi = np.searchsorted(x, r[q], "left") / len(x), np.searchsorted(x, r[q], "right") / len(x)
                assert lo - K.RANK_ERROR <= p <= hi + K.RANK_ERROR
            assert abs(r["n_distinct"] - len(np.unique(x))) <= 3 * K.DISTINCT_ERROR * len(np.unique(x)) + 1
        none = got["none"]
        assert (none["count"], none["mean"], none["std"], none["p50"], none["max"], none["n_distinct"]) == (0, None, None, None, None, 0)
    K.write_sketches(K.monthly_sketches(df.where("m = '2024-05'").limit(10), ["a", "b", "none"], F.col("m")), path)
    again = K.describe_sketched(K.read_sketches(spark, path)).where("column = 'a'").first()
    assert again["count"] == 30_000 - (month == 5).sum() + 10
    assert K.monthly_sketches(df.limit(0), ["a"], F.col("m")).count() == 0
