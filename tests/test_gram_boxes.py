"""Correlations from Gram blocks and the tree of boxes, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from airlag.operators import gram
from airlag.operators.smote import near_cells


@pytest.mark.parametrize("width", [512, 3])
def test_pairwise_correlations(spark, monkeypatch, width):
    monkeypatch.setattr(gram, "WIDTH", width)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    x[:, 1] += 2 * x[:, 0]
    x[:, 2] = 1e6 + x[:, 2]
    x[:, 3] = 0.1
    x[rng.random(x.shape) < 0.2] = np.nan
    cols = [f"c{i}" for i in range(8)]
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(4).withColumn("c7", F.lit(None).cast("int"))
    got = {(r["col_a"], r["col_b"]): r["r"] for r in gram.pairwise_pearson(df, cols).collect()}
    assert len(got) == 36
    for i in range(8):
        for j in range(i, 8):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 7 in (i, j) or 3 in (i, j):
                assert got[cols[i], cols[j]] is None
            else:
                assert got[cols[i], cols[j]] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-8)
    none = gram.pairwise_pearson(df.limit(0), cols).collect()
    assert len(none) == 36 and all(r["r"] is None for r in none)


def test_a_value_that_is_not_finite_spoils_its_pairs_only(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1.0), (2.0, 1.0, 2.0), (float("inf"), 5.0, None), (4.0, 4.0, 5.0)], "a double, b double, c double")
    got = {(r["col_a"], r["col_b"]): r["r"] for r in gram.pairwise_pearson(df, ["a", "b", "c"]).collect()}
    assert np.isnan(got["a", "a"]) and np.isnan(got["a", "b"]) and got["b", "b"] == pytest.approx(1)
    assert got["a", "c"] == pytest.approx(np.corrcoef([1, 2, 4], [1, 2, 5])[0, 1])


def test_wide_correlations_in_one_pass(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 500))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").select(*[F.col("v")[i].alias(f"c{i}") for i in range(500)])
    got = gram.pairwise_pearson(df, df.columns)
    assert got._jdf.queryExecution().toString().count("MapInArrow") <= 8
    found = {(r["col_a"], r["col_b"]): r["r"] for r in got.collect()}
    want = np.corrcoef(x.T)
    assert len(found) == 500 * 501 // 2
    assert max(abs(found[f"c{i}", f"c{j}"] - want[i, j]) for i in range(0, 500, 7) for j in range(i, 500, 11)) < 1e-9


@pytest.mark.parametrize("parts", [1, 3, 20])
def test_near_cells_are_all_pairs_within_reach(spark, parts):
    rng = np.random.default_rng(parts)
    paths = sorted({tuple(p) for p in rng.integers(0, parts, (300, 3)).tolist()})
    lo = np.array(paths) * 1.0 + rng.random((len(paths), 3))
    hi = lo + rng.random((len(paths), 3))
    reach = np.where(rng.random(len(paths)) < 0.1, -1, rng.random(len(paths)) * 4)
    cells = spark.createDataFrame([(list(p), float(r), a.tolist(), b.tolist()) for p, r, a, b in zip(paths, reach, lo, hi)],
                                  "_path array<long>, _reach double, _lo array<double>, _hi array<double>")
    name = lambda p: ":".join(map(str, p)) + ":2/1"
    gap = np.maximum(np.maximum(lo[None] - hi[:, None], lo[:, None] - hi[None]), 0)
    near = ((gap ** 2).sum(2) <= reach[:, None]) & (reach[:, None] >= 0) & ~np.eye(len(paths), dtype=bool)
    want = {(name(paths[i]), name(paths[j])) for i, j in zip(*np.nonzero(near))}
    got = near_cells(cells, parts, 3).collect()
    assert len(got) == len(want) and {(r["_a"], r["_b"]) for r in got} == want
