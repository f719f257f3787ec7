"""Estimators, SMOTE, CSV ingest and streaming ingest."""

import math
import os
import random
import tempfile

import numpy as np
from pyspark.sql import functions as F

from airlag import schema as S
from airlag.operators import metrics as M
from airlag.operators.smote import minority_neighbours, smote_oversample
from airlag.plans import estimators as E
from airlag.plans.mlp import MLPModel, train_mlp
from airlag.sources.csv_ingest import combine_monthly_csv


def _planted(spark, n=3000, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        y = int(a + 0.5 * b + rng.gauss(0, 0.3) > 0)
        rows.append((f"k{i}", a, b, y))
    return spark.createDataFrame(rows, "row_key string, a double, b double, y int")


def test_smote_neighbours_exact_within_block(spark):
    rng = random.Random(7)
    pts = [(i, rng.random(), rng.random()) for i in range(200)]
    df = spark.createDataFrame([(str(i), x, y, 1) for i, x, y in pts], "_pid string, x double, y double, _m int")
    nb = {r["_pid"]: r["nbrs"] for r in minority_neighbours(df, ["x", "y"], k=5, block=1024).collect()}
    for i, x, y in pts[:40]:
        d = sorted(((x - x2) ** 2 + (y - y2) ** 2, j) for j, x2, y2 in pts if j != i)[:5]
        want = [[pts[j][1], pts[j][2]] for _, j in d]
        assert [list(v) for v in nb[str(i)]] == want


def test_smote_balances_classes(spark):
    df = _planted(spark).withColumn("y", (F.col("a") > 0.8).cast("int"))
    out = smote_oversample(df, "y", ["a", "b"], "row_key", k=3)
    counts = {r.y: r["count"] for r in out.groupBy("y").count().collect()}
    assert counts[0] == counts[1]
    syn = out.where("synthetic").select("a").toPandas()
    assert (syn["a"] >= df.where("y = 1").agg(F.min("a")).first()[0] - 1e-9).all()


def test_lr_and_persistence(spark, tmp_path):
    df = _planted(spark)
    d = E.prepare(df, ["a", "b"], "y", keep=("row_key",), checkpoint=False)
    model = E.logistic_regression(d, C=1.0, class_weight="balanced")
    pred = E.predict(model, d)
    auc = M.roc_auc(pred.select(F.col("label").cast("int").alias("y"), F.col("p1").alias("s")), "y", "s").first().roc_auc
    assert 0.85 < auc <= 1.0
    pipe = E.fit_pipeline(df.withColumn("label", F.col("y").cast("double")), ["a", "b"],
                          __import__("pyspark.ml.classification", fromlist=["x"]).LogisticRegression())
    path = str(tmp_path / "m")
    E.save_model(pipe, path, ["a", "b"], {"task": "classification"})
    loaded, meta = E.load_model(path)
    assert meta["feature_columns"] == ["a", "b"]
    p1 = [r.prediction for r in pipe.transform(df).orderBy("row_key").collect()]
    p2 = [r.prediction for r in loaded.transform(df).orderBy("row_key").collect()]
    assert p1 == p2


def test_mlp_learns_planted_signal(spark, tmp_path):
    df = _planted(spark)
    model = train_mlp(df, ["a", "b"], "y", "classification", hidden=(16, 8), max_epochs=12,
                      patience=5, learning_rate=0.02)
    pred = model.transform(df).select("y", F.col("p1").alias("s"))
    assert M.roc_auc(pred, "y", "s").first().roc_auc > 0.9
    model.save(str(tmp_path / "mlp"))
    again = MLPModel.load(str(tmp_path / "mlp"))
    a = model.transform(df).orderBy("row_key").select("p1").toPandas()["p1"].to_numpy()
    b = again.transform(df).orderBy("row_key").select("p1").toPandas()["p1"].to_numpy()
    assert np.allclose(a, b)


def test_gbt_early_stopping_keeps_the_best_prefix(spark):
    df = _planted(spark, 600).withColumn("is_val", F.col("row_key").endswith("7"))
    d = E.prepare(df, ["a", "b"], "y", keep=("is_val",), checkpoint=False).cache()
    config = dict(E.BOOSTED_DEFAULT_CLF, n_estimators=24, max_depth=3, learning_rate=0.5, early_stopping_rounds=3)
    model = E.boosted(d, "classification", config, validation_col="is_val")
    assert model.best_iteration > 0
    losses = E.boosted(d, "classification", dict(config, early_stopping_rounds=0), validation_col="is_val")
    assert len(model.trees) == model.best_iteration + 1 <= model.rounds <= 24
    assert model.rounds == 24 or model.best_iteration < model.rounds - 3
    assert model.best_score >= losses.best_score - 1e-12
    assert E.boosted(d, "classification", dict(config, n_estimators=5)).rounds == 5


def test_depth_beyond_sparks_is_an_error():
    assert E.effective_depth(None) == 30 and E.effective_depth(20) == 20
    try:
        E.effective_depth(35)
    except ValueError:
        return
    raise AssertionError


def test_load_xy_targets(spark):
    df = spark.createDataFrame([("2024-01-01", 1, "3", 20, 5), ("2024-01-02", 2, "x", 1, 6)],
                               "flight_date string, a int, b string, arr_delay_min int, dep_delay_min int")
    xy, feats, target = E.load_xy(df, "classification")
    assert (feats, target) == (["a", "b", "dep_delay_min"], "is_delayed") and "arr_delay_min" not in xy.columns
    assert sorted(r["b"] for r in xy.collect()) == [0.0, 3.0]
    assert E.load_xy(df.drop("arr_delay_min"), "regression")[2] == "dep_delay_min"
    assert E.load_xy(df, "regression", target="a")[1:] == (["b", "arr_delay_min", "dep_delay_min"], "a")
    for bad in (lambda: E.load_xy(df.select("a"), "regression"), lambda: E.load_xy(df.where("a = 1"), "classification"),
                lambda: E.load_xy(df, "regression", target="z")):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError


def test_summary_is_appended_on_disk(spark, tmp_path):
    from airlag.sources import sinks as SK
    path = str(tmp_path / "summary")
    SK.append_summary(spark.createDataFrame([("a", 0.5)], "model string, f1 double"), path)
    SK.append_summary(spark.createDataFrame([("b", 3.0)], "model string, rmse double"), path)
    got = {r["model"]: (r["f1"], r["rmse"]) for r in SK.read_summary(spark, path).collect()}
    assert got == {"a": ("0.5", None), "b": (None, "3.0")}


def test_scaler_round_trip(spark, tmp_path):
    from airlag.plans.scaling import apply_scale, load_scaler, save_scaler, standard_scale
    df = _planted(spark, 200)
    scaled, stats = standard_scale(df, ["a", "b"])
    again = apply_scale(df, load_scaler(spark, save_scaler(spark, stats, str(tmp_path / "scaler"))))
    assert sorted(map(tuple, scaled.collect())) == sorted(map(tuple, again.collect()))


def test_search_scales_and_weighs_per_fold(spark):
    from airlag.plans import tuning as T
    df = _planted(spark, 400).select("row_key", "a", "b", F.col("y").cast("double").alias("label"),
                                     (F.crc32("row_key") % 2).cast("int").alias("fold"))
    found = T.grid_search_lr(df, ["a", "b"], {"C": [0.01, 1], "penalty": ["l2"], "class_weight": [None, "balanced"]}).collect()
    assert len(found) == 4 and all(len(r["fold_scores"]) == 2 and r["mean_score"] > 0.8 for r in found)
    assert len(T.random_search_rf_regressor(df, ["a", "b"], 2, dict(T.RF_REG_RANDOM, n_estimators=[5], max_depth=[4])).collect()) == 2
    space = dict(T.BOOSTED_RANDOM, n_estimators=(3, 5), n_iter=2)
    assert len(T.random_search_boosted(df, ["a", "b"], "classification", space).collect()) == 2
    grid = T.grid_search_mlp(df, ["a", "b"], "regression", {"hidden": [(4,)], "activation": ["relu", "tanh"]}, max_epochs=2)
    assert grid.count() == 2


def test_summary_appends_at_once_and_killed_ones(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    from airlag.sources import sinks as SK
    path = str(tmp_path / "summary")
    SK.write_summary(spark.createDataFrame([("base", "0.1")], "model string, f1 string"), path)
    run = lambda i: SK.append_summary(
        spark.createDataFrame([(f"m{i}", None, i / 2)], f"model string, none_{i} double, rmse double"), path)
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(run, range(6)))
    # an append that was killed before its rename
    spark.createDataFrame([("lost", 1.0)], "model string, f1 double").write.json(path + "/_pending-x")
    got = SK.read_summary(spark, path)
    assert {r["model"]: (r["f1"], r["rmse"]) for r in got.collect()} == \
        {"base": ("0.1", None), **{f"m{i}": (None, str(i / 2)) for i in range(6)}}
    assert "none_3" in got.columns and SK.read_summary(spark, str(tmp_path / "none")) is None


def test_smote_neighbours_are_near_beyond_one_block(spark):
    rng = random.Random(9)
    pts = [(rng.random(), rng.random()) for _ in range(900)]
    df = spark.createDataFrame([(str(i), x, y, 1) for i, (x, y) in enumerate(pts)], "_pid string, x double, y double, _m int")
    nb = {r["_pid"]: r["nbrs"] for r in minority_neighbours(df, ["x", "y"], k=5, block=128).collect()}
    exact = 0
    for i, (x, y) in enumerate(pts):
        d = sorted(((x - x2) ** 2 + (y - y2) ** 2, j) for j, (x2, y2) in enumerate(pts) if j != i)
        assert len(nb[str(i)]) == 5
        exact += {tuple(v) for v in nb[str(i)]} == {pts[j] for _, j in d[:5]}
    assert exact >= 0.9 * len(pts)


def _line(vals):
    return ",".join("" if v is None else str(v) for v in vals)


def test_csv_by_header_position_and_name(spark, tmp_path):
    names = [S.ORIGINAL_NAMES[c] for c in S.RAW_COLS]
    rec = ["UR", "01/02/2024", 12, "N1", "ATL", "10:00", "10:05", "10:01", 60, 65, 5, 3, 0, 0, 0, 0, 0]
    order = [0, 1, *range(16, 1, -1)]  # the other columns backwards
    files = {
        "a.csv": ["Report A", "Carrier list, by date", ",".join(names), _line(rec), "", _line(["AA", "01/03/2024", *rec[2:]])],
        "b.csv": ["Only one preamble line", ",".join(names), _line(["HI", *rec[1:]]), "Total: 2"],
        "c.csv": [",".join(names[i] for i in order), _line([rec[i] for i in order]), _line(["QU", *rec[1:2], *[rec[i] for i in order[2:]]])],
        "d.csv": [",".join(names), _line([*rec[:4], '"Atlanta, GA"', *rec[5:]]), _line(["SH", "01/05/2024", 7])],
        "e.csv": ["Flight Number,Carrier Code", "77,NP"],
    }
    for name, lines in files.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    df = combine_monthly_csv(spark, str(tmp_path))
    pad = lambda v: tuple([*v, *[None] * (17 - len(v))])
    want = [tuple(rec), ("AA", "01/03/2024", *rec[2:]), ("HI", *rec[1:]), pad(["Total: 2"]), tuple(rec), ("QU", *rec[1:]),
            (*rec[:4], "Atlanta, GA", *rec[5:]), pad(["SH", "01/05/2024", 7]), pad(["NP", None, 77])]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)
    assert df.schema["arr_delay_min"].dataType.simpleString() == "smallint"


def test_streaming_ingest(spark, tmp_path):
    from airlag.sources.csv_ingest import write_monthly_csv
    from airlag.streaming.monthly_ingest import ingest_until_caught_up
    rows = [("UR", f"0{m}/1{d}/2024", 100 + d, "N1", "ATL", "10:00", None, "10:01", 60, 65, 5, 3, 0, 0, 0, 0, 0)
            for m in (1, 2, 3) for d in range(5)]
    raw = spark.createDataFrame(rows, S.RAW_STRING_SCHEMA).select(
        *[F.col(c).cast(S.RAW_SCHEMA[c].dataType).alias(c) for c in S.RAW_COLS])
    src = str(tmp_path / "drop")
    write_monthly_csv(raw, src)
    out = ingest_until_caught_up(spark, src, str(tmp_path / "stage"), str(tmp_path / "ckpt"))
    assert sorted(map(tuple, out.select(*S.RAW_COLS).collect())) == sorted(map(tuple, raw.collect()))


def test_boosted_queries_run_the_published_rounds(spark, monkeypatch):
    from unittest.mock import MagicMock

    from airlag.operators import splits
    from airlag.plans import q_models as Q
    asked = []

    class Stop(Exception):
        pass

    def boosted(df, task, config, validation_col=None):
        asked.append((task, config["n_estimators"], config["early_stopping_rounds"], validation_col))
        raise Stop

    monkeypatch.setattr(Q, "model_frame", MagicMock())
    monkeypatch.setattr(splits, "scale_pos_weight", MagicMock())
    monkeypatch.setattr(E, "boosted", boosted)
    for run in (Q.q_boosted_classifier, Q.q_importance_by_type, Q.q_model_info, Q.q_write_json_report, Q.q_boosted_regressor):
        try:
            run(spark, None)
        except Stop:
            continue
    assert asked == [("classification", 1516, 50, "is_val")] * 4 + [("regression", 1576, 50, "is_val")]


def test_smote_neighbours_exact_over_many_cells(spark):
    rng = random.Random(11)
    # discrete and continuous features, a frequent value, more dimensions than levels, a far cluster
    pts = sorted({(rng.choice([0.0, 0.0, 0.0, 6.0, 12.0]), float(rng.randrange(25)), rng.gauss(0, 2), rng.gauss(0, 2),
                   rng.gauss(0, 2), float(rng.random() < 0.3)) for _ in range(1200)} | {(500.0 + i, 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(3)})
    names = [f"f{j}" for j in range(6)]
    df = spark.createDataFrame([(str(i), *x, 1 + i % 3) for i, x in enumerate(pts)], ["_pid", *names, "_m"])
    nb = {r["_pid"]: r["nbrs"] for r in minority_neighbours(df, names, k=5, block=16).collect()}
    x = np.array(pts)
    for i in range(len(pts)):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        copies = i % 3
        want = sorted(range(len(pts)), key=lambda j: (d[j], str(j)))[:5 - copies]
        assert [tuple(v) for v in nb[str(i)]] == [pts[i]] * copies + [pts[j] for j in want]
