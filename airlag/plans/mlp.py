"""Data-parallel multi-layer perceptron (ReLU or tanh hidden layers, Adam, L2).

Spark ML has no ReLU/Adam network with sample weights and no MLP regressor, so
the network is trained the data-parallel way.  An epoch is one Spark job.  The
rows are dealt to shards by a hash of their key; the task of a shard starts from
the weights of the epoch, takes one Adam step per ``batch_rows`` rows with NumPy
inside ``mapInPandas`` (``CHUNK_ROWS`` rows at a time, permuted anew in every epoch), and returns
its weights and moments, which ``treeReduce`` averages by rows.  The number of
shards grows with the square root of the rows, and so do the steps of a shard:
more data means more tasks and more steps, and one task never holds more than
``CHUNK_ROWS`` rows and an Arrow batch.  A small table is one shard, which is the plain algorithm.

No barrier stage: that needs all its tasks running at once and starts all of them
again when one is lost.  Here a lost task starts again alone, from the weights of
the epoch, and returns the same numbers, since shards, batches and permutations
depend on keys, seed and epoch only.

Several networks train in the same pass (``train_networks``): networks of one
shape are stacked along a leading axis and go through batched matrix products,
the stacks in jobs that run side by side.
The rows are stored first, and kept by the executors between epochs.

Where features repeat (``MERGE_FROM`` rows for each set of values, or more), rows of
equal features and use are merged into one with their weight and mean label.  Both
losses and their gradients see no more of them: cross entropy is linear in the label,
and a squared error is that of the mean label plus a spread which no weight changes.
A step then takes ``batch_rows`` merged rows.  An epoch costs the number of different
feature values, not of rows, and a table without copies trains as it is.
"""

from __future__ import annotations

import datetime as dt
import io
import json
import math
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airlag.functions.hashing import hash_bucket
from airlag.session import cut_lineage, ship_package

#: Rows of an optimiser step.  Fixed value: the published batch size.
BATCH_ROWS = 200
#: Rows a task holds at once and permutes, whatever size the session gives Arrow batches.
CHUNK_ROWS = 10_000
#: A table of up to so many rows is one shard; s squared times as many are s shards.
SHARD_ROWS = 2048
#: Rows for each different set of feature values from which training goes over merged rows.
MERGE_FROM = 2
#: Networks of a stack, whose arrays for a step then fit a core's cache, and jobs of an
#: epoch that share out the stacks: merged rows are few shards, less than there are cores.
STACK, JOBS = 6, 3


def _init(sizes, seed):
    rng = np.random.default_rng(seed)
    params = []
    for fan_in, fan_out in zip(sizes[:-1], sizes[1:]):
        bound = np.sqrt(6.0 / (fan_in + fan_out))
        params.append(rng.uniform(-bound, bound, (fan_in, fan_out)))
        params.append(rng.uniform(-bound, bound, fan_out))
    return params


def _forward(params, x, activation="relu"):
    acts = [x]
    h = x
    n_layers = len(params) // 2
    for i in range(n_layers):
        z = h @ params[2 * i] + params[2 * i + 1]
        if i < n_layers - 1:
            h = np.tanh(z) if activation == "tanh" else np.maximum(z, 0.0)
        else:
            h = z
        acts.append(h)
    return acts


def _of_output(out, y, w, task):
    """Loss summed over rows, and its slope at the output of each row."""
    if task == "classification":
        p = 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))
        eps = 1e-12
        return -np.sum(w * (y * np.log(p + eps) + (1 - y) * np.log(1 - p + eps)), axis=-1), w * (p - y)
    err = out - y
    return 0.5 * np.sum(w * err * err, axis=-1), w * err


def _loss(params, x, y, w, task, activation="relu"):
    return _of_output(_forward(params, x, activation)[-1][..., 0], y, w, task)[0]


def _loss_grad(params, x, y, w, task, activation="relu"):
    """Loss and gradients, summed over rows, of a stack of networks: every
    array of ``params`` and ``w`` has a leading axis of networks."""
    acts = _forward(params, x, activation)
    loss, slopes = _of_output(acts[-1][..., 0], y, w, task)
    delta = slopes[..., None]
    grads = [None] * len(params)
    for i in reversed(range(len(params) // 2)):
        grads[2 * i] = np.swapaxes(acts[i], -1, -2) @ delta
        grads[2 * i + 1] = delta.sum(axis=-2, keepdims=True)
        if i > 0:
            slope = 1.0 - acts[i] ** 2 if activation == "tanh" else acts[i] > 0
            delta = (delta @ np.swapaxes(params[2 * i], -1, -2)) * slope
    return loss, grads


class MLPModel:
    """A trained network.  ``scaler`` ({feature: (mean, std)}) is applied to
    the features before the first layer, so a loaded model scores raw rows."""

    def __init__(self, params, task, feature_cols, history=None, activation="relu", scaler=None):
        self.params, self.task, self.feature_cols = params, task, feature_cols
        self.history, self.activation, self.scaler = history or [], activation, scaler

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``p1`` and ``prediction`` (classification) or ``prediction``."""
        params, task, activation = self.params, self.task, self.activation
        ship_package(df.sparkSession)
        inputs = []
        for c in self.feature_cols:
            mean, std = (self.scaler or {}).get(c, (0.0, 1.0))
            inputs.append((F.col(c).cast("double") - F.lit(float(mean))) / F.lit(float(std)))

        @F.pandas_udf(T.DoubleType())
        def _predict(*cols: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=np.float64) for c in cols])
            out = _forward(params, x, activation)[-1][:, 0]
            if task == "classification":
                out = 1.0 / (1.0 + np.exp(-np.clip(out, -35, 35)))
            return pd.Series(out)

        out = df.withColumn("_out", _predict(*inputs))
        if task == "classification":
            return out.withColumnRenamed("_out", "p1").withColumn(
                "prediction", (F.col("p1") > 0.5).cast("double"))
        return out.withColumnRenamed("_out", "prediction")

    def save(self, path: str):
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        buf = io.BytesIO()
        np.savez(buf, *self.params)
        side = {"features": self.feature_cols, "activation": self.activation, "scaler": self.scaler,
                "epochs": len(self.history), "saved_at": dt.datetime.now(dt.timezone.utc).isoformat()}
        spark.createDataFrame([(self.task, json.dumps(side), bytearray(buf.getvalue()))],
                              "task string, meta string, params binary") \
            .coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(path: str) -> "MLPModel":
        from pyspark.sql import SparkSession
        row = SparkSession.getActiveSession().read.parquet(path).first()
        z = np.load(io.BytesIO(bytes(row["params"])))
        side = json.loads(row["meta"])
        return MLPModel([z[f"arr_{i}"] for i in range(len(z.files))], row["task"], side["features"],
                        activation=side["activation"], scaler=side["scaler"])


class _Stack:
    """Networks of one shape and activation, trained side by side.  ``ids`` are
    their places in the list of all networks; ``fold`` is the fold a network does
    not learn from (-1: none), ``at`` its place among ``folds``, those of all networks."""

    def __init__(self, ids, networks, n_features, seed, folds):
        one = networks[0]
        start = _init([n_features, *one["hidden"], 1], seed)
        self.ids, self.activation = np.array(ids), one["activation"]
        c = len(ids)
        self.params = [np.repeat((a if a.ndim == 2 else a[None, :])[None], c, axis=0) for a in start]
        self.m = [np.zeros_like(a) for a in self.params]
        self.v = [np.zeros_like(a) for a in self.params]
        self.t = np.zeros(c)
        self.alpha, self.rate = (np.array([n[k] for n in networks])[:, None, None] for k in ("alpha", "learning_rate"))
        self.fold = np.array([n.get("fold", -1) for n in networks])
        self.at = np.searchsorted(folds, self.fold)
        stats = [n.get("stats") for n in networks]
        self.stats = None if stats[0] is None else tuple(np.array([s[i] for s in stats])[:, None, :] for i in (0, 1))

    def copy(self):
        other = object.__new__(_Stack)
        other.__dict__ = dict(self.__dict__, params=[a.copy() for a in self.params], m=[a.copy() for a in self.m],
                              v=[a.copy() for a in self.v], t=self.t.copy())
        return other

    def only(self, keep):
        """The networks that ``keep`` (a mask) marks."""
        other = object.__new__(_Stack)
        pick = lambda a: a[keep]
        other.__dict__ = dict(
            self.__dict__, ids=pick(self.ids), params=[pick(a) for a in self.params], m=[pick(a) for a in self.m],
            v=[pick(a) for a in self.v], t=pick(self.t), alpha=pick(self.alpha), rate=pick(self.rate), fold=pick(self.fold), at=pick(self.at),
            stats=None if self.stats is None else tuple(pick(a) for a in self.stats))
        return other

    def inputs(self, x):
        return x if self.stats is None else (x - self.stats[0]) / self.stats[1]

    def outputs(self, x):
        return _forward(self.params, self.inputs(x), self.activation)[-1][..., 0]

    def step(self, x, y, w, task):
        """One Adam step per network that has rows here; returns their weight."""
        n = w.sum(axis=-1)
        has = n > 0
        if not has.any():
            return n
        _, grads = _loss_grad(self.params, self.inputs(x), y, w, task, self.activation)
        b1, b2, eps = 0.9, 0.999, 1e-8
        self.t = self.t + has
        per = np.where(has, n, 1.0)[:, None, None]
        t = np.maximum(self.t, 1.0)[:, None, None]
        on = has[:, None, None]
        rate = np.where(on, self.rate * np.sqrt(1 - b2 ** t) / (1 - b1 ** t), 0.0)
        for i, g in enumerate(grads):
            g = (g + self.alpha * self.params[i]) / per if i % 2 == 0 else g / per  # L2 on weight matrices
            self.m[i] = np.where(on, b1 * self.m[i] + (1 - b1) * g, self.m[i])
            self.v[i] = np.where(on, b2 * self.v[i] + (1 - b2) * g * g, self.v[i])
            self.params[i] = self.params[i] - rate * self.m[i] / (np.sqrt(self.v[i]) + eps)
        return n

    def state(self):
        """Weights, moments and step counts: a row of numbers per network."""
        c = len(self.ids)
        return np.concatenate([a.reshape(c, -1) for a in (*self.params, *self.m, *self.v, self.t[:, None])], axis=1)

    def load(self, rows):
        i = 0
        for arrays in (self.params, self.m, self.v):
            for k, a in enumerate(arrays):
                width = a[0].size
                arrays[k] = rows[:, i:i + width].reshape(a.shape)
                i += width
        self.t = rows[:, i]

    def network(self, k):
        """Weights of one network as (matrix, vector) pairs."""
        return [a[k].copy() if i % 2 == 0 else a[k, 0].copy() for i, a in enumerate(self.params)]


def shards_of(rows: int) -> int:
    return max(1, math.ceil(math.sqrt(rows / SHARD_ROWS)))


def _chunks(batches):
    """The rows of a task's Arrow batches, ``CHUNK_ROWS`` at a time."""
    held, n = [], 0
    for pdf in batches:
        while len(pdf):
            part, pdf = pdf.iloc[:CHUNK_ROWS - n], pdf.iloc[CHUNK_ROWS - n:]
            held.append(part)
            n += len(part)
            if n == CHUNK_ROWS:
                yield pd.concat(held, ignore_index=True)
                held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _reduce(df: DataFrame):
    """Sum of the vectors in column ``g``, a row per task, as a tree."""
    vectors = df.rdd.map(lambda r: np.frombuffer(r["g"], dtype=np.float64))
    return vectors.treeReduce(lambda a, b: a + b, depth=2 if df.rdd.getNumPartitions() > 64 else 1)


def _merged_rows(frame: DataFrame, xcols: list[str], middle: float) -> DataFrame:
    """A row for all of equal features, use and fold: their number, those of label
    1, and sums of the label and its square less ``middle``, also weighted."""
    y, w = F.coalesce(F.col("y"), F.lit(math.nan)) - F.lit(middle), F.col("w")
    return frame.groupBy(*xcols, "val", "fold").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.count_if(F.col("y") == 1).cast("double").alias("ones"),
        F.sum(y).alias("y"), F.sum(y * y).alias("yy"), F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy"))


def _spread(squares: str, total: str, weight: str):
    """Sum of squares about the mean."""
    return F.greatest(F.col(squares) - F.col(total) * F.col(total) / F.col(weight), F.lit(0.0))


def _without_fold(by_fold: DataFrame, xcols: list[str], folds: list[int], middle: float, seed: int, task: str) -> DataFrame:
    """A row for all of equal features and use: of its rows outside the i-th of
    ``folds`` the mean label ``yi``, weight ``wi`` and the loss ``si`` that the
    mean label leaves out, and a hash ``h`` to deal it by."""
    sums = by_fold.groupBy(*xcols, "val").agg(
        *[F.coalesce(F.sum(F.when(~F.col("fold").eqNullSafe(f), F.col(c))), F.lit(0.0)).alias(f"{c}{i}") for i, f in enumerate(folds) for c in ("w", "wy", "wyy")])
    some = lambda i, x: F.when(F.col(f"w{i}") > 0, x).otherwise(0.0)
    return sums.select(*xcols, "val", F.xxhash64(F.lit(seed), *xcols, "val").alias("h"), *[x for i in range(len(folds)) for x in (
        some(i, F.lit(middle) + F.col(f"wy{i}") / F.col(f"w{i}")).alias(f"y{i}"), F.col(f"w{i}"),
        some(i, 0.5 * _spread(f"wyy{i}", f"wy{i}", f"w{i}") if task == "regression" else F.lit(0.0)).alias(f"s{i}"))])


def train_networks(df: DataFrame, feature_cols: list[str], label: str, task: str, networks: list[dict],
                   max_epochs: int = 100, batch_rows: int = BATCH_ROWS, val_frac: float = 0.1, patience: int = 10,
                   tol: float = 1e-4, weight_col: str | None = None, fold_col: str | None = None,
                   key_col: str = "row_key", seed: int = 42):
    """Train all ``networks`` in the same passes, a job per epoch.

    A network is a dict of ``hidden``, ``activation``, ``alpha``, ``learning_rate``
    and, if wanted, ``fold`` (rows of ``fold_col`` that it does not see) and
    ``stats`` (means and deviations its inputs are scaled by).  Each ends when its
    loss on held-back rows (``val_frac`` of the keys) has not fallen by ``tol``
    (regression: R squared not risen by it) for ``patience`` epochs; then the
    others go on without it.  Returns (weights,
    losses) per network and, if there are folds, sums over the rows of its own
    fold per network: count, squared error, absolute error (NaN where rows are
    merged, which keep no more than their mean and spread), and the counts of
    true positives and of wrong classes."""
    xcols = [f"_x{i}" for i in range(len(feature_cols))]
    frame = cut_lineage(df.select(
        *[F.col(c).cast("double").alias(x) for c, x in zip(feature_cols, xcols)],
        F.col(label).cast("double").alias("y"),
        (F.col(weight_col).cast("double") if weight_col else F.lit(1.0)).alias("w"),
        (F.col(fold_col).cast("int") if fold_col else F.lit(-2)).alias("fold"),
        (hash_bucket(key_col, seed + 2) < int(val_frac * 10000)).alias("val"),
        F.xxhash64(F.lit(seed), F.col(key_col)).alias("h")))
    spark = df.sparkSession
    ship_package(spark)
    groups = frame.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.var_pop("y").alias("v")).collect()  # a row per fold
    n_rows = sum(g["n"] for g in groups)

    def target(fold):
        """Mean of the rows learned from and the least gain that counts: for
        regression ``tol`` is in units of R squared, a share of their variance."""
        rest = [g for g in groups if g["fold"] != fold]
        n = sum(g["n"] for g in rest)
        if task != "regression" or not n:
            return 0.0, tol
        mean = sum(g["n"] * g["m"] for g in rest) / n
        return mean, tol * sum(g["n"] * (g["v"] + (g["m"] - mean) ** 2) for g in rest) / n / 2

    means, gains = zip(*(target(n.get("fold", -1)) for n in networks))
    folds = sorted({n.get("fold", -1) for n in networks})
    different = frame.agg(F.approx_count_distinct(F.xxhash64(*xcols))).first()[0]
    merged = n_rows >= MERGE_FROM * max(different, 1)
    if merged:
        middle = float(round(sum(g["n"] * g["m"] for g in groups) / n_rows)) if task == "regression" else 0.0
        by_fold = cut_lineage(_merged_rows(frame, xcols, middle), "merged")
        frame = _without_fold(by_fold, xcols, folds, middle, seed, task)
    # merged, a row of each set of values for training and one held back, at most
    frame = frame.repartition(shards_of(frame.count() if merged else n_rows), "h").sortWithinPartitions("h").drop("h").persist()

    shapes: dict[tuple, list[int]] = {}
    for i, n in enumerate(networks):
        shapes.setdefault((tuple(n["hidden"]), n["activation"], n.get("stats") is None), []).append(i)
    active = [_Stack(ids, [networks[i] for i in ids], len(feature_cols), seed, folds)
              for of_shape in shapes.values() for ids in (of_shape[k:k + STACK] for k in range(0, len(of_shape), STACK))]
    for s in active:  # the output of a regression starts at the mean, not at zero
        s.params[-1] = s.params[-1] + np.array([means[i] for i in s.ids])[:, None, None]
    everyone = [s.copy() for s in active]
    best = {int(i): s.network(k) for s in active for k, i in enumerate(s.ids)}
    best_loss, bad = dict.fromkeys(best, np.inf), dict.fromkeys(best, 0)
    history: dict[int, list[float]] = {i: [] for i in best}

    def arrays(pdf):
        """Features and use of rows; label, weight and loss left out of each without each of ``folds``."""
        x, val = pdf[xcols].to_numpy(dtype=np.float64), pdf["val"].to_numpy()
        if merged:
            return x, val, *(pdf[[f"{c}{j}" for j in range(len(folds))]].to_numpy(dtype=np.float64).T for c in "yws")
        y, w = (np.repeat(pdf[c].to_numpy(dtype=np.float64)[None, :], len(folds), axis=0) for c in "yw")
        return x, val, y, np.where(pdf["fold"].to_numpy()[None, :] == np.array(folds)[:, None], 0.0, w), np.zeros_like(y)

    def run(epoch, stacks):
        """Held-back loss under the present weights, and the averaged state after an epoch."""
        present = spark.sparkContext.broadcast(stacks)

        def train(batches):
            start, shard = present.value, TaskContext.get().partitionId()
            local = [s.copy() for s in start]
            seen, lost, held = ([np.zeros(len(s.ids)) for s in start] for _ in range(3))
            for number, pdf in enumerate(_chunks(batches)):
                x, val, y, w, more = arrays(pdf)
                if val.any():
                    for j, s in enumerate(start):
                        own = w[s.at][:, val]
                        lost[j] += _loss(s.params, s.inputs(x[val]), y[s.at][:, val], own, task, s.activation) + more[s.at][:, val].sum(axis=-1)
                        held[j] += own.sum(axis=-1)
                order = np.random.default_rng([seed, epoch, shard, number]).permutation(np.flatnonzero(~val))
                for k in range(0, len(order), batch_rows):
                    rows = order[k:k + batch_rows]
                    for j, s in enumerate(local):
                        seen[j] += s.step(x[rows], y[:, rows][s.at], w[:, rows][s.at], task)
            parts = [np.concatenate([lost[j][:, None], held[j][:, None], seen[j][:, None], seen[j][:, None] * s.state()], axis=1)
                     for j, s in enumerate(local)]
            yield pd.DataFrame({"g": [np.concatenate([a.ravel() for a in parts]).tobytes()]})

        flat = _reduce(frame.mapInPandas(train, "g binary"))
        present.destroy()
        out, i = [], 0
        for s in stacks:
            width = 3 + s.state().shape[1]
            out.append(flat[i:i + len(s.ids) * width].reshape(len(s.ids), width))
            i += len(s.ids) * width
        return out

    for epoch in range(max_epochs + 1 if n_rows else 0):  # an empty table leaves the first weights
        going, found = [], [None] * len(active)
        jobs = min(JOBS, len(active))
        with ThreadPool(jobs) as pool:
            for k, part in enumerate(pool.map(lambda k: run(epoch, active[k::jobs]), range(jobs))):  # noqa: B023
                found[k::jobs] = part
        for s, sums in zip(active, found, strict=True):
            keep = np.ones(len(s.ids), dtype=bool)
            for k, i in enumerate(s.ids.tolist()):
                lost, held = sums[k, 0], sums[k, 1]
                if epoch > 0:
                    history[i].append(float(lost / held) if held else math.nan)
                    if not held or lost / held < best_loss[i] - gains[i]:  # nothing held back: the last weights
                        best[i], best_loss[i], bad[i] = s.network(k), lost / held if held else np.inf, 0
                    else:
                        bad[i] += 1
                keep[k] = bad[i] < patience
            trained = sums[:, 2] > 0
            s.load(np.where(trained[:, None], sums[:, 3:] / np.where(trained, sums[:, 2], 1.0)[:, None], s.state()))
            if keep.any():
                going.append(s if keep.all() else s.only(keep))
        active = going
        if not active:
            break

    for s in everyone:
        s.params = [np.stack([best[i][k] if k % 2 == 0 else best[i][k][None, :] for i in s.ids.tolist()])
                    for k in range(len(s.params))]
    sums = np.zeros((len(networks), 5)) if fold_col else None
    if fold_col and n_rows:
        final = spark.sparkContext.broadcast(everyone)

        def score(batches):
            total = np.zeros((len(networks), 5))
            for pdf in batches:
                x, fold, y = pdf[xcols].to_numpy(dtype=np.float64), pdf["fold"].to_numpy(), pdf["y"].to_numpy(dtype=np.float64)
                one = np.ones(len(pdf))
                n, spread, ones = (pdf[c].to_numpy(dtype=np.float64) for c in ("n", "s", "ones")) if merged else (one, 0.0 * one, one * (y == 1))
                for s in final.value:
                    for f in np.unique(s.fold):
                        part, rows = s.only(s.fold == f), fold == f
                        out, m, hits = part.outputs(x[rows]), n[rows], ones[rows]
                        yes, err = out > 0, out - y[rows]
                        total[part.ids] += np.stack([
                            np.full(len(part.ids), m.sum()), (m * err * err + spread[rows]).sum(axis=-1),
                            np.full(len(part.ids), np.nan) if merged else np.abs(err).sum(axis=-1),
                            (yes * hits).sum(axis=-1), np.where(yes, m - hits, hits).sum(axis=-1)], axis=1)
            yield pd.DataFrame({"g": [total.tobytes()]})

        scored = by_fold.select(*xcols, "fold", "n", "ones", (F.lit(middle) + F.col("y") / F.col("n")).alias("y"),
                                _spread("yy", "y", "n").alias("s")) if merged else frame
        sums = _reduce(scored.mapInPandas(score, "g binary")).reshape(-1, 5)
        final.destroy()
    frame.unpersist()
    return [(best[i], history[i]) for i in range(len(networks))], sums


def train_mlp(df: DataFrame, feature_cols: list[str], label: str, task: str = "classification",
              hidden=(100, 50), alpha: float = 1e-4, learning_rate: float = 1e-3,
              max_epochs: int = 100, batch_rows: int = BATCH_ROWS, val_frac: float = 0.1, patience: int = 10,
              tol: float = 1e-4, weight_col: str | None = None, key_col: str = "row_key",
              seed: int = 42, activation: str = "relu", scaler: dict | None = None) -> MLPModel:
    """One network.  ``scaler``: statistics the features of ``df`` were scaled
    with, kept in the model."""
    network = {"hidden": hidden, "activation": activation, "alpha": alpha, "learning_rate": learning_rate}
    [(params, history)], _ = train_networks(
        df, feature_cols, label, task, [network], max_epochs, batch_rows, val_frac, patience, tol, weight_col,
        key_col=key_col, seed=seed)
    return MLPModel(params, task, feature_cols, history, activation, scaler)
