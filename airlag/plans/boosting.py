"""Second-order gradient boosting on histograms, one tree at a time.

Features are binned once to bytes (``BINS`` quantile bins each).  Rows that the
method cannot tell apart, those of equal bins, label, weight and use, become one
with a count; they are stored in blocks below the checkpoint folder.  A tree grows level by level: each
level is one aggregate of gradient and hessian sums by (node, feature, bin),
added up in the tasks, so what reaches the driver has the size of the level's
histogram whatever the number of rows.  The driver picks the splits; a tree is
a few arrays that go to the tasks with the next job.

The state between trees is every row's score so far.  It is kept with the
blocks as a persisted RDD of arrays (the one place where tasks need mutable
per-block state that a DataFrame cannot hold between jobs), gets the new tree
added in the first job of the next round, and is checkpointed to the shared
folder every ``CHECKPOINT`` rounds: a round costs one tree, and after a lost
executor a few trees are applied again to a stored block.

Every tree is shrunk by the learning rate, starting from the mean of the
training labels.  The loss of held-back rows is known after each tree; training
ends when the best lies ``early_stopping_rounds`` back.  Rows of a tree are drawn
(of ``n`` equal ones a binomial number) by block and round, so a recomputed block
draws the same ones.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlag.session import cut_lineage, ensure_checkpoint_dir, ship_package

#: Bins per feature; splits lie between them.
BINS = 64
#: Relative rank error of the bins' borders.
RANK_ERROR = 0.001
#: Rows of a stored block.
BLOCK = 1 << 16
#: Rows binned before equal ones are counted in a task.
RUN_ROWS = 1 << 18
#: Rows for which a task is worth its start, and most rows of a task.
TASK_ROWS, MOST_TASK_ROWS = 6_000, 1 << 20
CHECKPOINT = 25
#: L2 penalty on leaf weights and least hessian sum of a child.
PENALTY, LEAST_HESSIAN = 1.0, 1.0


class Tree:
    """Nodes in arrays; ``feature`` -1 marks a leaf.  Rows with a bin up to
    ``bin`` (a value up to ``border``) go left."""

    FIELDS = ("feature", "bin", "border", "left", "right", "value", "gain", "cover")

    def __init__(self):
        self.nodes: list[list] = []

    def add(self, value: float, cover: float) -> int:
        self.nodes.append([-1, 0, 0.0, -1, -1, value, 0.0, cover])
        return len(self.nodes) - 1

    def split(self, node: int, feature: int, at: int, border: float, left: int, right: int, gain: float) -> None:
        self.nodes[node][:5] = [feature, at, border, left, right]
        self.nodes[node][6] = gain

    def arrays(self) -> dict[str, np.ndarray]:
        kinds = (np.int64, np.int64, float, np.int64, np.int64, float, float, float)
        return {f: np.array(x, k) for f, x, k in zip(self.FIELDS, zip(*self.nodes, strict=True), kinds, strict=True)}


def walk(tree: dict[str, np.ndarray], values: np.ndarray, by: str) -> np.ndarray:
    """The leaf of every row of ``values`` [row, feature]; ``by``: ``bin`` or ``border``."""
    node, rows = np.zeros(len(values), np.int64), np.arange(len(values))
    while len(rows):
        at = node[rows]
        inner = tree["feature"][at] >= 0
        rows, at = rows[inner], at[inner]
        left = values[rows, tree["feature"][at]] <= tree[by][at]
        node[rows] = np.where(left, tree["left"][at], tree["right"][at])
    return node


def best_splits(sums: np.ndarray):
    """For histograms [node, feature, bin, (gradient, hessian)]: per node the
    best gain, its place in ``features`` and its bin; ties go to the first
    feature and the lowest bin."""
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    total = sums.sum(axis=2)[:, :, None]
    right = total - left
    score = lambda x: x[..., 0] ** 2 / (x[..., 1] + PENALTY)
    gain = 0.5 * (score(left) + score(right) - score(total))
    gain = np.where((left[..., 1] >= LEAST_HESSIAN) & (right[..., 1] >= LEAST_HESSIAN), gain, -np.inf)
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    return flat[np.arange(len(flat)), best], best // gain.shape[2], best % gain.shape[2]


def drawn_of(seed: int, count: np.ndarray, turn: int, share: float) -> np.ndarray:
    """How many of the ``count`` equal rows behind each row of a block are drawn in a round."""
    rng = np.random.default_rng([seed, turn])
    drawn, many = (rng.random(len(count)) < share).astype(float), np.flatnonzero(count > 1)
    drawn[many] = rng.binomial(count[many], share)
    return drawn


class Block:
    """Rows of one block, sorted by their bins.  Rows of equal bins have one
    score: gradients are linear in the label, so their sums need no more than
    the sums of drawn weights and of weighted labels."""

    def __init__(self, row, n_features: int, base: float):
        bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, n_features)
        self.y, self.w, self.count = np.frombuffer(row["y"]), np.frombuffer(row["w"]), np.frombuffer(row["n"], np.int64)
        self.held, self.seed = np.frombuffer(row["held"], bool), int(np.frombuffer(row["keys"], np.uint64)[0])
        new = np.concatenate(([True], (bins[1:] != bins[:-1]).any(axis=1)))
        self.starts, self.bins = np.flatnonzero(new), bins[new]
        self.score = np.full(len(self.starts), base)

    def plus(self, tree: dict) -> Block:
        out = object.__new__(Block)
        out.__dict__.update(self.__dict__)
        out.score = self.score + tree["value"][walk(tree, self.bins, "bin")]
        return out

    def gradients(self, task: str, turn: int, share: float):
        """Gradient and hessian sums of the drawn rows by bins, and the number of rows drawn."""
        drawn = np.where(self.held, 0.0, drawn_of(self.seed, self.count, turn, share))
        n, w, wy = (np.add.reduceat(x, self.starts) for x in (drawn, drawn * self.w, drawn * self.w * self.y))
        if task == "regression":
            return w * self.score - wy, w, n
        p = 1 / (1 + np.exp(-self.score))
        return w * p - wy, w * p * (1 - p), n

    def loss(self, task: str, metric: str) -> tuple[float, int]:
        """Sum of the held-back rows' losses, and their number."""
        sizes = np.diff(np.concatenate((self.starts, [len(self.y)])))
        y, s, n = self.y[self.held], np.repeat(self.score, sizes)[self.held], self.count[self.held]
        if task != "regression":
            return float(n @ np.logaddexp(0, np.where(y > 0, -s, s))), int(n.sum())
        return float(n @ (np.abs(s - y) if metric == "mae" else (s - y) ** 2)), int(n.sum())


def _histogram(task: str, metric: str, turn: int, share: float, features: list[int], tree: dict | None, slots: np.ndarray):
    """Sums of a task's blocks for the open nodes (``slots``: number by node, or -1)."""
    def run(blocks):
        n = int(slots.max()) + 1
        sums, loss = np.zeros((n, len(features), BINS, 2)), np.zeros(2)
        for b in blocks:
            if tree is None:  # asked for once a round
                loss += b.loss(task, metric)
            node = np.zeros(len(b.bins), np.int64) if tree is None else walk(tree, b.bins, "bin")
            *both, drawn = b.gradients(task, turn, share)
            slot = np.where(drawn == 0, -1, slots[node])
            rows = np.flatnonzero(slot >= 0)
            g, h = (x[rows] for x in both)
            for k, f in enumerate(features):
                at = slot[rows] * BINS + b.bins[rows, f]
                for c, x in enumerate((g, h)):
                    sums[:, k, :, c] += np.bincount(at, x, n * BINS).reshape(n, BINS)
        yield sums, loss
    return run


def _add(a, b):
    return a[0] + b[0], a[1] + b[1]


def _borders(df: DataFrame, n_features: int) -> list[np.ndarray]:
    """Ascending upper borders of the bins of each feature, but the last; the
    first bin is that of missing values."""
    cols = df.select(*[F.col("x")[i].alias(f"x{i}") for i in range(n_features)])
    probabilities = [k / (BINS - 1) for k in range(1, BINS - 1)]
    found = cols.approxQuantile([f"x{i}" for i in range(n_features)], probabilities, RANK_ERROR)
    return [np.unique(np.array([-np.inf, *q])) for q in found]


def _binned(borders: list[np.ndarray]):
    """(x, label, weight, held) to the distinct rows of a run: bins, label, weight, held, n."""
    def run(batches):
        held, size = [], 0

        def flush():
            rows = np.concatenate(held)
            rows, n = np.unique(rows.view(f"V{rows.shape[1]}")[:, 0], return_counts=True)
            rows = rows.view(np.uint8).reshape(len(n), -1)
            k = len(borders)
            y, w = (np.ascontiguousarray(rows[:, lo:lo + 8]).view(float)[:, 0] for lo in (k, k + 8))
            return pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in rows[:, :k]], pa.binary()), pa.array(y), pa.array(w), pa.array(rows[:, -1] > 0), pa.array(n)],
                ["bins", "y", "w", "held", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, len(borders))
            x = np.where(np.isnan(x), -np.inf, x)
            bins = np.stack([np.searchsorted(b, x[:, i]) for i, b in enumerate(borders)], axis=1).astype(np.uint8)
            y, w, used = (batch.column(k).to_numpy(zero_copy_only=False).astype(t) for k, t in ((1, float), (2, float), (3, np.uint8)))
            held.append(np.concatenate([bins, y.view(np.uint8).reshape(-1, 8), w.view(np.uint8).reshape(-1, 8), used[:, None]], axis=1))
            size += len(y)
            if size >= RUN_ROWS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
    return run


def distinct_rows(df: DataFrame, borders: list[np.ndarray], seed: int) -> DataFrame:
    """``bins, y, w, held, n, key`` (stored): a row for all of equal bins, label, weight and use."""
    some = df.select("x", "label", "weight", "held").mapInArrow(_binned(borders), "bins binary, y double, w double, held boolean, n long")
    rows = some.groupBy("bins", "y", "w", "held").agg(F.sum("n").alias("n"))
    return cut_lineage(rows.withColumn("key", F.xxhash64(F.lit(seed), "bins", "y", "w", "held")), "binned-rows")


def _pack(batches):
    """Rows to blocks of at most ``BLOCK`` rows."""
    held, size = [], 0

    def flush(some):
        t = pa.Table.from_batches(some).combine_chunks()
        arrays = [t.column(k).to_numpy() for k in ("y", "w", "held", "n", "key")]
        parts = [b"".join(t.column("bins").to_pylist()), *[np.ascontiguousarray(x).tobytes() for x in arrays]]
        return pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in parts], ["bins", "y", "w", "held", "n", "keys"])

    for batch in batches:
        while size + batch.num_rows > BLOCK:
            take = BLOCK - size
            yield flush([*held, batch.slice(0, take)])
            batch, held, size = batch.slice(take), [], 0
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
    if held:
        yield flush(held)


def blocks(rows: DataFrame, tasks: int) -> DataFrame:
    """``bins, y, w, held, n, keys`` of blocks of distinct rows, stored."""
    dealt = rows.repartition(tasks, "bins").sortWithinPartitions("bins", "key")
    return cut_lineage(dealt.mapInArrow(
        _pack, "bins binary, y binary, w binary, held binary, n binary, keys binary"), "tree-blocks")


class BoostedTrees:
    """Fitted trees: ``transform`` adds ``prediction`` and, for two classes,
    ``p1``; ``best_iteration`` (from 0), ``best_score`` (held-back loss) and
    ``rounds`` (trees grown) tell how training ended, ``losses`` all held-back losses."""

    def __init__(self, task: str, base: float, n_features: int, trees: list[dict], losses: list[float], best: int):
        self.task, self.base, self.n_features = task, base, n_features
        self.rounds, self.losses, self.trees = len(trees), losses, trees[:best + 1]
        self.best_iteration, self.best_score = best, (losses[best] if losses else None)

    def scores(self, values: np.ndarray) -> np.ndarray:
        values = np.where(np.isnan(values), -np.inf, values)
        out = np.full(len(values), self.base)
        for tree in self.trees:
            out += tree["value"][walk(tree, values, "border")]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        ship_package(spark)
        shared, classes = spark.sparkContext.broadcast(self), self.task != "regression"

        def score(features):
            for x in features:
                s = shared.value.scores(np.stack(x.to_numpy()).astype(float)) if len(x) else np.empty(0)
                yield pd.Series(1 / (1 + np.exp(-s)) if classes else s)

        from collections.abc import Iterator
        score.__annotations__ = {"features": Iterator[pd.Series], "return": Iterator[pd.Series]}
        scored = F.pandas_udf(score, "double")(vector_to_array("features"))
        if not classes:
            return df.withColumn("prediction", scored)
        return df.withColumn("p1", scored).withColumn("prediction", (F.col("p1") > 0.5).cast("double"))

    @property
    def featureImportances(self):  # noqa: N802  (the name that Spark's models have)
        """Gain by feature, with a sum of 1."""
        from pyspark.ml.linalg import Vectors
        gain = np.zeros(self.n_features)
        for tree in self.trees:
            inner = tree["feature"] >= 0
            np.add.at(gain, tree["feature"][inner], tree["gain"][inner])
        return Vectors.dense(gain / (gain.sum() or 1))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """A row per node: ``tree, node`` and the fields of ``Tree``."""
        rows = [(t, i, *[x[i].item() for x in tree.values()]) for t, tree in enumerate(self.trees) for i in range(len(tree["feature"]))]
        return spark.createDataFrame(rows, "tree int, node int, feature int, bin int, border double, left int, right int, "
                                           "value double, gain double, cover double")

    def save(self, path: str) -> None:
        """The node table and, beside it, what else the model has."""
        spark = SparkSession.getActiveSession()
        self.nodes(spark).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.task, self.base, self.n_features, self.losses, self.best_iteration, self.rounds)],
                              "task string, base double, n_features int, losses array<double>, best int, rounds int") \
            .write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, path: str) -> BoostedTrees:
        spark = SparkSession.getActiveSession()
        head, frame = spark.read.parquet(f"{path}/model").first(), spark.read.parquet(f"{path}/nodes").toPandas()
        trees = [{f: t[f].to_numpy() for f in Tree.FIELDS} for _, t in frame.sort_values(["tree", "node"]).groupby("tree")]
        out = cls(head["task"], head["base"], head["n_features"], trees, list(head["losses"]), head["best"])
        out.rounds = head["rounds"]
        return out


def fit_boosted(df: DataFrame, task: str, config: dict, validation_col: str | None = None, seed: int = 42) -> BoostedTrees:
    """Boosted trees on ``features`` (vector), ``label`` and, if there, ``weight``."""
    spark = df.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    held = F.coalesce(F.col(validation_col), F.lit(False)) if validation_col else F.lit(False)
    x = vector_to_array("features")
    slim = df.select(x.alias("x"), F.col("label").cast("double").alias("label"),
                     (F.col("weight") if "weight" in df.columns else F.lit(1.0)).cast("double").alias("weight"),
                     held.alias("held"))
    train = slim.where(~F.col("held"))
    n, n_features, mean = train.agg(
        F.count(F.lit(1)), F.max(F.size("x")), F.sum(F.col("label") * F.col("weight")) / F.sum("weight")).first()
    if not n:
        raise ValueError("no rows to train on")
    base = mean if task == "regression" else math.log(min(max(mean, 1e-6), 1 - 1e-6) / (1 - min(max(mean, 1e-6), 1 - 1e-6)))
    borders = _borders(train, n_features)
    distinct = distinct_rows(slim, borders, seed)
    rows = distinct.count()
    tasks = max(1, min(spark.sparkContext.defaultParallelism, rows // TASK_ROWS), -(-rows // MOST_TASK_ROWS))
    state = blocks(distinct, tasks).rdd.map(lambda r: Block(r, n_features, base)).persist(StorageLevel.MEMORY_AND_DISK)
    metric, rate, depth = config.get("eval_metric"), float(config["learning_rate"]), int(config["max_depth"])
    most, patience = int(config["n_estimators"]), int(config.get("early_stopping_rounds") or 0)
    share, columns = float(config["subsample"]), max(1, round(float(config["colsample_bytree"]) * n_features))
    rng, trees, losses, older = np.random.default_rng(seed), [], [], None

    def summed(turn, features, tree, slots):
        parts = state.mapPartitions(_histogram(task, metric, turn, share, features, tree, slots))
        return parts.treeReduce(_add) if parts.getNumPartitions() > 16 else parts.reduce(_add)

    def after(loss) -> bool:
        """Note the loss after the last tree; whether training goes on."""
        if trees and loss[1]:
            losses.append(float(loss[0] / loss[1]) if task != "regression" or metric == "mae" else math.sqrt(loss[0] / loss[1]))
            return not patience or len(losses) - 1 - int(np.argmin(losses)) < patience
        return True

    for turn in range(most + 1):
        features = sorted(rng.choice(n_features, columns, replace=False).tolist())
        tree, open_nodes, arrays = Tree(), [0], None
        for level in range(depth):
            slots = np.full(max(len(tree.nodes), 1), -1)
            slots[open_nodes] = np.arange(len(open_nodes))
            sums, loss = summed(turn, features, arrays, slots)
            if level == 0:
                if older is not None:
                    older.unpersist()
                go_on = after(loss)
                if not go_on or turn == most:
                    break
                total = sums[0, 0].sum(axis=0)
                tree.add(-total[0] / (total[1] + PENALTY) * rate, float(total[1]))
            gain, place, at = best_splits(sums)
            grown = []
            for k, node in enumerate(open_nodes):
                f = features[place[k]]
                if not gain[k] > 1e-9 or at[k] >= len(borders[f]):
                    continue
                left = sums[k, place[k], :at[k] + 1].sum(axis=0)
                right = sums[k, place[k]].sum(axis=0) - left
                children = [tree.add(-s[0] / (s[1] + PENALTY) * rate, float(s[1])) for s in (left, right)]
                tree.split(node, f, int(at[k]), float(borders[f][at[k]]), *children, float(gain[k]))
                grown += children
            arrays, open_nodes = tree.arrays(), grown
            if not grown:
                break
        if not tree.nodes:
            break
        trees.append(arrays)
        older, state = state, state.map(lambda b, t=arrays: b.plus(t)).persist(StorageLevel.MEMORY_AND_DISK)
        if len(trees) % CHECKPOINT == 0:
            state.checkpoint()
    state.unpersist()
    best = int(np.argmin(losses)) if losses else len(trees) - 1
    return BoostedTrees(task, base, n_features, trees, losses, best)
