"""Random forests on histograms, all trees of a group one level at a time.

Features are binned once, and rows of equal bins, label and weight become one
with a count (``boosting.distinct_rows``): a tree sees no more of a row.  The
bootstrap is that of Spark's forests, a Poisson number of each row per tree;
of ``n`` equal rows together a Poisson number of mean ``n`` is drawn, by block
and tree, so every level and every recomputed task draws the same.

A level is one query: the tasks add up drawn rows, labels and squares (two
classes: weights) by tree, open node, feature and bin, the rest is a shuffle by
node, a running sum over the bins and the best split of each node.  Only splits
reach the driver.  Nothing is kept per row and tree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlag.plans import boosting as BT
from airlag.session import ensure_checkpoint_dir, ship_package

#: Trees grown in the same queries.
GROUP = 50
#: Distinct rows that a scoring task remembers the score of.
REMEMBERED = 1 << 20
KINDS = {"feature": np.int16, "bin": np.int16, "left": np.int32, "border": float, "value": float, "gain": float, "cover": float}


def walk(tree: dict[str, np.ndarray], values: np.ndarray, by: str) -> np.ndarray:
    """The node every row of ``values`` [row, feature] ends in; ``by``: ``bin``
    or ``border``.  The right child follows the left one."""
    node, rows = np.zeros(len(values), np.int64), np.arange(len(values))
    while len(rows):
        at = node[rows]
        inner = tree["feature"][at] >= 0
        rows, at = rows[inner], at[inner]
        node[rows] = tree["left"][at] + (values[rows, tree["feature"][at]] > tree[by][at])
    return node


class Growing:
    """A tree that grows by levels; the nodes of the last level stand from ``first`` on."""

    def __init__(self, number: int):
        self.number, self.first, self.nodes = number, 0, {f: np.empty(0, k) for f, k in KINDS.items()}
        self.open = np.zeros(0, bool)

    def add(self, n: np.ndarray, a: np.ndarray, q: np.ndarray, task: str, least: int) -> None:
        """Nodes of a new level by their sums; those with too few rows or equal labels stay closed."""
        self.first = len(self.nodes["feature"])
        total = n if task == "regression" else q
        new = {"feature": np.full(len(n), -1), "bin": np.zeros(len(n)), "left": np.zeros(len(n)), "border": np.zeros(len(n)),
               "value": np.divide(a, total, out=np.zeros(len(n)), where=total > 0), "gain": np.zeros(len(n)), "cover": n}
        self.nodes = {f: np.concatenate([x, new[f].astype(KINDS[f])]) for f, x in self.nodes.items()}
        mixed = (q * n - a * a > 1e-9 * q * n) if task == "regression" else (a > 0) & (a < q)
        self.open = (n >= 2 * least) & mixed

    def split(self, found: pd.DataFrame, borders: list[np.ndarray], task: str, least: int) -> None:
        """Split nodes of the last level as found; their children are the new level."""
        at, f, b = (found[c].to_numpy(np.int64) for c in ("node", "feature", "bin"))
        self.nodes["feature"][at], self.nodes["bin"][at], self.nodes["gain"][at] = f, b, found["gain"]
        self.nodes["border"][at] = [borders[x][y] for x, y in zip(f.tolist(), b.tolist(), strict=True)]
        self.nodes["left"][at] = len(self.nodes["feature"]) + 2 * np.arange(len(at))
        self.add(*(found[[f"l{c}", f"r{c}"]].to_numpy(float).ravel() for c in "naq"), task, least)


def _level_sums(shared, n_features: int, task: str, seed: int):
    """(tree, node, feature, bin) and the sums of a block's drawn rows there, of open nodes and their features."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = BT.Block(row, n_features, 0.0)
                for number, nodes, first, is_open, chosen in shared.value:
                    drawn = np.random.default_rng([seed, number, block.seed]).poisson(block.count).astype(float)
                    a = drawn * block.w * block.y
                    q = a * block.y if task == "regression" else drawn * block.w
                    n, a, q = (np.add.reduceat(x, block.starts) for x in (drawn, a, q))
                    slot = walk(nodes, block.bins, "bin") - first
                    rows = np.flatnonzero((n > 0) & (slot >= 0))
                    rows = rows[is_open[slot[rows]]]
                    if not len(rows):
                        continue
                    f = chosen[slot[rows]]
                    key = ((slot[rows][:, None] * n_features + f) * BT.BINS + block.bins[rows[:, None], f]).ravel()
                    key, place = np.unique(key, return_inverse=True)
                    sums = [np.bincount(place, np.repeat(x[rows], f.shape[1]), len(key)) for x in (n, a, q)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), number, np.int32)), pa.array(key // BT.BINS // n_features + first),
                         pa.array((key // BT.BINS % n_features).astype(np.int32)), pa.array((key % BT.BINS).astype(np.int32)),
                         *map(pa.array, sums)], ["tree", "node", "feature", "bin", "n", "a", "q"])
    return run


def _best_splits(sums: DataFrame, task: str, least: int) -> DataFrame:
    """``tree, node``, the split of most gain (ties: first feature, lowest bin) and the sums on both sides."""
    keys = ["tree", "node", "feature"]
    every = Window.partitionBy(*keys)
    upto = every.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = sums.repartition("tree", "node").groupBy(*keys, "bin").agg(*[F.sum(c).alias(c) for c in "naq"])
    sides = bins.select(*keys, "bin", *[F.sum(c).over(upto).alias(f"l{c}") for c in "naq"],
                        *[F.sum(c).over(every).alias(c) for c in "naq"])
    sides = sides.withColumns({f"r{c}": F.col(c) - F.col(f"l{c}") for c in "naq"}).where(
        (F.col("ln") >= least) & (F.col("rn") >= least))

    def score(side: str):
        n, a, q = (F.col(side + c) for c in "naq")
        return F.try_divide(a * a, n) if task == "regression" else F.try_divide(a * a + (q - a) * (q - a), q)
    gains = sides.withColumn("gain", score("l") + score("r") - score("")).where(F.col("gain") > 1e-9 * F.abs(score("")))
    columns = ["feature", "bin", "gain", *[s + c for s in "lr" for c in "naq"]]
    best = gains.groupBy("tree", "node").agg(F.max_by(F.struct(*columns), F.struct(
        "gain", -F.col("feature"), -F.col("bin"))).alias("s"))
    return best.select("tree", "node", "s.*")


class Forest:
    """Fitted trees: ``transform`` adds ``prediction`` and, for two classes, ``p1``."""

    def __init__(self, task: str, n_features: int, trees: list[dict]):
        self.task, self.n_features, self.trees = task, n_features, trees

    def scores(self, values: np.ndarray) -> np.ndarray:
        values = np.where(np.isnan(values), -np.inf, values)
        out = np.zeros(len(values))
        for tree in self.trees:
            out += tree["value"][walk(tree, values, "border")]
        return out / len(self.trees)

    def transform(self, df: DataFrame) -> DataFrame:
        spark = df.sparkSession
        ship_package(spark)
        shared, classes = spark.sparkContext.broadcast(self), self.task != "regression"

        def score(features):
            known: dict[bytes, float] = {}
            for x in features:
                if not len(x):
                    yield pd.Series(np.empty(0))
                    continue
                values = np.stack(x.to_numpy()).astype(float)
                one, place = np.unique(values.view(f"V{values.itemsize * values.shape[1]}")[:, 0], return_inverse=True)
                keys = one.tolist()
                new = [i for i, k in enumerate(keys) if k not in known]
                if len(known) + len(new) > REMEMBERED:
                    known, new = {}, list(range(len(keys)))
                if new:  # equal rows have one score
                    fresh = shared.value.scores(one[new].view(float).reshape(len(new), -1))
                    known.update(zip([keys[i] for i in new], fresh.tolist(), strict=True))
                yield pd.Series(np.array([known[k] for k in keys])[place])

        from collections.abc import Iterator
        score.__annotations__ = {"features": Iterator[pd.Series], "return": Iterator[pd.Series]}
        scored = F.pandas_udf(score, "double")(vector_to_array("features"))
        if not classes:
            return df.withColumn("prediction", scored)
        return df.withColumn("p1", scored).withColumn("prediction", (F.col("p1") > 0.5).cast("double"))

    @property
    def featureImportances(self):  # noqa: N802  (the name that Spark's models have)
        """Gain by feature: every tree's sums to 1, and so does their mean."""
        from pyspark.ml.linalg import Vectors
        total = np.zeros(self.n_features)
        for tree in self.trees:
            inner = tree["feature"] >= 0
            gain = np.bincount(tree["feature"][inner], tree["gain"][inner], self.n_features)
            total += gain / (gain.sum() or 1)
        return Vectors.dense(total / (total.sum() or 1))

    def save(self, path: str) -> None:
        """A folder of node tables, written a few trees at a time, and the head beside it."""
        spark = SparkSession.getActiveSession()
        for k in range(0, len(self.trees), 10):
            frames = [pd.DataFrame({"tree": np.int32(t), "node": np.arange(len(tree["feature"])), **tree})
                      for t, tree in enumerate(self.trees[k:k + 10], k)]
            spark.createDataFrame(pa.Table.from_pandas(pd.concat(frames), preserve_index=False)) \
                .write.mode("overwrite" if k == 0 else "append").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.task, self.n_features)], "task string, n_features int").write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, path: str) -> Forest:
        spark = SparkSession.getActiveSession()
        head, frame = spark.read.parquet(f"{path}/model").first(), spark.read.parquet(f"{path}/nodes").toArrow().to_pandas()
        trees = [{f: t[f].to_numpy(k) for f, k in KINDS.items()} for _, t in frame.sort_values(["tree", "node"]).groupby("tree")]
        return cls(head["task"], head["n_features"], trees)


def fit_forest(df: DataFrame, task: str, n_trees: int, max_depth: int, min_leaf: int = 1, max_features: str = "all",
               seed: int = 42) -> Forest:
    """A forest on ``features`` (vector), ``label`` (two classes: 0 and 1) and,
    if there, ``weight``.  ``min_leaf`` counts drawn rows; ``max_features``
    (``sqrt`` or ``all``) are drawn for each node."""
    spark = df.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    if max_features not in ("sqrt", "all"):
        raise ValueError(f"unknown number of features {max_features!r}")
    slim = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"),
                     (F.col("weight") if "weight" in df.columns else F.lit(1.0)).cast("double").alias("weight"),
                     F.lit(False).alias("held"))
    n, n_features = slim.agg(F.count(F.lit(1)), F.max(F.size("x"))).first()
    if not n:
        raise ValueError("no rows to train on")
    borders = BT._borders(slim, n_features)
    distinct = BT.distinct_rows(slim, borders, seed)
    rows = distinct.count()
    tasks = max(1, min(spark.sparkContext.defaultParallelism, rows // BT.TASK_ROWS), -(-rows // BT.MOST_TASK_ROWS))
    blocks = BT.blocks(distinct, tasks)
    n_chosen = n_features if max_features == "all" else math.ceil(math.sqrt(n_features))
    trees = []
    for lo in range(0, n_trees, GROUP):
        trees += _grow(spark, blocks, range(lo, min(lo + GROUP, n_trees)), task, borders, n_chosen, max_depth, min_leaf, seed)
    return Forest(task, n_features, trees)


def _grow(spark, blocks: DataFrame, numbers: range, task: str, borders, n_chosen: int, max_depth: int, least: int, seed: int):
    n_features, trees = len(borders), [Growing(t) for t in numbers]
    for t in trees:  # a root is open until its sums are known
        t.add(np.array([2.0 * least]), np.array([1.0]), np.array([2.0]), "classification", least)
        t.open[:] = True
    if max_depth == 0:
        trees = _with_roots(spark, blocks, trees, task, seed, n_features)
    for level in range(max_depth):
        going = [t for t in trees if t.open.any()]
        if not going:
            break
        if level == 0:
            trees = going = _with_roots(spark, blocks, trees, task, seed, n_features)
        asked = []
        for t in going:
            draw = np.random.default_rng([seed, t.number, level]).random((len(t.open), n_features))
            asked.append((t.number, {f: t.nodes[f] for f in ("feature", "bin", "left")}, t.first, t.open,
                          np.sort(draw.argsort(axis=1)[:, :n_chosen], axis=1).astype(np.uint8)))
        shared = spark.sparkContext.broadcast(asked)
        sums = blocks.mapInArrow(_level_sums(shared, n_features, task, seed),
                                 "tree int, node long, feature int, bin int, n double, a double, q double")
        found = dict(iter(_best_splits(sums, task, least).toArrow().to_pandas().sort_values(["tree", "node"]).groupby("tree")))
        shared.destroy()
        for t in going:
            t.open = np.zeros(0, bool)
            if t.number in found:
                t.split(found[t.number], borders, task, least)
    return [t.nodes for t in trees]


def _with_roots(spark, blocks: DataFrame, trees: list[Growing], task: str, seed: int, n_features: int) -> list[Growing]:
    """The trees with the mean and number of all drawn rows at the root."""
    one = [(t.number, {f: t.nodes[f] for f in ("feature", "bin", "left")}, 0, np.ones(1, bool), np.zeros((1, 1), np.int64)) for t in trees]
    shared = spark.sparkContext.broadcast(one)
    sums = blocks.mapInArrow(_level_sums(shared, n_features, task, seed),
                             "tree int, node long, feature int, bin int, n double, a double, q double")
    totals = {r[0]: r[1:] for r in sums.groupBy("tree").agg(*[F.sum(c) for c in "naq"]).collect()}  # a row per tree
    shared.destroy()
    for t in trees:
        n, a, q = totals.get(t.number, (0.0, 0.0, 0.0))
        total = n if task == "regression" else q
        t.nodes["value"][0], t.nodes["cover"][0] = (a / total if total else 0.0), n
    return trees
