"""SMOTE over-sampling of the minority class, distributed.

For every synthetic row: a minority row x (chosen in proportion to how often
its feature vector occurs), one of its k nearest minority neighbours n, and a
gap g in [0, 1): x + g * (n - x).  Choices are hashes of (point, index), so
the output does not depend on partitioning.

Neighbour search, by one rule at every size and never over all pairs of points:

* identical minority vectors collapse into one point with a multiplicity m
  (a vector's own copies are its nearest neighbours at distance 0);
* distinct points are cut into cells of about ``block``, by quantiles along
  the ``LEVELS`` features of largest variance one after the other; a point's
  k-th distance in its own cell bounds how far its neighbours can be;
* a pair of cells is compared only if their bounding boxes are no further apart
  than the largest such bound in the first, and in it only the points whose own
  bound reaches the second's box.  Such pairs are found in a tree of boxes, from
  the root down (``near_cells``).  No point outside those boxes can be nearer,
  so the k nearest are exact at every size; ties go to the smaller ``_pid``.
* a point's quota of synthetic rows needs its multiplicity only and is computed
  beside the search; rows are generated per point with the chunked expansion of
  ``ranking.expand_copies``, the neighbours travelling as an array.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlag.functions.hashing import hash32
from airlag.operators.ordering import cumulative_sums
from airlag.operators.ranking import expand_copies
from airlag.session import cut_lineage, ship_package

LEVELS = 3
#: Children of a node in the tree of boxes.
FAN = 16
#: Bounds are widened by this share, so that rounding cannot part equal distances.
SLACK = 1 + 1e-9
#: Pairs of cells a task compares, about; their members reach Python together.
TASK_PAIRS = 512
_NEAR = "array<struct<_d: double, _qid: string, _qx: array<double>>>"


def _members(m):
    """A list of member structs, by id: ids, vectors and the struct array."""
    v = m.values
    v = v.take(pa.compute.sort_indices(v.field("_pid")))
    return v.field("_pid").to_pylist(), np.asarray(v.field("_x").flatten(), float).reshape(len(v), -1), v


def _closest(d, need, bound, ids, x):
    """The ``need`` smallest of ``d`` that are within ``bound``; ``ids`` are sorted, so ties go by id."""
    near = np.flatnonzero(d <= bound)
    near = near[np.argsort(d[near], kind="stable")[:need]]
    return [{"_d": float(d[j]), "_qid": ids[j], "_qx": x[j].tolist()} for j in near]


def _near_rows(rows):
    kinds = {"_pid": pa.string(), "_r": pa.float64(),
             "_nn": pa.list_(pa.struct([("_d", pa.float64()), ("_qid", pa.string()), ("_qx", pa.list_(pa.float64()))]))}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))


def _within(batches):
    """Members of a cell -> per point the nearest there, and the squared distance
    within which all it needs are (infinite if the cell has too few)."""
    for batch in batches:
        for members in batch.column(0):
            ids, x, v = _members(members)
            rows = []
            for i, need in enumerate(v.field("_need").to_pylist()):
                if need == 0:
                    rows.append((ids[i], -1.0, []))
                    continue
                d = ((x - x[i]) ** 2).sum(1)
                d[i] = np.inf
                r = float(np.partition(d, need - 1)[need - 1]) if need <= len(d) else math.inf
                rows.append((ids[i], r, _closest(d, need, min(r, np.finfo(float).max), ids, x)))
            yield _near_rows(rows)


def _across(batches):
    """Members of a cell and of another -> what the first's points find in the other within their bounds."""
    for batch in batches:
        for own, other in zip(batch.column(0), batch.column(1)):
            ids, x, v = _members(own)
            oids, ox, _ = _members(other)
            need, r = v.field("_need").to_pylist(), v.field("_r").to_numpy()
            gap = np.maximum(np.maximum(ox.min(0) - x, x - ox.max(0)), 0)
            rows = []
            for i in np.flatnonzero((gap ** 2).sum(1) <= r * SLACK):
                near = _closest(((ox - x[i]) ** 2).sum(1), need[i], min(r[i], np.finfo(float).max), oids, ox)
                if near:
                    rows.append((ids[i], float(r[i]), near))
            yield _near_rows(rows)


def _cells(p: DataFrame, d: int, block: int) -> tuple[DataFrame, int]:
    """Adds ``_path``, the cell: places along the features of largest variance,
    one inside the other, ``parts`` (the second value) of each."""
    stats = p.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(F.col("_x")[i]).alias(f"v{i}") for i in range(d)]).first()
    parts = math.ceil(math.ceil(max(stats["n"], 1) / block) ** (1 / min(LEVELS, d)) - 1e-9)
    axes = sorted(range(d), key=lambda i: (-(stats[f"v{i}"] or 0.0), i))[:LEVELS]
    # equal values are dealt by a hash, so that a frequent one does not make a large cell
    lead = p.select(F.col("_x")[axes[0]].alias("_v")).groupBy("_v").agg(F.count(F.lit(1)).alias("_c"))
    ends = cumulative_sums(lead, "_v", ["_c"]).select("_v", (F.col("cum__c") - F.col("_c")).alias("_before"), "_c")
    unit = F.pmod(hash32("_pid", 1), F.lit(1 << 20)) / F.lit(1 << 20)
    out = p.withColumn("_v", F.col("_x")[axes[0]]).join(ends, "_v").withColumn(
        "_c0", F.floor((F.col("_before") + F.col("_c") * unit) * parts / F.lit(max(stats["n"], 1)))).drop("_v", "_before", "_c")
    cell = ["_c0"]
    for level, axis in enumerate(axes[1:], 1):
        v = F.col("_x")[axis]
        shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
        # borders from a mergeable sketch per outer cell: no cell of a level is sorted in one task
        cuts = cut_lineage(out.groupBy(*cell).agg(F.percentile_approx(v, shares, 10_000).alias("_cuts")), "cuts") \
            if parts > 1 else out.groupBy(*cell).agg(F.array().cast("array<double>").alias("_cuts"))
        below, upto = F.size(F.filter("_cuts", lambda q: q < v)), F.size(F.filter("_cuts", lambda q: q <= v))  # noqa: B023
        unit = F.pmod(hash32("_pid", level + 1), F.lit(1 << 20)) / F.lit(1 << 20)
        out = out.join(cuts, cell).withColumn(f"_c{level}", below + F.floor(unit * (upto - below + 1))).drop("_cuts")
        cell.append(f"_c{level}")
    return out.withColumn("_path", F.array(*[F.col(c).cast("long") for c in cell], *[F.lit(0).cast("long")] * (LEVELS - len(cell)))).drop(*cell), parts


def near_cells(cells: DataFrame, parts: int, n_dim: int) -> DataFrame:
    """Pairs (``_a``, ``_b``) of different cells, the box of the second no further
    from that of the first than its ``_reach`` (squared; negative: nothing is asked).

    The cells are the leaves of a tree of boxes with at most ``FAN`` children a
    node: their paths, cut off after fewer and fewer digits.  Pairs go down from
    the root level by level, a pair's children meeting through it, so that what
    is too far apart falls out with all that is below."""
    axis = lambda name, i: F.col(name)[i]
    steps, shift = [], 1
    while shift < parts:
        steps.append(shift)
        shift *= FAN
    ladder = [(level, q) for level in range(LEVELS) for q in reversed(steps or [1])]

    def key(level: int, q: int):
        digits = [F.col("_path")[i] for i in range(level)] + [F.floor(F.col("_path")[level] / q)]
        return F.concat_ws(":", *digits, F.lit(f"{level}/{q}"))

    boxes = cells.select("_path", "_reach", "_lo", "_hi")
    pairs = cells.sparkSession.createDataFrame([("", "")], "_a string, _b string")
    parent = F.lit("")
    for level, q in ladder:
        nodes = boxes.groupBy(parent.alias("_up"), key(level, q).alias("_node")).agg(
            F.max("_reach").alias("_reach"), F.array(*[F.min(axis("_lo", i)) for i in range(n_dim)]).alias("_lo"),
            F.array(*[F.max(axis("_hi", i)) for i in range(n_dim)]).alias("_hi"))
        parent = key(level, q)
        a = nodes.where("_reach >= 0").select(F.col("_up").alias("_a"), F.col("_node").alias("_an"), "_reach",
                                              F.col("_lo").alias("_alo"), F.col("_hi").alias("_ahi"))
        b = nodes.select(F.col("_up").alias("_b"), F.col("_node").alias("_bn"), "_lo", "_hi")
        apart = sum((F.pow(F.greatest(axis("_lo", i) - axis("_ahi", i), axis("_alo", i) - axis("_hi", i), F.lit(0.0)), F.lit(2.0))
                     for i in range(n_dim)), F.lit(0.0))
        pairs = cut_lineage(pairs.join(a, "_a").join(b, "_b").where(apart <= F.col("_reach") * SLACK)
                            .select(F.col("_an").alias("_a"), F.col("_bn").alias("_b")), "pairs")
    return pairs.where("_a <> _b")


def leaf_key():
    """The key that ``near_cells`` gives a cell."""
    return F.concat_ws(":", *[F.col("_path")[i] for i in range(LEVELS)], F.lit(f"{LEVELS - 1}/1"))


def minority_neighbours(points: DataFrame, features: list[str], k: int = 5, block: int = 256,
                        seed: int = 42) -> DataFrame:
    """``points``: distinct vectors with ``_pid`` and multiplicity ``_m``.
    Returns (_pid, _x, _m, nbrs: array<array<double>>) with the k nearest
    neighbour vectors; a vector with a null or non-finite component is nobody's
    neighbour and has its own copies only."""
    ship_package(points.sparkSession)
    n_dim = len(features)
    vec = F.array(*[F.col(c).cast("double") for c in features])
    p = points.select(F.col("_pid").cast("string").alias("_pid"), vec.alias("_x"), "_m")
    whole = p.where(F.forall("_x", lambda v: F.coalesce(F.abs(v) < F.lit(math.inf), F.lit(False)))).select(
        "_pid", "_x", (k - F.least(F.col("_m") - 1, F.lit(k))).cast("int").alias("_need"))
    placed, parts = _cells(whole, n_dim, block)
    placed = cut_lineage(placed.withColumn("_cell", leaf_key()), "cells")
    here = placed.groupBy("_cell").agg(F.collect_list(F.struct("_pid", "_x", "_need")).alias("members"))
    first = cut_lineage(here.select("members").mapInArrow(_within, f"_pid string, _r double, _nn {_NEAR}"), "within")
    cells = cut_lineage(placed.join(first.select("_pid", "_r"), "_pid").groupBy("_cell").agg(
        F.first("_path").alias("_path"), F.max("_r").alias("_reach"), F.array(*[F.min(F.col("_x")[i]) for i in range(n_dim)]).alias("_lo"),
        F.array(*[F.max(F.col("_x")[i]) for i in range(n_dim)]).alias("_hi"),
        F.collect_list(F.struct("_pid", "_x", "_need", "_r")).alias("members")), "boxes")
    pairs = near_cells(cells, parts, n_dim)
    tasks = 1 + pairs.count() // TASK_PAIRS
    both = cells.select(F.col("_cell").alias("_a"), F.col("members").alias("own")).repartition(tasks, "_a").join(
        pairs.join(cells.select(F.col("_cell").alias("_b"), F.col("members").alias("other")), "_b").repartition(tasks, "_a"), "_a")
    more = both.select("own", "other").mapInArrow(_across, f"_pid string, _r double, _nn {_NEAR}")
    nearest = first.unionByName(more).groupBy("_pid").agg(
        F.slice(F.array_sort(F.flatten(F.collect_list("_nn"))), 1, k).alias("_nn"))
    # own copies first (distance 0), then the nearest other points, k in all
    return p.join(nearest, "_pid", "left").select(
        "_pid", "_x", "_m",
        F.slice(F.concat(F.array_repeat(F.col("_x"), F.least(F.col("_m") - 1, F.lit(k)).cast("int")),
                         F.coalesce(F.transform("_nn", lambda s: s["_qx"]),
                                    F.array().cast("array<array<double>>"))), 1, k).alias("nbrs"))


def smote_oversample(df: DataFrame, label: str, features: list[str], key_col: str = "row_key",
                     k: int = 5, block: int = 256, seed: int = 42) -> DataFrame:
    """Original rows plus synthetic minority rows up to the majority size;
    ``synthetic`` flags the new rows."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).take(3)}
    if len(counts) != 2:
        raise ValueError("SMOTE needs exactly two classes")
    minority = min(counts, key=lambda c: (counts[c], c))
    n_min, n_maj = counts[minority], max(counts.values())
    n_new = n_maj - n_min
    base = df.withColumn("synthetic", F.lit(False))
    if n_new == 0:
        return base
    pts = cut_lineage(df.where(F.col(label) == minority)
                      .groupBy(*features).agg(F.count(F.lit(1)).alias("_m"), F.min(key_col).cast("string").alias("_pid")), "points")
    # synthetic count per point, proportional to its multiplicity (exact total)
    cm = cumulative_sums(pts.select("_pid", "_m", hash32("_pid", seed).alias("_h")), "_h", ["_m"])
    alloc = cm.select("_pid", (F.floor(F.col("cum__m") * n_new / n_min)
                               - F.floor((F.col("cum__m") - F.col("_m")) * n_new / n_min)).cast("long").alias("_s"))
    nb = minority_neighbours(pts, features, k, block, seed).drop("_m")
    gen = cut_lineage(nb.join(alloc.where("_s > 0"), "_pid").select(
        "_pid", "_x", "nbrs", F.col("_s").alias("_m"), F.lit(0).cast("long").alias("_start")), "quotas")
    rows = expand_copies(gen)  # one row per synthetic sample, _rank = 0.._s-1
    tag = F.concat_ws(":", F.col("_pid"), F.col("_rank").cast("string"))
    idx = (F.pmod(hash32(tag, seed + 1), F.size("nbrs")) + 1).cast("int")
    gap = hash32(tag, seed + 2).cast("double") / F.lit(4294967296.0)
    nn = F.element_at("nbrs", idx)
    new_x = F.zip_with("_x", nn, lambda a, b: a + gap * (b - a))
    syn = rows.select(F.concat(F.lit("smote:"), tag).alias(key_col), new_x.alias("_new"))
    syn = syn.select(key_col, *[F.col("_new")[i].alias(c) for i, c in enumerate(features)])
    syn = syn.withColumn(label, F.lit(minority)).withColumn("synthetic", F.lit(True))
    return base.unionByName(syn, allowMissingColumns=True)
