"""Exact top-k inner products, with bounds from segment statistics.

A vector is described at several resolutions by the mean and the deviation of
each of its segments.  Of two vectors the segment means and deviations give a
lower bound of their distance, and with their norms an upper bound of their
inner product.  Query blocks meet candidate blocks; from coarse to fine, pairs
whose bound is below the query's k-th best score so far are dropped, and exact
scores are computed for the survivors only.

Candidates are packed into blocks and dealt to groups, query blocks are sent to
every group by a shuffle, and the groups' best are merged: a block join of a
stated query set with all rows.  A group holds a few candidate blocks and passes
its query blocks through one at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlag.llm.common import read_table, scratch, ship_package

TOP = 5
SCALE = 256
#: Segments per vector, coarse to fine.
RESOLUTIONS = (1, 4, 16)
QUERY_BLOCK = 256
CANDIDATE_BLOCK = 2048
#: Candidate blocks of one group, on average.
GROUP_BLOCKS = 4
#: Sums of products below this are added in 64 bits; beyond it with whole numbers of any size.
NARROW = 1 << 62
#: Sums of whole numbers below this are exact in floats, in whatever order they are added.
FLOAT = 1 << 53
#: Where at least one pair in this many is left, all of a block are multiplied at once.
DENSE = 20


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row the segments' means and deviations, each times the root of the
    segment's length.  The inner product of two such rows is an upper bound of
    the vectors' inner product (and so bounds their distance from below)."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(np.int64)
    lengths = np.diff(edges).astype(float)
    sums = np.add.reduceat(x, edges[:-1], 1)
    squares = np.add.reduceat(x * x, edges[:-1], 1)
    return np.concatenate((sums / np.sqrt(lengths), np.sqrt(np.maximum(squares - sums * sums / lengths, 0))), 1)


def largest_sum(q: np.ndarray, c: np.ndarray) -> int:
    """No inner product of a row each, nor a part of one, is larger."""
    most = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return most(q) * most(c) * q.shape[1]


def exact_scores(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs; one that does not fit 64 bits is an error."""
    if largest_sum(q, c) >= NARROW:
        return np.array([sum(a * b for a, b in zip(q[i].tolist(), c[j].tolist(), strict=True))
                         for i, j in zip(rows, cols, strict=True)], np.int64)
    out = np.empty(len(rows), np.int64)
    for lo in range(0, len(rows), 1 << 16):
        out[lo:lo + (1 << 16)] = np.einsum("ij,ij->i", q[rows[lo:lo + (1 << 16)]], c[cols[lo:lo + (1 << 16)]])
    return out


class Best:
    """The k best (score, id) of each query of a block; smaller ids win ties."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.real = vectors.astype(float)
        self.levels = [segment_statistics(self.real, s) for s in RESOLUTIONS]
        self.norm = np.sqrt((self.real ** 2).sum(1))
        self.found: list[list[tuple[int, int]]] = [[] for _ in ids]

    def floor(self) -> np.ndarray:
        # a little below, where a score has more digits than a float
        return np.array([np.nextafter(-float(f[-1][0]), -np.inf) if len(f) == self.k else -np.inf for f in self.found])

    def meet(self, ids: np.ndarray, vectors: np.ndarray, levels: list[np.ndarray], first: int = 64):
        """Candidates of a block; the first few set the scores to beat."""
        real_norm = np.sqrt((vectors.astype(float) ** 2).sum(1))
        for part in (slice(0, first), slice(first, None)):
            own, v = ids[part], vectors[part]
            if not len(own):
                continue
            floor = self.floor()
            slack = 0.5 + 1e-9 * self.norm.max(initial=0) * real_norm[part].max(initial=0)
            alive = self.ids[:, None] != own[None]
            cols = np.arange(len(own))
            for mine, theirs in zip(self.levels, levels, strict=True):
                alive &= mine @ theirs[part][cols].T >= (floor - slack)[:, None]
                some = alive.any(0)
                if not some.all():
                    cols, alive = cols[some], alive[:, some]
                if not len(cols):
                    break
            if np.count_nonzero(alive) * DENSE >= alive.size and largest_sum(self.vectors, v) < FLOAT:
                scores = self.real @ v[cols].astype(float).T
                rows, at = np.nonzero(alive & (scores >= floor[:, None]))
                scores, at = scores[rows, at].astype(np.int64), cols[at]
            else:
                rows, at = np.nonzero(alive)
                scores = exact_scores(self.vectors, v, rows, cols[at])
                better = scores >= floor[rows]
                rows, at, scores = rows[better], cols[at[better]], scores[better]
            order = np.lexsort((own[at], -scores, rows))
            rows, at, scores = rows[order], at[order], scores[order]
            ends = np.searchsorted(rows, np.arange(len(self.ids) + 1))
            for r in np.unique(rows):
                top = slice(ends[r], min(ends[r + 1], ends[r] + self.k))
                new = zip((-scores[top]).tolist(), own[at[top]].tolist(), strict=True)
                self.found[r] = sorted([*self.found[r], *new])[:self.k]


def _pack(size: int):
    """Rows (vec_id, ints, number) as blocks of equal dimension."""
    def run(batches):
        held: dict[int, list] = {}

        def flush(rows):
            return pa.RecordBatch.from_pydict({
                "dim": pa.array([len(rows[0][1])], pa.int32()), "ids": pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
                "numbers": pa.array([[r[2] for r in rows]], pa.list_(pa.int64())),
                "vectors": pa.array([np.array([r[1] for r in rows], "<i8").tobytes()], pa.binary())})

        for batch in batches:
            for key, v, number in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                rows = held.setdefault(len(v), [])
                rows.append((key, v.values.to_numpy(), number))
                if len(rows) == size:
                    yield flush(held.pop(len(v)))
        for rows in held.values():
            yield flush(rows)
    return run


def _search(k: int):
    """Rows (group, kind, number of the block, dim, ids, numbers, vectors) in the
    order of the first three: a group's candidate blocks (kind 0) are held, then
    its query blocks (kind 1) pass through one at a time."""
    def run(batches):
        group, known = None, {}
        schema = pa.schema([(c, pa.int64()) for c in ("query", "query_id", "vec_id", "score")])
        for batch in batches:
            for g, kind, _, dim, ids, numbers, raw in zip(*batch.columns, strict=True):
                if g.as_py() != group:
                    group, known = g.as_py(), {}
                own = ids.values.to_numpy()
                v = np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, dim.as_py())
                if kind.as_py() == 0:  # copies, as a batch would stay whole for its slices
                    known.setdefault(dim.as_py(), []).append(
                        (own.copy(), v.copy(), [segment_statistics(v.astype(float), s) for s in RESOLUTIONS]))
                elif dim.as_py() in known:
                    best = Best(own, v, k)
                    for block in known[dim.as_py()]:
                        best.meet(*block)
                    rows = [(n, int(q), i, -s) for n, q, f in zip(numbers.values.to_pylist(), own, best.found, strict=True) for s, i in f]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, schema=schema)
    return run


def usable(col: str = "embedding"):
    """The vector has components, all finite and, times ``SCALE``, whole numbers of 64 bits."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float(1 << 63))
    return F.col(col).isNotNull() & (F.size(col) > 0) & F.forall(col, lambda x: F.coalesce(ok(x), F.lit(False)))


def top_k(candidates: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row of ``queries`` the k
    best rows of ``candidates`` (both ``vec_id, embedding``) by the inner
    product of floor(256 * x), smaller ids first among ties.

    Rows with a query's own ``vec_id`` are not its candidates.  Null vectors,
    empty ones and those with a null or non-finite component or a null id take
    no part, nor do those of which a scaled component does not fit a 64-bit
    number; a score that does not fit one is an error, as it has no result.  Only
    vectors of one dimension meet.  Repeated query
    rows are asked once; repeated candidates are ranked one by one.  Empty
    tables give no rows; other columns are ignored whatever their names."""
    ship_package(candidates.sparkSession)
    ints = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("v")
    rows = candidates.where(usable() & F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), ints, F.lit(0).cast("long").alias("number"))
    asked = (queries.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), ints).distinct()
             .withColumn("query", F.monotonically_increasing_id()))
    asked = scratch(asked, "queries")
    kind = "dim int, ids array<long>, numbers array<long>, vectors binary"
    blocks = scratch(rows.mapInArrow(_pack(CANDIDATE_BLOCK), kind).withColumn("no", F.monotonically_increasing_id()), "candidates")
    q_blocks = scratch(asked.select("vec_id", "v", "query").mapInArrow(_pack(QUERY_BLOCK), kind)
                       .withColumn("no", F.monotonically_increasing_id()), "query-blocks")
    groups = max(1, -(-blocks.count() // GROUP_BLOCKS))
    # A sort instead of a join: Spark sizes the query blocks as if there were one
    # copy, not one per group, and would broadcast all copies through the driver.
    own = F.pmod(F.xxhash64("no"), F.lit(groups)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    dealt = q_blocks.repartition(max(1, min(q_blocks.count(), groups)))  # the copies are made in many tasks
    cols = ["no", "dim", "ids", "numbers", "vectors"]
    met = (blocks.select(own.alias("group"), F.lit(0).alias("kind"), *cols)
           .unionByName(dealt.select(every.alias("group"), F.lit(1).alias("kind"), *cols))
           .repartition(groups, "group").sortWithinPartitions("group", "kind", "no"))
    found = met.mapInArrow(_search(k), "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def op7_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= 5
"""
