"""Exact per-group ranks in a seeded hash order, without hot tasks.

``hash_rank`` gives every row of ``df`` its 1-based position inside its group
when rows are ordered by ``(hash32(key), key)``.  It is the basis of the exact
stratified split, k-fold assignment, under-sampling and exact n-row samples.

How it stays distributed:

1. Copies are collapsed first, and the distinct rows are stored: ``groupBy(all columns)`` with a multiplicity
   ``_m`` (map-side partial aggregation, so a row copied a billion times costs
   nothing extra to shuffle).
2. Distinct rows are spread over ``2^bits`` hash buckets per group (16 per
   shuffle partition, so buckets shrink as a job is sized up).  A small
   table of per-(group, bucket) totals gives each bucket its offset; it is
   stored, so Spark broadcasts it by its measured size.
3. Inside a bucket a window orders rows by (hash, key) and accumulates ``_m``.
   No window partition is ever a whole group.
4. Copies are expanded back in chunks of at most ``chunk`` rows, and chunks are
   redistributed round-robin before the final expansion, so one heavily copied
   row is generated by many tasks.

The order depends only on the key and the seed, so ranks are identical on any
cluster size and after any task retry.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlag.functions.hashing import hash32
from airlag.session import cut_lineage


#: Bits of the hash whose buckets tell which rows cannot be among the first ones.
FIRST_BITS = 14


def _bits_for(spark, buckets_per_partition: int = 16) -> int:
    """Hash buckets per group: 16 per shuffle partition (rounded up to a power
    of two).  ``spark.sql.shuffle.partitions`` is what a job sizes to its data,
    so a bucket stays a small fraction of one task's share without an extra
    counting pass over the input."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(24, max(0, math.ceil(math.log2(max(1, parts * buckets_per_partition)))))


def collapse_copies(df: DataFrame) -> DataFrame:
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_m"))


def hash_rank_distinct(g: DataFrame, group_cols: list[str], key_col: str, seed: int = 42,
                       buckets_per_partition: int = 16, stored: bool = False) -> DataFrame:
    """``g`` holds distinct rows with multiplicity ``_m``.  Adds ``_end``
    (rank of the row's last copy), ``_start`` and the group size ``_n``."""
    bits = _bits_for(g.sparkSession, buckets_per_partition)
    g = g.withColumn("_h", hash32(key_col, seed))
    g = g.withColumn("_b", F.shiftright(F.col("_h"), 32 - bits) if bits else F.lit(0).cast("long"))
    if not stored:  # read by the totals and by the window
        g = cut_lineage(g, "ranked")
    totals = g.groupBy(*group_cols, "_b").agg(F.sum("_m").alias("_bm"))
    w = Window.partitionBy(*group_cols).orderBy("_b")
    offsets = totals.select(
        *group_cols, "_b",
        (F.sum("_bm").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
         - F.col("_bm")).alias("_off"),
        F.sum("_bm").over(Window.partitionBy(*group_cols)).alias("_n"))
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(group_cols)]
    offsets = cut_lineage(offsets.select(*keys, F.col("_b").alias("_kb"), "_off", "_n"), "offsets")
    same = F.col("_b") == F.col("_kb")
    for i, c in enumerate(group_cols):  # null groups are groups too
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    # stored, so its size is known and Spark broadcasts it only if it is small
    j = g.join(offsets, same).drop("_kb", *[f"_k{i}" for i in range(len(group_cols))])
    wi = (Window.partitionBy(*group_cols, "_b").orderBy("_h", key_col)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    j = j.withColumn("_end", F.col("_off") + F.sum("_m").over(wi))
    return j.withColumn("_start", F.col("_end") - F.col("_m") + 1).drop("_h", "_b", "_off")


def _explode_range(df: DataFrame, count_col: str, out: str) -> DataFrame:
    return df.withColumn(out, F.explode(F.sequence(F.lit(0), F.col(count_col).cast("int") - 1)))


def expand_copies(g: DataFrame, chunk: int = 100_000, most: int | None = None) -> DataFrame:
    """Rows with multiplicity ``_m`` (and first rank ``_start``) -> one row per
    copy with its own ``_rank``.

    Rows with at most ``chunk`` copies expand in place.  Heavier rows are cut
    into chunks of ``chunk`` copies and the (few) chunk rows are spread
    round-robin before expanding, so no single task generates a hot row.
    ``most``: the largest multiplicity if known; without heavy rows their
    branch is left out of the plan."""
    light = _explode_range(g.where(F.col("_m") <= chunk), "_m", "_i")
    light = light.withColumn("_rank", F.col("_start") + F.col("_i")).drop("_i")
    if most is not None and most <= chunk:
        return light
    heavy = g.where(F.col("_m") > chunk)
    heavy = heavy.withColumn("_nc", F.ceil(F.col("_m") / F.lit(chunk)))
    heavy = _explode_range(heavy, "_nc", "_ci").withColumn("_lo", F.col("_ci") * chunk)
    heavy = heavy.withColumn("_cn", F.least(F.col("_m") - F.col("_lo"), F.lit(chunk)))
    parts = int(g.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = _explode_range(heavy.repartition(parts), "_cn", "_i")
    heavy = heavy.withColumn("_rank", F.col("_start") + F.col("_lo") + F.col("_i")) \
        .drop("_nc", "_ci", "_lo", "_cn", "_i")
    return light.unionByName(heavy)


def _may_be_first(df: DataFrame, group_cols: list[str], key_col: str, seed: int, first: int) -> DataFrame:
    """The rows of ``df`` without those that ``first`` rows of their group
    precede: those in hash buckets that begin beyond it.  Only counts per group
    and bucket are shuffled."""
    bucket = F.shiftright(hash32(key_col, seed), 32 - FIRST_BITS)
    counts = df.groupBy(*group_cols, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_m"))
    run = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = counts.withColumn("_before", F.sum("_m").over(run) - F.col("_m")).where(F.col("_before") < first)
    last = last.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(group_cols)]).agg(F.max("_b").alias("_last"))
    last = cut_lineage(last, "last-buckets")  # a row per group
    near = F.coalesce(bucket <= F.col("_last"), bucket.isNull())  # rows without a key come first
    for i, c in enumerate(group_cols):
        near = near & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(last, near).select(*[df[c] for c in df.columns])


def hash_rank(df: DataFrame, group_cols: list[str], key_col: str, seed: int = 42,
              buckets_per_partition: int = 16, first: int | None = None) -> DataFrame:
    """Every row of ``df`` with ``_rank`` (1-based, within its group in
    (hash, key) order) and the group size ``_n``.  ``first``: only the rows with
    ranks up to it, without ``_n``; the others are left out before rows are shuffled."""
    if first is not None:
        near = _may_be_first(df, group_cols, key_col, seed, first)
        return hash_rank(near, group_cols, key_col, seed, buckets_per_partition).where(F.col("_rank") <= first).drop("_n")
    g = cut_lineage(collapse_copies(df), "distinct")
    most = g.agg(F.max("_m")).first()[0] or 0
    ranked = hash_rank_distinct(g, group_cols, key_col, seed, buckets_per_partition, stored=True)
    return expand_copies(ranked, most=most).drop("_m", "_start", "_end")
