"""Global orderings without a single-task window.

``cumulative_sums`` is the distributed prefix sum behind ECDF, ROC, exact AUC
and average precision.  A window ordered over the whole table would put every
row into one task; instead rows are range-partitioned by the order column, each
partition gets its offset from a tiny total table (one row per partition), and
the running sum is a window inside the partition only.  Callers aggregate to one row per distinct order value first,
so a heavily repeated value is a single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlag.functions.hashing import hash32
from airlag.operators.exact_stats import exact_quantiles_many
from airlag.session import cut_lineage


def cumulative_sums(df: DataFrame, order_col: str, sum_cols: list[str],
                    descending: bool = False, prefix: str = "cum_") -> DataFrame:
    """Adds ``cum_<c>`` = sum of ``c`` over rows whose order value is <= the
    row's (>= when descending) and ``all_<c>`` = its sum over all rows, for
    rows with a non-null order value.  The input is evaluated once: it is
    stored in range order, and one total per range partition gives offsets."""
    ordv = F.col(order_col).cast("double")
    df = df.where(F.col(order_col).isNotNull()).withColumn("_ord", -ordv if descending else ordv)
    b = cut_lineage(df.repartitionByRange("_ord").withColumn("_bk", F.spark_partition_id()), "ordered")
    run, every = Window.orderBy("_bk"), Window.partitionBy()
    totals = b.groupBy("_bk").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    # one row per range partition: small, so broadcast and window are safe
    offsets = F.broadcast(totals.select(
        "_bk", *[(F.sum(f"_t_{c}").over(run) - F.col(f"_t_{c}")).alias(f"_o_{c}") for c in sum_cols],
        *[F.sum(f"_t_{c}").over(every).alias(f"all_{c}") for c in sum_cols]))
    inside = Window.partitionBy("_bk").orderBy("_ord").rangeBetween(Window.unboundedPreceding, 0)
    out = b.join(offsets, "_bk").withColumns({f"{prefix}{c}": F.col(f"_o_{c}") + F.sum(c).over(inside) for c in sum_cols})
    return out.drop("_ord", "_bk", *[f"_o_{c}" for c in sum_cols])


def topk(df: DataFrame, order: list, n: int) -> DataFrame:
    """Sort + limit (planned as TakeOrderedAndProject: per-partition top n,
    then a merge of n x partitions rows)."""
    return df.orderBy(*order).limit(n)


def head_tail_sample(df: DataFrame, n: int, order_cols: list[str], key_col: str,
                     seed: int = 42) -> DataFrame:
    """First n and last n rows by ``order_cols`` and n rows in seeded hash
    order, tagged with ``part``."""
    head = df.orderBy(*[F.asc(c) for c in order_cols], F.asc(key_col)).limit(n)
    tail = df.orderBy(*[F.desc(c) for c in order_cols], F.desc(key_col)).limit(n)
    samp = df.orderBy(hash32(key_col, seed), F.col(key_col)).limit(n)
    return (head.withColumn("part", F.lit("head")).unionByName(tail.withColumn("part", F.lit("tail")))
            .unionByName(samp.withColumn("part", F.lit("sample"))))


def subsample_n(df: DataFrame, n: int, key_col: str, seed: int = 42) -> DataFrame:
    """Exactly n rows without replacement in seeded hash order, all of them
    if there are fewer: one plan for every n, by exact ranks."""
    from airlag.operators.ranking import hash_rank
    return hash_rank(df, [], key_col, seed, first=n).drop("_rank")


def union_all(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def new_columns(before: DataFrame, after: DataFrame) -> list[str]:
    return [c for c in after.columns if c not in set(before.columns)]


def exact_quantiles(df: DataFrame, col: str, probs: list[float]) -> list[float | None]:
    """Exact quantiles of one column; see ``exact_stats``."""
    return exact_quantiles_many(df, [col], probs)[col]
