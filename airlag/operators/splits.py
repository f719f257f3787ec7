"""Train/test splits, folds and class balancing, all defined by hashing.

Membership depends only on the row key and the seed (never on partitioning or
on a random generator's state), so any run on any cluster gives the same sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlag.functions.hashing import hash_bucket, row_key
from airlag.operators.ranking import collapse_copies, expand_copies, hash_rank, hash_rank_distinct
from airlag.session import cut_lineage


def add_row_key(df: DataFrame, cols: list[str] | None = None, name: str = "row_key") -> DataFrame:
    return df.withColumn(name, row_key(cols or df.columns))


def split_random(df: DataFrame, key_col: str = "row_key", test_frac: float = 0.2,
                 seed: int = 42, col: str = "split") -> DataFrame:
    """Row-local: test when the key's bucket (of 10000) is below test_frac."""
    return df.withColumn(col, F.when(hash_bucket(key_col, seed) < int(round(test_frac * 10000)),
                                     F.lit("test")).otherwise(F.lit("train")))


def split_stratified(df: DataFrame, label: str, key_col: str = "row_key",
                     test_frac: float = 0.2, seed: int = 42, col: str = "split") -> DataFrame:
    """Exactly round(test_frac * n_class) rows of each class go to test: the
    first ones in seeded hash order."""
    r = hash_rank(df, [label], key_col, seed)
    return r.withColumn(col, F.when(F.col("_rank") <= F.round(F.col("_n") * test_frac),
                                    F.lit("test")).otherwise(F.lit("train"))).drop("_rank", "_n")


def kfold_stratified(df: DataFrame, label: str, k: int = 3, key_col: str = "row_key",
                     seed: int = 42, col: str = "fold") -> DataFrame:
    """Fold = (rank within class - 1) mod k: class shares equal in every fold."""
    r = hash_rank(df, [label], key_col, seed)
    return r.withColumn(col, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_n")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """Rows per class, stored: small, and read by what follows without
    counting again."""
    return cut_lineage(df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc")), "classes")


def class_weight_balanced(df: DataFrame, label: str, col: str = "weight") -> DataFrame:
    """w_c = n / (k * n_c) for every row of class c."""
    counts = class_counts(df, label)
    tot = counts.agg(F.sum("_nc"), F.count(F.lit(1))).first()
    w = counts.select(F.col(label).alias("_label"), (F.lit(tot[0]) / (F.lit(tot[1]) * F.col("_nc"))).alias(col))
    return df.join(w, df[label] == w["_label"], "left").drop("_label")


def scale_pos_weight(df: DataFrame, label: str, col: str = "weight") -> DataFrame:
    """Positives weighted n0 / n1, negatives 1: the two counts are one aggregate."""
    n = df.agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).first()
    ratio = n["n0"] / n["n1"] if n["n0"] and n["n1"] else None
    return df.withColumn(col, F.when(F.col(label) == 1, F.lit(ratio).cast("double")).otherwise(F.lit(1.0)))


def undersample_majority(df: DataFrame, label: str, key_col: str = "row_key",
                         seed: int = 42) -> DataFrame:
    """Every class cut to the minority size: the first rows in hash order."""
    g = cut_lineage(collapse_copies(df), "distinct")
    n_min = g.groupBy(label).agg(F.sum("_m").alias("n")).agg(F.min("n")).first()[0] or 0
    r = hash_rank_distinct(g, [label], key_col, seed, stored=True).where(F.col("_start") <= n_min)
    return (expand_copies(r.withColumn("_m", F.least(F.col("_m"), n_min - F.col("_start") + 1)))
            .drop("_m", "_start", "_end", "_rank", "_n"))


def apply_balancing(df: DataFrame, method: str, label: str, key_col: str = "row_key",
                    task: str = "classification", features: list[str] | None = None,
                    seed: int = 42) -> DataFrame:
    if task != "classification" or method in (None, "none"):
        return df
    if method == "class_weight":
        return scale_pos_weight(df, label)
    if method == "balanced":
        return class_weight_balanced(df, label)
    if method == "undersample":
        return undersample_majority(df, label, key_col, seed)
    if method == "smote":
        from airlag.operators.smote import smote_oversample
        return smote_oversample(df, label, features, key_col, seed=seed)
    raise ValueError(f"unknown balancing method {method!r}")
