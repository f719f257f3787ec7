"""Deterministic hashing used for every split and sample.

The bucket of a row depends only on the row's key and a seed, never on the
partitioning, so results repeat on any cluster size and after task retries.
``hash32`` is the first 8 hex digits of md5(seed|key) as an integer in
[0, 2^32); the same value is available in plain SQL engines, which makes the
splits checkable.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NULL_TOKEN = "\\N"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def row_key(cols: list[str]) -> Column:
    """md5 over the string form of the given columns, nulls marked."""
    parts = [F.coalesce(_c(c).cast("string"), F.lit(NULL_TOKEN)) for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def hash32(key, seed: int = 42) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}|"), _c(key).cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_bucket(key, seed: int = 42, buckets: int = 10000) -> Column:
    return F.pmod(hash32(key, seed), F.lit(buckets))
