"""Work of the shared steps: what is read once, what is shuffled."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from airlag.operators import cleaning as CL
from airlag.plans import base as B
from airlag.plans.preprocess import preprocess

SF = "/root/testdata/sf0.001"


def test_cleaning_evaluates_its_records_once(spark):
    raw = B.raw(spark, SF)
    n, seen = raw.count(), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(v):
        seen.add(1)
        return v

    counted = counted.asNondeterministic()
    out = preprocess(raw.withColumn("tail_number", counted("tail_number")))
    assert out.count() == B.clean(spark, SF).count()
    assert n * 0.9 <= seen.value <= n


def test_distinct_by_hashes_is_that_of_whole_rows(spark, monkeypatch):
    rows = [(1, None, 0.0), (1, None, -0.0), (None, "1", 1.0), (None, "1", 1.0), (2, "a", math.nan), (2, "a", math.nan), (3, "b", None),
            (3, "b", 2.0)]
    df = spark.createDataFrame(rows, "a int, b string, c double")
    key = lambda frame: sorted(str((r.a, r.b, None if r.c is None else r.c + 0.0)) for r in frame.collect())
    for most in (CL.REPEATED_BROADCAST, 1):  # hashes of copies broadcast, or all rows compared
        monkeypatch.setattr(CL, "REPEATED_BROADCAST", most)
        assert key(CL.drop_duplicates(df)) == key(df.dropDuplicates())


def test_the_regression_stage_is_cut_from_the_cleaned_one(spark):
    both = B.clean(spark, SF).inputFiles(), B.clean_regression(spark, SF).inputFiles()
    assert sorted(both[0]) == sorted(both[1])
    assert B.clean_regression(spark, SF).where("arr_delay_min is null or arr_delay_min not between -60 and 300").isEmpty()


def test_first_ranks_leave_later_buckets_out(spark):
    from airlag.operators import ranking as R
    df = spark.range(40_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") < 39_000, (F.col("id") % 30_000).cast("string")).alias("key"))
    df = df.withColumn("g", F.when(F.col("g") > 0, F.col("g")))  # a null group
    rows = lambda x: sorted(map(str, x.select("g", "key", "_rank").collect()))
    for groups in ([], ["g"]):
        whole = R.hash_rank(df, groups, "key").where("_rank <= 1700")
        assert rows(R.hash_rank(df, groups, "key", first=1700)) == rows(whole)
        assert R._may_be_first(df, groups, "key", 42, 1700).count() < 8_000
    assert R.hash_rank(df, [], "key", first=10 ** 9).count() == 39_000
    assert R.hash_rank(df.limit(0), [], "key", first=5).count() == 0
