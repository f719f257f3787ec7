"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlag import session
from airlag.session import ensure_checkpoint_dir

#: A word is a run of characters other than the six ASCII white-space ones.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


#: Rows of a batch that goes to a Python worker: texts may be long, and Spark's
#: default of 10,000 rows holds all of theirs several times over.
BATCH_ROWS = 1000
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ship_package(spark: SparkSession) -> None:
    """Make the package importable in the workers, and batches small unless the session sets their size."""
    session.ship_package(spark)
    if spark.conf.get(_BATCH_KEY, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_KEY, str(BATCH_ROWS))


#: Folders of scratch tables by application and owner.
_SCRATCH: dict[tuple[str, str], list[str]] = {}
_OWNER = ["operators"]


@contextmanager
def scratch_owner(name: str):
    """Scratch tables made inside belong to ``name``."""
    _OWNER.append(name)
    try:
        yield
    finally:
        _OWNER.pop()


def scratch(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and return a scan of it, so
    that what follows starts from a stored table also after executors are
    lost.  The folder is remembered for ``release``."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(folder)
    return spark.read.parquet(keep_folder(spark, folder))


def keep_folder(spark: SparkSession, folder: str) -> str:
    """Remember a folder of the owner's for ``release``."""
    _SCRATCH.setdefault((spark.sparkContext.applicationId, _OWNER[-1]), []).append(folder)
    return folder


def release(spark: SparkSession, owner: str = "operators", still_read: DataFrame | None = None) -> int:
    """Delete the owner's scratch tables, other than those that ``still_read``
    scans, and return how many went.  Results read their scratch tables until
    they are written: call this once the owner's earlier results are stored."""
    key = (spark.sparkContext.applicationId, owner)
    used = "\n".join(still_read.inputFiles()) if still_read is not None else ""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    kept = [f for f in _SCRATCH.get(key, []) if f.rsplit("/", 1)[1] in used]
    gone = [f for f in _SCRATCH.get(key, []) if f not in kept]
    for folder in gone:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    _SCRATCH[key] = kept
    return len(gone)


#: A key is hot if it holds more than one part in this many of all rows.
HOT_PARTS = 10_000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], counts: DataFrame, total: int, how: str) -> DataFrame:
    """``left.join(right, keys, how)``, ``how`` inner or left, with the rows of a hot
    key of ``left`` spread over as many salts as it holds parts of all rows; the
    rows of ``right`` travel once per salt.

    ``counts``: rows of ``left`` by key (``keys``, ``n``), ``total``: of all keys.
    Fewer than ``HOT_PARTS`` keys can be hot, which bounds the broadcast, and
    they have fewer than twice as many salts.  The salt is drawn per row, so
    rows alike in every column are spread too."""
    hot = F.broadcast(counts.where(F.col("n") * HOT_PARTS > total).select(
        *keys, F.ceil(F.col("n") * HOT_PARTS / F.lit(max(total, 1))).alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    a = left.join(hot, keys, "left").withColumn("_salt", F.floor(F.rand(1) * salts).cast("long")).drop("_salts")
    b = right.join(hot, keys, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts")
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def n_words(text: Column) -> Column:
    """Words of a text as long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
