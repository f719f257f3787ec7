"""The corpus pipeline: documents in, packed training sequences out.

``STAGES`` lists the stages in order; each takes ``(spark, docs, sf_dir)``, with
``docs`` what the stage before kept, and calls one operator of ``airlag.llm``.
All but the last return the columns of ``documents``.  A stage deletes the
scratch tables of the stages before it, whose results are stored by then,
except those that its own input still reads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airlag.llm import mixing, ngram_join, packing, quality_rules, substring_dedup
from airlag.llm.common import read_table, release, scratch, scratch_owner

_OWNER = "pipeline"


def _stage(apply):
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _OWNER, still_read=docs)
        with scratch_owner(_OWNER):
            return apply(spark, docs, sf_dir)
    stage.__name__, stage.__doc__ = apply.__name__, apply.__doc__
    return stage


@_stage
def keep_quality(spark, docs, sf_dir):
    """Rejected documents go; rules are learned from the labelled ones."""
    return quality_rules.keep_good(docs, read_table(spark, sf_dir, "labels"))


@_stage
def drop_near_duplicates(spark, docs, sf_dir):
    """Of documents whose five-word shingles overlap by 0.8 or more one stays."""
    return ngram_join.one_of_each(docs)


@_stage
def drop_repeated_passages(spark, docs, sf_dir):
    """Words in 35-word windows that occur more than once go; documents stay."""
    return substring_dedup.without_repeats(docs)


@_stage
def mix_sources(spark, docs, sf_dir):
    """A sample whose tokens follow the target shares."""
    return mixing.mix(docs)


@_stage
def pack_sequences(spark, docs, sf_dir):
    """Sequences of at most 1024 tokens, a row per piece of a document."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Rules, components and packings are not expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is stored before the next stage reads it."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            with scratch_owner(_OWNER):
                docs = scratch(docs, f"stage-{name}")
    return docs
