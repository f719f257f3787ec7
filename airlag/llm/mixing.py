"""Mixing sources to target weights: raking, then calibrated sampling.

The corpus is summed into cells (source, language, topic).  Iterative
proportional fitting rakes the cells' token weights to the target shares of
each of the three dimensions in turn; a raking step is one window sum over the
cells of a category.  The fitted weights give every cell a sampling rate, and
one factor for all cells is calibrated so that the expected number of tokens
meets the budget although no rate can exceed one.  Documents are then drawn by
a hash of their id.  Everything is DataFrame expressions; texts are read once,
to count and classify, and are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlag.llm.common import n_words, read_table, scratch

DIMENSIONS = ("source", "lang", "topic")
#: A number flattens the present shares by that exponent, a dict names shares.
TARGETS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
KEEP_TOKENS = 0.8
#: Raking goes on until no category is further than this from its target share,
#: or until ``TURN`` rounds take less than ``LEAST_GAIN`` of the largest error away.
TOLERANCE, TURN, LEAST_GAIN = 1e-9, 4, 0.1
SEED = 20


def topic_of(text: Column) -> Column:
    """Topic class of a text by its form; null and wordless texts are ``empty``."""
    words = n_words(text)
    marks = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>{}=]")), F.lit(0))
    return (F.when(words == 0, "empty").when(text.rlike(r"(?i)\b(licen[cs]e|copyright)\b"), "legal")
            .when(marks * 4 > words, "markup").when(words < 100, "note")
            .when(words < 600, "article").otherwise("long"))


def classed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, source, lang, topic, n_tokens``: words plus one for the end of the document."""
    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), topic_of(text).alias("topic"),
                       (n_words(text) + 1).alias("n_tokens"))


def _with_targets(cells: DataFrame, targets: dict) -> DataFrame:
    """Adds ``t_<d>``: the target share of the cell's category in each dimension."""
    out = cells
    for d in DIMENSIONS:
        goal, by = targets.get(d, 1.0), Window.partitionBy(d)
        named = goal if isinstance(goal, dict) else {}
        exponent = 1.0 if isinstance(goal, dict) else float(goal)
        wanted = F.lit(None).cast("double")
        for name, share in named.items():
            wanted = F.when(F.col(d) == name, F.lit(float(share))).otherwise(wanted)
        out = out.withColumn("m", F.sum("tokens").over(by)).withColumns(
            {f"n_{d}": wanted, f"f_{d}": F.pow(F.col("m"), F.lit(exponent)), f"p_{d}": F.col("tokens") / F.col("m")})
    out = scratch(out.drop("m"), "mixing-margins")
    # what the unnamed categories share, and the sum of their flattened masses: six numbers
    sums = out.agg(
        *[F.coalesce(F.sum(F.when(F.col(f"n_{d}").isNull(), F.col(f"p_{d}") * F.col(f"f_{d}"))), F.lit(0.0)).alias(f"z_{d}")
          for d in DIMENSIONS],
        *[F.coalesce(F.sum(F.col(f"p_{d}") * F.col(f"n_{d}")), F.lit(0.0)).alias(f"s_{d}") for d in DIMENSIONS]).first()
    share = {}
    for d in DIMENSIONS:
        rest = max(0.0, 1.0 - sums[f"s_{d}"]) if sums[f"z_{d}"] else 0.0
        both = sums[f"s_{d}"] + rest or 1.0
        share[f"t_{d}"] = F.coalesce(F.col(f"n_{d}"), F.col(f"f_{d}") * (rest / (sums[f"z_{d}"] or 1.0))) / both
    return out.select(*DIMENSIONS, "tokens", "docs", *[c.alias(n) for n, c in share.items()])


def rake(cells: DataFrame, targets: dict, tolerance: float = TOLERANCE) -> DataFrame:
    """Cells (``source, lang, topic, tokens, docs``) with ``share``: their part
    of the target mixture by proportional fitting, and ``margin_error``: the
    largest distance of a category's share from its target that is left.  Rounds
    go on until it is below ``tolerance`` or stops falling, as it does where the
    present cells cannot meet all margins together; the last dimension's are
    met exactly.  Rare categories are cells like any others."""
    out = _with_targets(cells, targets).withColumn("share", F.col("tokens") / 1.0)
    total = lambda d: F.sum("share").over(Window.partitionBy(d))
    last = float("inf")
    while True:
        for _ in range(TURN):
            for d in DIMENSIONS:
                out = out.withColumn("share", F.when(total(d) > 0, F.col("share") * F.col(f"t_{d}") / total(d)).otherwise(0.0))
        out = scratch(out, "mixing-round")
        apart = F.greatest(*[F.abs(total(d) - F.col(f"t_{d}")) for d in DIMENSIONS])
        error = out.select(apart.alias("e")).agg(F.coalesce(F.max("e"), F.lit(0.0))).first()[0]
        if error <= tolerance or error > last * (1 - LEAST_GAIN):
            return out.withColumn("margin_error", F.lit(error))
        last = error


def sampling_rates(raked: DataFrame, keep_tokens: float = KEEP_TOKENS) -> DataFrame:
    """Adds ``rate`` = min(1, k * share / tokens), k chosen so that the rates
    keep ``keep_tokens`` of all tokens, if that many cells have a share."""
    per_token = F.col("share") / F.col("tokens")
    k = None
    while True:  # every turn clips more cells, so this ends; usually after three or four sums
        over = F.lit(False) if k is None else per_token * k >= 1.0
        s = raked.agg(F.sum("tokens").alias("all"), F.count(F.when(over, 1)).alias("n"),
                      F.sum(F.when(over, F.col("tokens"))).alias("full"),
                      F.sum(F.when(~over, F.col("share"))).alias("open")).first()
        new = (keep_tokens * (s["all"] or 0) - (s["full"] or 0)) / s["open"] if s["open"] else k or 0.0
        if k is not None and (s["n"] == clipped or new <= k):
            break
        k, clipped = max(new, 0.0), s["n"]
    return raked.withColumn("rate", F.least(F.lit(1.0), per_token * F.lit(k)))


def unit_hash(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _rates(slim: DataFrame, targets: dict, keep_tokens: float) -> DataFrame:
    cells = scratch(slim.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"),
                                                  F.count(F.lit(1)).alias("docs")), "mixing-cells")
    return sampling_rates(rake(cells, targets or {}), keep_tokens)


def _same_cell(a: DataFrame, b: DataFrame) -> Column:
    return a["source"].eqNullSafe(b["source"]) & a["lang"].eqNullSafe(b["lang"]) & a["topic"].eqNullSafe(b["topic"])


def mix_rows(docs: DataFrame, targets: dict | None = None, keep_tokens: float = KEEP_TOKENS,
             seed: int = SEED) -> DataFrame:
    """Sampling decision for every document: ``doc_id, source, lang, topic,
    n_tokens, share, rate, sampled``.

    ``share`` is the cell's part of the target mixture.  Null sources and
    languages are categories of their own; a null text counts one token, topic
    ``empty``; rows with the same id are drawn together; an empty table gives
    no rows; other columns are ignored whatever their names.
    """
    slim = classed(docs)
    cells = _rates(slim, TARGETS if targets is None else targets, keep_tokens)
    return slim.join(cells, _same_cell(slim, cells)).select(
        "doc_id", slim["source"], slim["lang"], slim["topic"], "n_tokens", "share", "rate",
        (unit_hash(F.col("doc_id"), seed) < F.col("rate")).alias("sampled"))


def mix(docs: DataFrame, targets: dict | None = None, keep_tokens: float = KEEP_TOKENS,
        seed: int = SEED) -> DataFrame:
    """The sampled rows of ``docs``, with their columns; nulls, repeated rows and
    empty tables as in ``mix_rows``."""
    cells = _rates(classed(docs), TARGETS if targets is None else targets, keep_tokens).select(
        *[F.col(d).alias(f"_mix_{d}") for d in DIMENSIONS], F.col("rate").alias("_mix_rate"))
    same = (F.col("source").cast("string").eqNullSafe(F.col("_mix_source"))
            & F.col("lang").cast("string").eqNullSafe(F.col("_mix_lang"))
            & topic_of(F.col("text")).eqNullSafe(F.col("_mix_topic")))
    drawn = docs.join(cells, same).where(unit_hash(F.col("doc_id"), seed) < F.col("_mix_rate"))
    return drawn.select(*[docs[c] for c in docs.columns])


def op9_mix_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_rows(read_table(spark, sf_dir, "documents"))
