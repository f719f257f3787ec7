"""Quality rules: a decision list learned from labelled statistics.

Every text becomes a row of counts.  From the counts of a bounded sample of
labelled documents, sequential covering learns rules for the poor ones: a rule
grows condition by condition (the threshold with the best information gain on
the growing part), is pruned on the held-back part, and is accepted if it is
precise there; what it covers is set aside and the next rule is grown.  The
result is an ordered list of threshold conjunctions, emitted as a Spark
conditional expression over the counts, so it is applied to any table without
Python and can be read by people.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlag.llm.common import read_table, ship_package

MIN_WORDS = 50
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
#: Bound on the labelled documents that the list is learned from.
MAX_LABELLED = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 4
CUT_POINTS = 48
#: A rule must be right this often, and cover this many poor documents, on the held-back part.
MIN_PRECISION = 0.95
MIN_COVERED = 3
SEED = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
          "n_lines", "n_distinct", "n_upper", "n_digits", "n_stops", "n_marks")
#: Statistics that conditions may test: name, numerator, denominator; in whole thousandths, or plain.
STATISTICS = (
    ("n_words", "n_words", None), ("word_length", "word_chars", "n_words"), ("symbol_share", "n_symbols", "n_words"),
    ("dup_line_share", "n_dup_lines", "n_lines"), ("repeat_share", "n_repeat_words", "n_words"),
    ("distinct_share", "n_distinct", "n_words"), ("upper_share", "n_upper", "word_chars"),
    ("digit_share", "n_digits", "word_chars"), ("stop_share", "n_stops", "n_words"),
    ("mark_share", "n_marks", "word_chars"), ("line_words", "n_words", "n_lines"))
_SPACES = " \t\n\r\x0b\x0c"
_UPPER, _DIGITS, _STOPS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".!?"
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-")


# ------------------------------------------------------------- in the tasks
def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside 3-word windows found at least twice, and distinct words."""
    ids: dict = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    if len(x) < 3:
        return 0, len(ids)
    _, pairs = np.unique(x[:-1] * len(ids) + x[1:], return_inverse=True)
    _, where, n = np.unique(pairs[:-1] * len(ids) + x[2:], return_inverse=True, return_counts=True)
    often = n[where] > 1
    inside = np.zeros(len(x), bool)
    for k in range(3):
        inside[k:len(often) + k] |= often
    return int(inside.sum()), len(ids)


def count_text(text: str | None) -> tuple:
    """The counts of one whole text, in the order of ``COUNTS``."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen, lines, again = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip():
            lines += 1
            again += line in seen
            seen.add(line)
    repeats, distinct = repeated_words(words)
    share = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (len(words), len(text) - sum(text.count(c) for c in _SPACES), sum(text.count(c) for c in SYMBOLS),
            again, repeats, lines, distinct, share(_UPPER), share(_DIGITS), share(_STOPS), share(_MARKS))


def text_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``row`` (a struct of the other columns) and the counts of each text."""
    ship_package(docs.sparkSession)
    row = F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row")
    slim = docs.select(row, docs[text_col].alias("text"))

    def run(batches):
        for batch in batches:
            found = np.array([count_text(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(np.ascontiguousarray(found[:, i])) for i in range(len(COUNTS))]], ["row", *COUNTS])

    kind = slim.schema["row"].dataType.simpleString()
    return slim.mapInArrow(run, f"row {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


# ----------------------------------------------------------------- learning
@dataclass(frozen=True)
class Condition:
    statistic: str
    at_least: bool
    threshold: int

    def column(self) -> Column:
        value = statistic_column(self.statistic)
        return value >= self.threshold if self.at_least else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<='} {self.threshold}"


def statistic_column(name: str) -> Column:
    _, top, below = next(s for s in STATISTICS if s[0] == name)
    return F.col(top) if below is None else F.expr(f"({top} * 1000L) div greatest({below}, 1L)")


def statistics(counts: np.ndarray) -> np.ndarray:
    """The statistics of rows of ``COUNTS``, as ``statistic_column`` has them."""
    col = {c: counts[:, i] for i, c in enumerate(COUNTS)}
    return np.stack([col[top] if below is None else col[top] * 1000 // np.maximum(col[below], 1)
                     for _, top, below in STATISTICS], 1)


def _holds(c: Condition, x: np.ndarray) -> np.ndarray:
    v = x[:, [s[0] for s in STATISTICS].index(c.statistic)]
    return v >= c.threshold if c.at_least else v <= c.threshold


def _covers(rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= _holds(c, x)
    return out


def _grow(x: np.ndarray, poor: np.ndarray) -> list[Condition]:
    rule, inside = [], np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and (inside & ~poor).any():
        p0, n0 = (inside & poor).sum(), (inside & ~poor).sum()
        best = (1e-9, None)
        for f, (name, _, _) in enumerate(STATISTICS):
            v = x[inside, f]
            good, bad = np.sort(v[~poor[inside]]), np.sort(v[poor[inside]])
            cuts = np.unique(np.quantile(bad, np.linspace(0, 1, CUT_POINTS), method="nearest"))
            for at_least in (True, False):
                side = "left" if at_least else "right"
                p, n = np.searchsorted(bad, cuts, side), np.searchsorted(good, cuts, side)
                p, n = (len(bad) - p, len(good) - n) if at_least else (p, n)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -1.0)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], Condition(name, at_least, int(cuts[i])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _holds(best[1], x)
    return rule


def _prune(rule: list[Condition], x: np.ndarray, poor: np.ndarray) -> list[Condition]:
    def worth(r):
        inside = _covers(r, x)
        p, n = (inside & poor).sum(), (inside & ~poor).sum()
        return (p - n) / max(p + n, 1)
    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def learn_rules(counts: np.ndarray, poor: np.ndarray, ids: np.ndarray) -> list[list[Condition]]:
    """Ordered rules for poor documents by sequential covering.  Every third
    row by a hash of its id is held back for pruning and acceptance."""
    x, poor = statistics(counts), poor.astype(bool)
    back = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(3) == 0
    gx, gp, px, pp = x[~back], poor[~back], x[back], poor[back]
    rules: list[list[Condition]] = []
    for _ in range(2 * MAX_RULES):
        rule = _grow(gx, gp) if gp.any() and len(rules) < MAX_RULES else []
        if not rule:
            break
        rule = _prune(rule, px, pp)
        inside = _covers(rule, px)
        covered = (inside & pp).sum()
        aside = _covers(rule, gx)
        if covered >= MIN_COVERED and covered >= MIN_PRECISION * inside.sum():
            rules.append(rule)
            gx, gp, px, pp = gx[~aside], gp[~aside], px[~inside], pp[~inside]
        else:  # not precise enough: look for the remaining poor documents elsewhere
            gx, gp = gx[~(aside & gp)], gp[~(aside & gp)]
    return rules


def rule_column(rules: list[list[Condition]]) -> Column:
    """Number of the first rule that holds (from 1), null if none does."""
    out = None
    for i, rule in enumerate(rules):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column()
        out = F.when(holds, F.lit(i + 1)) if out is None else out.when(holds, F.lit(i + 1))
    return F.lit(None).cast("int") if out is None else out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[list[Condition]]:
    """Rules from at most ``MAX_LABELLED`` labelled documents, taken in the
    order of a hash of their id.  ``labels``: ``doc_id, quality`` (0 poor, 1
    good; null unknown; of several labels the smallest counts).  Without
    labelled documents there are no rules."""
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
             .agg(F.min("quality").alias("quality")).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(MAX_LABELLED))
    pick = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")
    rows = (text_counts(pick.select("doc_id", "quality", "text")).groupBy("row.doc_id", "row.quality")
            .agg(F.min(F.struct(*COUNTS)).alias("c")).select(F.xxhash64("doc_id").alias("h"), "quality", "c.*")
            .orderBy("h").collect())  # MAX_LABELLED rows at most
    if not rows:
        return []
    counts = np.array([[r[c] for c in COUNTS] for r in rows], np.int64)
    return learn_rules(counts, np.array([r["quality"] == 0 for r in rows]), np.array([r["h"] for r in rows], np.int64))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, rules: list[list[Condition]], text_col: str = "text") -> DataFrame:
    """``row`` (the other columns), counts, ``base_failed``, ``rule`` (the
    first learned rule that rejects, null if none) and ``kept`` for every row.

    A null or empty text has zero counts and fails the base; repeated rows are
    judged alike; an empty table gives no rows; names of other columns cannot
    clash, since they stay inside ``row``."""
    return text_counts(docs, text_col).withColumns({"base_failed": base_failed(), "rule": rule_column(rules)}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the base and the learned list keep, whole and as
    often as they are there, whatever their columns are called.  Null and empty
    texts fail the base; without a usable label no rule is learned and the base
    alone decides; an empty table gives no rows."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), "text")
    return judge(whole, fit(docs, labels)).where("kept").select("row.doc.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    rules = fit(docs, read_table(spark, sf_dir, "labels"))
    return judge(docs, rules).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "rule")
