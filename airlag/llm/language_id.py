"""Language identification by a small convolutional network over bytes.

Texts are cut into windows of ``WINDOW`` bytes.  Bytes are embedded, filters of
several widths run over them, the strongest response of every filter in the
window is kept, and a softmax layer names the language.  The network is trained
with numpy on windows of a bounded sample of labelled documents.  A prediction
uses all windows of the whole text: their probabilities are averaged, weighted
by the letters they hold.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlag.llm.common import read_table, ship_package

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
#: Bounds of the training sample: documents of each language, and windows of each.
MAX_EACH = 1000
WINDOWS_EACH = 3
EPOCHS = 8
BATCH = 64
RATE = 0.01
SEED = 8
UNKNOWN = "und"
#: Weight of a byte in the average: ASCII letters and bytes of other characters.
_LETTERS = np.array([chr(c).isalpha() if c < 128 else True for c in range(256)], np.float32)


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray    # max(WIDTHS) * EMBEDDING x features; narrower filters end in zeros
    bias: np.ndarray
    dense: np.ndarray      # features x languages
    offset: np.ndarray

    def unrolled(self, windows: np.ndarray) -> np.ndarray:
        """Every run of max(WIDTHS) embedded bytes as a row; windows end in zero bytes."""
        wide = max(WIDTHS)
        padded = np.zeros((len(windows), windows.shape[1] + wide - 1), np.uint8)
        padded[:, :windows.shape[1]] = windows
        flat = self.embedding[padded].reshape(len(windows), -1)
        runs = np.lib.stride_tricks.sliding_window_view(flat, wide * EMBEDDING, 1)[:, ::EMBEDDING]
        return np.ascontiguousarray(runs).reshape(-1, wide * EMBEDDING)

    def features(self, windows: np.ndarray, places: bool = False):
        """Strongest response of each filter (at least 0) per window, and where it is."""
        runs = self.unrolled(windows)
        answer = (runs @ self.filters).reshape(len(windows), -1, self.filters.shape[1])
        if not places:
            return np.maximum(answer.max(1) + self.bias, 0)
        at = answer.argmax(1)
        top = np.take_along_axis(answer, at[:, None], 1)[:, 0]
        return np.maximum(top + self.bias, 0), at, runs

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = [softmax(self.features(windows[i:i + 256]) @ self.dense + self.offset) for i in range(0, len(windows), 256)]
        return np.concatenate(out) if out else np.empty((0, len(self.languages)), np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts as windows (the last of a text padded with
    zeros), and the number of windows of each; an empty text has one."""
    sizes = np.array([max(1, -(-len(t) // WINDOW)) for t in texts], np.int64)
    joined = b"".join(t.ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, sizes, strict=True))
    return np.frombuffer(joined, np.uint8).reshape(-1, WINDOW), sizes


def train(texts: list[bytes], languages: list[str], seed: int = SEED) -> Network:
    """Adam on the cross entropy, languages weighted evenly."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    wide, n = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.repeat([[1.0 if k < w else 0.0 for w in WIDTHS for _ in range(FILTERS)] for k in range(wide)], EMBEDDING, 0)
    net = Network(names, rng.normal(0, 0.5, (256, EMBEDDING)), rng.normal(0, 0.3, (wide * EMBEDDING, n)) * mask,
                  np.zeros(n), rng.normal(0, 0.3, (n, len(names))), np.zeros(len(names)))
    for f in ("embedding", "filters", "bias", "dense", "offset"):
        setattr(net, f, getattr(net, f).astype(np.float32))
    mask = mask.astype(np.float32)
    x = np.frombuffer(b"".join(t[:WINDOW].ljust(WINDOW, b"\0") for t in texts), np.uint8).reshape(-1, WINDOW)
    y = np.searchsorted(names, languages)
    share = np.bincount(y, minlength=len(names)) / len(y)
    weight = (1 / (len(names) * share))[y].astype(np.float32)
    state = {f: [np.zeros_like(getattr(net, f)), np.zeros_like(getattr(net, f))]
             for f in ("embedding", "filters", "bias", "dense", "offset")}
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            b = order[lo:lo + BATCH]
            feats, at, runs = net.features(x[b], places=True)
            d = softmax(feats @ net.dense + net.offset)
            d[np.arange(len(b)), y[b]] -= 1
            d *= weight[b][:, None] / len(b)
            back = (d @ net.dense.T) * (feats > 0)
            # only the strongest place of each filter has a gradient
            picked = runs.reshape(len(b), WINDOW, -1)[np.arange(len(b))[:, None], at]
            grad = {"dense": feats.T @ d, "offset": d.sum(0), "bias": back.sum(0),
                    "filters": np.einsum("bf,bfk->kf", back, picked) * mask}
            emb = np.zeros_like(net.embedding)
            into = (back[:, :, None] * net.filters.T[None]).reshape(len(b), n, wide, EMBEDDING)
            padded = np.pad(x[b], ((0, 0), (0, wide - 1)))
            which = padded[np.arange(len(b))[:, None, None], at[:, :, None] + np.arange(wide)]
            np.add.at(emb, which.ravel(), into.reshape(-1, EMBEDDING))
            grad["embedding"] = emb
            step += 1
            for f, g in grad.items():
                m, v = state[f]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
                setattr(net, f, (getattr(net, f) - move).astype(np.float32))
    return net


# ----------------------------------------------------------------- in Spark
def fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 4


def fit(docs: DataFrame, held_out: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Network trained on windows from random places of at most ``MAX_EACH``
    documents of each language outside fold ``held_out``, those with the
    smallest hashes of id and text, however the table is laid out; None without
    any.  The sample that reaches the driver grows with the languages only."""
    text, chars = F.col(text_col), F.length(text_col)
    start = lambda i: (F.pmod(F.xxhash64(F.col("h"), i), F.greatest(chars - WINDOW + 1, F.lit(1))) + 1).cast("int")
    labelled = docs.where(F.col(lang_col).isNotNull() & (fold(F.col(id_col)) != held_out) & text.rlike(r"\p{L}"))
    labelled = labelled.select(F.col(lang_col).alias("lang"), text.alias(text_col), F.xxhash64(F.lit(SEED), F.col(id_col), text).alias("h"))
    # tasks send about two samples' worth of rows of a language, however many there are
    each = labelled.groupBy("lang").agg(F.least(F.lit(1.0), 2 * MAX_EACH / F.count(F.lit(1))).alias("part"))
    some = labelled.join(each, "lang").where(F.pmod("h", F.lit(1 << 40)) < F.col("part") * (1 << 40))
    windows = some.select("lang", "h", F.transform(F.sequence(F.lit(1), F.lit(WINDOWS_EACH)),
                                                   lambda i: F.substring(text, start(i), F.lit(WINDOW))).alias("w"))
    first = Window.partitionBy("lang").orderBy("h", "w")
    rows = (windows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= MAX_EACH)
            .orderBy("h", "lang", "w").select("lang", "w").collect())
    pairs = [(w.encode(), r["lang"]) for r in rows for w in r["w"]]
    return train([w for w, _ in pairs], [g for _, g in pairs]) if pairs else None


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` from the whole text of every row.

    ``und`` with score 0 for a null text, one without letters (numerals and
    marks are none), or without a network.  Texts of any length are read whole,
    window by window; of languages with equal scores the first by name is taken.
    Repeated rows get equal answers, an empty table gives no rows, and no other
    column is read."""
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            known = [network is not None and t is not None and any(map(str.isalpha, t)) for t in texts]
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            rows = [i for i, k in enumerate(known) if k]
            for lo in range(0, len(rows), 64):
                some = rows[lo:lo + 64]
                windows, sizes = windows_of([texts[i].encode() for i in some])
                p = network.probabilities(windows) * (_LETTERS[windows].sum(1) + np.float32(1e-3))[:, None]
                total = np.add.reduceat(p, np.concatenate(([0], np.cumsum(sizes)[:-1])), 0)
                total /= total.sum(1, keepdims=True)
                for i, best, row in zip(some, total.argmax(1), total, strict=True):
                    names[i], scores[i] = network.languages[best], min(1.0, float(row[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             ["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return predict(docs, fit(docs)).select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
