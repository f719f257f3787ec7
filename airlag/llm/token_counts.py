"""Token counts of whole texts by a two-tier lookup in the tasks.

The tokenizer (byte-pair encoding with word ends) puts a text into lower case,
splits it into pre-tokens and encodes each by itself, so a text has as many
tokens as its pre-tokens have together.  Pre-tokens repeat far more than texts:

1. every task counts the pre-tokens of its documents in a summary of bounded
   size; the summaries are added up and the most frequent pre-tokens are encoded
   once, into a compact hash table of lengths that is broadcast (``TABLE``
   entries at most, whatever the corpus);
2. every task splits its documents again and looks all pre-tokens up in that
   table; those it lacks are encoded through a cache that the worker keeps, also
   from task to task (``CACHE`` entries at most).

No pre-token is shuffled, and what the table holds decides the work only, never
a count.  Pre-tokens of up to ``SHORT`` characters are known by a 64-bit hash of
their characters, longer ones by their characters.

The splitting is done on arrays of code points, for texts of characters whose
classes are settled (``_PLAIN``).  All others, and texts with the string of a
special token, are given to the library whole: rare scripts cost more time, the
result is the same.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlag.llm.common import read_table, ship_package
from airlag.llm.words import byte_chunks, mix, word_hashes

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Entries of the broadcast table: some 1.2 MB.
TABLE = 1 << 16
#: Pre-tokens in the summary of a task.
SUMMARY = 1 << 13
#: Entries of a worker's cache.
CACHE = 1 << 17
#: Longest pre-token known by its hash.
SHORT = 64
#: Characters split at once; bounds memory, not the length of a text.
CHUNK = 2 << 20

_PLAIN = "\x00-įı-ȹȻ-Ƚȿ-ɏ‐-‧€"
_UNUSUAL = re.compile(f"[^{_PLAIN}]")
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
# fixed values: white space among these characters, and the endings that the tokenizer splits off after an apostrophe
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0"
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def _characters():
    """Class and hash number of every code point up to the last plain one."""
    points = range(0x20AD)
    kinds = {"L": _LETTER, "N": _NUMBER}
    classes = [_SPACE if chr(c) in _BLANKS else kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in points]
    return np.array(classes, np.uint8), mix(np.arange(1, len(points) + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def pre_tokens(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of lower-case code points: an ending
    after an apostrophe, a run of letters, one numeral, a run of other characters."""
    classes = _characters()[0][points]
    edge = np.ones(len(points) + 1, bool)
    edge[1:-1] = (classes[1:] != classes[:-1]) | (classes[1:] == _NUMBER)
    padded = np.concatenate((points, np.zeros(2, points.dtype)))
    marks = np.flatnonzero((points == 39) & edge[:-1])
    for ending in _ENDINGS:
        found = marks
        for k, letter in enumerate(ending, 1):
            found = found[padded[found + k] == ord(letter)]
        edge[found + 1] = False
        edge[found + 1 + len(ending)] = True
    starts = np.flatnonzero(edge[:-1])
    ends = np.append(starts[1:], len(points))
    real = classes[starts] != _SPACE
    return starts[real], ends[real]


class Lengths:
    """Hash table of token counts by 64-bit hash, in open addressing."""

    def __init__(self, hashes: np.ndarray, lengths: np.ndarray):
        size = 1 << max(4, int(2 * len(hashes) - 1).bit_length())
        self.keys, self.lengths = np.zeros(size, np.uint64), np.zeros(size, np.uint16)
        at = hashes & np.uint64(size - 1)
        todo = np.arange(len(hashes))
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            _, first = np.unique(at[free], return_index=True)  # of those that meet on a slot one goes in
            put = free[first]
            self.keys[at[put]], self.lengths[at[put]] = hashes[put], lengths[put]
            todo = todo[self.keys[at[todo]] != hashes[todo]]
            at[todo] = (at[todo] + np.uint64(1)) & np.uint64(size - 1)

    def get(self, hashes: np.ndarray) -> np.ndarray:
        """Lengths; 0 for hashes that the table lacks."""
        out = np.zeros(len(hashes), np.int64)
        at, todo = hashes & np.uint64(len(self.keys) - 1), np.arange(len(hashes))
        while len(todo):
            keys = self.keys[at[todo]]
            hit = keys == hashes[todo]
            out[todo[hit]] = self.lengths[at[todo[hit]]]
            todo = todo[~hit & (keys != 0)]
            at[todo] = (at[todo] + np.uint64(1)) & np.uint64(len(self.keys) - 1)
        return out


def _distinct(texts: list[str]):
    """For plain texts: the text of each pre-token, and the distinct ones with
    their hash (0 for long ones), number and a function that gives their characters."""
    joined = "\n".join(texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts, ends = pre_tokens(points)
    hashes = word_hashes(points, starts, ends, _characters()[1])
    hashes[hashes == 0] = 1
    for i in np.flatnonzero(ends - starts > SHORT):  # few: known by their place, so each is looked at by itself
        hashes[i] = 0
    firsts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    text = np.searchsorted(firsts, starts, "right") - 1
    short = np.flatnonzero(hashes)
    values, first, inverse = np.unique(hashes[short], return_index=True, return_inverse=True)
    return (text, short, np.flatnonzero(hashes == 0), values, inverse,
            lambda i: joined[starts[i]:ends[i]], short[first])


def _plain(text: str | None, special: list[str]) -> bool:
    return not _UNUSUAL.search(text) and not any(s in text for s in special)


def _special(tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def _chunks(texts: list[str]):
    return byte_chunks(texts, CHUNK)


def _summaries(path: str):
    """Pre-tokens of a task and how often it met them: the most frequent ones of a bounded count."""
    def run(batches):
        special, seen = _special(_library(path)), {}
        for batch in batches:
            texts = [t for t in batch.column(0).to_pylist() if t and _plain(t, special)]
            for lo, hi in _chunks(texts):
                _, _, _, values, inverse, token, first = _distinct(texts[lo:hi])
                n = np.bincount(inverse, minlength=len(values))
                often = n > 1  # what a chunk holds once is not frequent
                for i, n in zip(first[often].tolist(), n[often].tolist(), strict=True):
                    word = token(i)
                    seen[word] = seen.get(word, 0) + n
                if len(seen) > 8 * SUMMARY:
                    seen = dict(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:4 * SUMMARY])
        top = [x for x in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:SUMMARY] if x[1] > 1]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())],
                                         ["token", "n"])
    return run


def hash_of(token: str) -> np.uint64:
    points = np.frombuffer(token.encode("utf-32-le"), np.uint32)
    h = word_hashes(points, np.array([0]), np.array([len(points)]), _characters()[1])[0]
    return h if h else np.uint64(1)


_SEEN: dict[str, dict[str, int]] = {}


def _cached(path: str, tokens: list[str]) -> list[int]:
    """Token counts of pre-tokens through the worker's cache."""
    seen = _SEEN.setdefault(path, {})
    new = list(dict.fromkeys(t for t in tokens if t not in seen))
    found = dict(zip(new, (len(e.ids) for e in _library(path).encode_batch(new, add_special_tokens=False)), strict=True))
    out = [seen[t] if t in seen else found[t] for t in tokens]
    if len(seen) + len(found) > CACHE:
        seen.clear()
    seen.update((t, n) for t, n in found.items() if len(t) <= SHORT)
    return out


def _count(path: str, table):
    def run(batches):
        lengths, library = table.value, _library(path)
        special = _special(library)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            n = np.zeros(len(texts), np.int64)
            plain = []
            for i, t in enumerate(texts):
                if t and _plain(t, special):
                    plain.append(i)
                elif t:
                    n[i] = len(library.encode(t, add_special_tokens=False).ids)
            for lo, hi in _chunks([texts[i] for i in plain]):
                some = np.array(plain[lo:hi])
                text, short, long, values, inverse, token, first = _distinct([texts[i] for i in some])
                each = lengths.get(values)
                missed = np.flatnonzero(each == 0)
                each[missed] = _cached(path, [token(i) for i in first[missed].tolist()])
                n[some] += np.bincount(text[short], each[inverse], hi - lo).astype(np.int64)
                if len(long):
                    np.add.at(n, some[text[long]], _cached(path, [token(i) for i in long.tolist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], [*batch.schema.names[:-1], "n_tokens"])
    return run


def frequent_lengths(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, size: int = TABLE):
    """Broadcast ``Lengths`` of the ``size`` most frequent pre-tokens."""
    import public_tokenizers
    spark, path = docs.sparkSession, public_tokenizers.path(vocabulary)
    ship_package(spark)
    met = docs.select(F.col(text_col).alias("text")).mapInArrow(_summaries(path), "token string, n long")
    top = met.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(size).select("token")
    tokens = [r[0] for r in top.collect()]  # `size` rows of at most SHORT characters
    counts = np.array(_cached(path, tokens), np.uint16)
    hashes, first = np.unique(np.array([hash_of(t) for t in tokens], np.uint64), return_index=True)
    return spark.sparkContext.broadcast(Lengths(hashes, counts[first]))


def count_tokens(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text",
                 vocabulary: str = VOCABULARY, table: int = TABLE) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row: the UTF-8 bytes
    and the tokens of the whole text, as the library gives them without added
    special tokens, and whether there are more than ``limit``.

    A null text counts as an empty one, 0 bytes and 0 tokens; null ids and
    repeated rows are counted like any others; texts of any length are split
    whole, long pre-tokens by themselves; an empty table gives no rows; other
    columns are ignored whatever their names."""
    import public_tokenizers
    lengths = frequent_lengths(docs, text_col, vocabulary, table)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                       F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    counted = slim.mapInArrow(_count(public_tokenizers.path(vocabulary), lengths), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))
