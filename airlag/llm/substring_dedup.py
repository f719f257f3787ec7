"""Exact removal of word windows that occur more than once in the corpus.

A window is a run of ``WINDOW`` words.  Its minimiser is the smallest hash of
the ``SEED`` -word runs inside it, so equal windows have equal minimisers, and
consecutive windows of a text mostly share theirs.  Such a stretch, a
super-k-mer, travels as one packed string to the bucket of its minimiser.  In
the bucket the windows of all strings are sorted and equal ones counted, word
for word.

Two things keep this linear.  A window cannot repeat unless its minimiser has a
second place in the corpus, so minimisers are counted first and super-k-mers
with a unique one stay at home (a bit set passes the others).  And a minimiser
of very many places (a frequent line in many contexts) would make a large
bucket; its windows travel one by one, each to the bucket of its own hash.
Equal strings of a batch travel once, and those of a task are added up before
they go to their bucket.  Buckets learn only strings and counts; which texts
hold a string is joined back afterwards, a hot string with salts, so a passage
with any number of holders is spread over the tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlag.llm.bitmaps import bit_set
from airlag.llm.common import read_table, salted_join, scratch, ship_package
from airlag.llm.words import Words, byte_chunks, shingle_hashes

WINDOW = 35
SEED = 10
#: Windows of a minimiser with more places travel one by one.
CROWDED = 1000
PACKED_BYTES = 4 << 20
_U64 = np.uint64


# ------------------------------------------------------------- in the tasks
def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    if len(x) < width:
        return x[:0]
    out, step = x, 1
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def super_kmers(words: np.ndarray, window: int, seed: int):
    """(minimiser, first window, windows, places) of a text's super-k-mers;
    ``places``: how often the minimiser occurs within the super-k-mer."""
    seeds = shingle_hashes(words, seed)
    width = window - seed + 1
    least = sliding_min(seeds, width)
    if not len(least):
        return least, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    count = np.diff(np.concatenate((first, [len(least)])))
    spans = count + width - 1
    at = np.concatenate(([0], np.cumsum(spans)))[:-1]
    inside = np.arange(spans.sum()) - np.repeat(at - first, spans)
    places = np.add.reduceat((seeds[inside] == np.repeat(least[first], spans)).astype(np.int64), at)
    return least[first], first, count, places


def _hashed(column: pa.Array):
    """(row, Words of a chunk, slice of the row's words) for every text of an Arrow column."""
    texts = [(t or "").encode() for t in column.to_pylist()]
    for lo, hi in byte_chunks(texts):
        words = Words(texts[lo:hi])
        for d in range(hi - lo):
            yield lo + d, words, words.of(d)


def _count_minimisers(window: int, seed: int):
    def run(batches):
        for batch in batches:
            keys, places = [np.empty(0, _U64)], [np.empty(0, np.int64)]
            for _, words, own in _hashed(batch.column(0)):
                least, _, _, n = super_kmers(words.hashes[own], window, seed)
                keys.append(least)
                places.append(n)
            values, where = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(where, np.concatenate(places), len(values)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(total)], ["bucket", "places"])
    return run


class _Packer:
    """Collects strings by bucket; equal ones of a batch once, with all their places."""

    def __init__(self):
        self.size, self.found = 0, {}

    def add(self, bucket: int, packed: bytes, k1: int, k2: int, start: int):
        held = self.found.get((bucket, packed))
        if held is None:
            self.found[bucket, packed] = held = []
            self.size += len(packed)
        held.append((k1, k2, start))
        self.size += 24

    def flush(self) -> pa.RecordBatch:
        places = list(self.found.values())
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in places]))).astype(np.int32)
        flat = np.array([x for p in places for x in p], np.int64).reshape(-1, 3)
        structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, i])) for i in range(3)], ["k1", "k2", "start"])
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.array([b for b, _ in self.found], _U64).view(np.int64)),
             pa.array([p for _, p in self.found], pa.binary()), pa.array([len(p) for p in places], pa.int64()),
             pa.ListArray.from_arrays(offsets, structs)], ["bucket", "packed", "n", "places"])
        self.size, self.found = 0, {}
        return out


def _cut(window: int, seed: int, shared, crowded):
    """Super-k-mers whose minimiser may have a second place, as packed strings."""
    def run(batches):
        second, many, packer = shared.value, crowded.value, _Packer()
        for batch in batches:
            k1s, k2s = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            plain, chunk = None, None
            for d, words, own in _hashed(batch.column(2)):
                if words is not chunk:  # white space as single bytes of 32, for slices
                    chunk, plain = words, words.buf.copy()
                    plain[(plain >= 9) & (plain <= 13)] = 32
                    plain = plain.tobytes()
                    lengths = words.ends - words.starts
                    ends_if_single = np.concatenate(([0], np.cumsum(lengths + 1)))
                hashes = words.hashes[own]
                least, first, count, _ = super_kmers(hashes, window, seed)
                go = np.flatnonzero(second.has(least))
                if not len(go):
                    continue
                crowd = many.has(least[go])
                single = shingle_hashes(hashes, window) if crowd.any() else None
                k1, k2, base = int(k1s[d]), int(k2s[d]), own.start

                def text_of(a: int, b: int) -> bytes:
                    s, e = int(words.starts[base + a]), int(words.ends[base + b - 1])
                    if e - s == int(ends_if_single[base + b] - ends_if_single[base + a]) - 1:
                        return plain[s:e]
                    return b" ".join(plain[s:e].split())

                for r, alone in zip(go.tolist(), crowd.tolist(), strict=True):
                    a, n = int(first[r]), int(count[r])
                    if alone:
                        for i in range(a, a + n):
                            packer.add(int(single[i]), text_of(i, i + window), k1, k2, i)
                    else:
                        packer.add(int(least[r]), text_of(a, a + n + window - 1), k1, k2, a)
                if packer.size >= PACKED_BYTES:
                    yield packer.flush()
        yield packer.flush()
    return run


def repeated_windows(strings: list[tuple[bytes, int]], window: int) -> list[np.ndarray]:
    """For every string of a bucket (with its number of places), which of its
    windows occur at least twice in the bucket: sort all windows, compare neighbours."""
    entries, marks = [], []
    for s, (packed, _) in enumerate(strings):
        ends = np.flatnonzero(np.frombuffer(packed, np.uint8) == 32).tolist()
        starts, ends = [0, *[e + 1 for e in ends]], [*ends, len(packed)]
        n = len(starts) - window + 1
        marks.append(np.zeros(n, bool))
        entries += [(packed[starts[i]:ends[i + window - 1]], s, i) for i in range(n)]
    entries.sort()
    i = 0
    while i < len(entries):
        j, places = i, 0
        while j < len(entries) and entries[j][0] == entries[i][0]:
            places += strings[entries[j][1]][1]
            j += 1
        if places > 1:
            for _, s, at in entries[i:j]:
                marks[s][at] = True
        i = j
    return marks


def _count_windows(window: int):
    """Input sorted by bucket and string: one bucket at a time, equal strings
    merged as they come.  Output: runs of repeated windows per string."""
    def run(batches):
        bucket, strings, ids = None, [], []
        out = []

        def settle():
            for (_, fp), marks in zip(ids, repeated_windows(strings, window), strict=True):
                edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
                out.extend((bucket, fp, int(a), int(b)) for a, b in zip(edges[0::2], edges[1::2], strict=True))

        def flush():
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["bucket", "fp", "lo", "hi"])
            out.clear()
            return batch

        for batch in batches:
            for b, fp, packed, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != bucket:
                    if strings:
                        settle()
                    bucket, strings, ids = b, [], []
                    if len(out) > 50_000:
                        yield flush()
                if strings and strings[-1][0] == packed:
                    strings[-1] = (packed, strings[-1][1] + n)
                else:
                    strings.append((packed, n))
                    ids.append((b, fp))
        if strings:
            settle()
        yield flush()
    return run


def _apply(with_text: bool, carried: int):
    """Removes the words of the spans: n_words, n_removed, kept_sha256, kept text."""
    def run(batches):
        for batch in batches:
            rows, texts = [], batch.column(carried).to_pylist()
            spans = batch.column(carried + 1)
            encoded = [(t or "").encode() for t in texts]
            for lo, hi in byte_chunks(encoded):
                words = Words(encoded[lo:hi], hashed=False)
                for d in range(lo, hi):
                    own = words.of(d - lo)
                    starts = words.starts[own] - words.offsets[d - lo]
                    ends = words.ends[own] - words.offsets[d - lo]
                    change = np.zeros(len(starts) + 1, np.int64)
                    if spans[d].is_valid:
                        v = spans[d].values
                        np.add.at(change, v.field(0).to_numpy(), 1)
                        np.add.at(change, v.field(1).to_numpy(), -1)
                    kept = np.cumsum(change[:-1]) == 0
                    text = encoded[d]
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], kept.astype(np.int8), [0]))))
                    runs = [text[starts[a]:ends[b - 1]] for a, b in zip(edges[0::2], edges[1::2], strict=True)]
                    digest = hashlib.sha256(b" ".join(b" ".join(r.split()) for r in runs)).hexdigest()
                    removed = int(len(kept) - kept.sum())
                    left = None
                    if with_text:
                        left = texts[d] if not removed else b"\n".join(runs).decode()
                    rows.append((len(kept), removed, digest, left))
            n, removed, digest, left = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:carried], pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(digest, pa.string()), pa.array(left, pa.string())],
                [*batch.schema.names[:carried], "n_words", "n_removed", "kept_sha256", "kept_text"])
    return run


# ----------------------------------------------------------------- in Spark
def repeated_spans(texts: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """``k1, k2, spans``: word ranges [lo, hi) covered by repeated windows, for
    the texts (``k1, k2, text``) that have any."""
    counted = texts.select("text").mapInArrow(_count_minimisers(window, seed), "bucket long, places long")
    counted = scratch(counted.groupBy("bucket").agg(F.sum("places").alias("places")).where("places > 1"), "minimisers")
    shared = bit_set(counted, "bucket")
    crowded = bit_set(counted.where(F.col("places") > CROWDED), "bucket")
    cut = texts.select("k1", "k2", "text").mapInArrow(
        _cut(window, seed, shared, crowded),
        "bucket long, packed binary, n long, places array<struct<k1:long,k2:long,start:long>>")
    packed = scratch(cut.withColumn("fp", F.xxhash64("packed")), "super-kmers", "zstd")
    strings = packed.groupBy("bucket", "fp", "packed").agg(F.sum("n").alias("n"))
    runs = scratch(strings.repartition("bucket").sortWithinPartitions("bucket", "packed")
                   .mapInArrow(_count_windows(window), "bucket long, fp long, lo long, hi long"), "repeats")
    held_by = scratch(packed.groupBy("bucket", "fp").agg(F.sum("n").alias("n")).where("n > 1"), "holders")
    total = packed.agg(F.sum("n")).first()[0] or 0
    held = salted_join(packed.select("bucket", "fp", "places"), runs, ["bucket", "fp"], held_by, total, "inner").select(
        F.explode("places").alias("p"), "lo", "hi")
    return held.groupBy("p.k1", "p.k2").agg(F.collect_set(F.struct(
        (F.col("p.start") + F.col("lo")).alias("lo"),
        (F.col("p.start") + F.col("hi") + window - 1).alias("hi"))).alias("spans"))


def _cleaned(docs: DataFrame, id_col: str, text_col: str, window: int, seed: int, columns: list[str], with_text: bool) -> DataFrame:
    ship_package(docs.sparkSession)
    key = [F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(text_col, id_col).alias("k2")]
    spans = scratch(repeated_spans(docs.select(*key, F.col(text_col).alias("text")), window, seed), "spans")
    row = F.struct(*[docs[c] for c in columns]).alias("row")
    joined = docs.select(*key, row, F.col(text_col).alias("text")).join(spans, ["k1", "k2"], "left").select("row", "text", "spans")
    kind = joined.schema["row"].dataType.simpleString()
    return joined.mapInArrow(_apply(with_text, 1), f"row {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")


def window_digests(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every row after all words
    covered by a repeated window are removed.

    All occurrences of a repeated window go, the first included; windows are
    judged on the input.  A null text or one of fewer words than a window loses
    nothing; repeated rows repeat each other; an empty table gives no rows;
    other columns are ignored whatever their names."""
    out = _cleaned(docs, id_col, text_col, window, seed, [id_col], False)
    return out.select(F.col("row")[id_col].alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``docs`` with the same rows and columns, texts without the words covered
    by repeated windows.  A text that loses nothing is unchanged; what is left
    of another is one line per remaining stretch; ``n_chars``, if there, is
    counted anew for these.  Null and short texts stay as they are; repeated rows
    are occurrences like others; an empty table gives no rows."""
    others = [c for c in docs.columns if c != text_col]
    out = _cleaned(docs, id_col, text_col, window, seed, others, True)
    cols = []
    for c in docs.columns:
        if c == text_col:
            cols.append(F.col("kept_text").alias(c))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            cols.append(F.when(F.col("n_removed") > 0, F.length("kept_text").cast(kind)).otherwise(F.col("row")[c]).alias(c))
        else:
            cols.append(F.col("row")[c].alias(c))
    return out.select(*cols)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_digests(read_table(spark, sf_dir, "documents"))
