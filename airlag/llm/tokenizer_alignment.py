"""Alignment of two tokenizers over a corpus, with counts of aligned id pairs.

Both tokenizers cover the same bytes (a space and the text).  Byte offsets where
tokens of both end cut them into groups; two tokens are linked if their byte
ranges overlap, and an id pair's count is the number of links in the corpus that
hold it.

1. The ids of every text are stored once, as narrow numbers.
2. A first pass aligns the documents and leaves every task's distinct id pairs
   with their counts.  The distinct pairs of the corpus are dealt by a hash into
   buckets of about ``BUCKET``; each bucket gets a minimal perfect hash, so a
   pair's count has a place in a dense vector of the bucket, without its key.
   Tasks add their counts into such vectors, and vectors are summed in a tree of
   ``FAN_IN``, until one is left per bucket.
3. A second pass aligns the documents again and looks every pair up: perfect
   hash, verification of the key at that place, count.

The table of the second pass is broadcast and holds ``MAX_PAIRS`` pairs at most
(some 40 MB).  If a corpus has more, it holds those with the highest counts, and
the links of other pairs, all rare, find their counts in a join by pair.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlag.llm import perfect_hash
from airlag.llm.common import read_table, scratch, ship_package
from airlag.llm.tokens import token_ids
from airlag.llm.words import byte_chunks, mix

BYTE_VOCABULARY = "byte_bpe_50k"
PIECE_VOCABULARY = "piece_bpe_32k.model"
BUCKET = 1 << 13
FAN_IN = 16
MAX_PAIRS = 1 << 21
#: Bytes of text aligned at once.
CHUNK = 1 << 20
#: Distinct pairs that a task holds before it hands them on.
HELD = 1 << 21


# ------------------------------------------------------------ vocabularies
@lru_cache(maxsize=2)
def _pieces(path: str):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def byte_entries(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level vocabulary.  Printable Latin characters
    stand for their own byte, the other bytes in order for U+0100 and up."""
    from tokenizers import Tokenizer
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in own}
    byte_of |= {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=False)
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        out[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return out


@lru_cache(maxsize=2)
def piece_entries(path: str) -> list[bytes]:
    """Bytes of every id of a piece vocabulary."""
    sp = _pieces(path)
    return [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
            for i in range(sp.get_piece_size())]


class Vocabularies:
    """Sizes and entries of the two vocabularies (A: byte-level, B: pieces)."""

    def __init__(self, a: str = BYTE_VOCABULARY, b: str = PIECE_VOCABULARY):
        import public_tokenizers
        self.a, self.b_path = a, public_tokenizers.path(b)
        self.a_bytes, self.b_bytes = byte_entries(public_tokenizers.path(f"{a}.json")), piece_entries(self.b_path)
        self.a_sizes = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_sizes = np.array([len(x) for x in self.b_bytes], np.int64)
        self.a_kind, self.b_kind = (np.dtype("<u2" if len(x) <= 1 << 16 else "<u4") for x in (self.a_bytes, self.b_bytes))

    def encode(self, texts: list[str]):
        """Ids of both for each text, both empty where there are no tokens."""
        for text, b in zip(texts, _pieces(self.b_path).encode(texts, num_threads=1), strict=True):
            a, both = token_ids(" " + text, self.a), b" " + text.encode()
            fits = (bool(text) and b"".join(map(self.b_bytes.__getitem__, b)) == both
                    and b"".join(map(self.a_bytes.__getitem__, a.tolist())) == both)
            yield (a.astype(self.a_kind), np.array(b, self.b_kind)) if fits else (a[:0].astype(self.a_kind), np.array([], self.b_kind))

    def names(self) -> list[str]:
        """Ids as decimal text with what follows them: A with a comma, A with a bar, B with a comma, B with a semicolon."""
        return [f"{i}{end}" for n, ends in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for end in ends for i in range(n)]


@lru_cache(maxsize=2)
def vocabularies(a: str, b: str) -> Vocabularies:
    return Vocabularies(a, b)


@lru_cache(maxsize=2)
def _names(a: str, b: str) -> list[str]:
    return vocabularies(a, b).names()


class Aligned:
    """Alignment of a run of documents, given their ids in one array per tokenizer
    and the number of ids of each document."""

    def __init__(self, v: Vocabularies, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.a, self.b = a.astype(np.int64), b.astype(np.int64)
        self.doc_a = np.repeat(np.arange(len(n_a)), n_a)
        self.doc_b = np.repeat(np.arange(len(n_b)), n_b)
        ends_a, ends_b = np.cumsum(v.a_sizes[self.a]), np.cumsum(v.b_sizes[self.b])
        # documents cover the same bytes in both, so their ends are common ends of the whole run
        ends = np.union1d(ends_a, ends_b)
        link_a, link_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        self.pairs = self.a[link_a] * len(v.b_bytes) + self.b[link_b]
        self.doc = self.doc_a[link_a]
        self.b_last, self.a_last = np.isin(ends_b, ends_a, assume_unique=True), np.isin(ends_a, ends_b, assume_unique=True)

    def groups(self, n_docs: int) -> np.ndarray:
        return np.bincount(self.doc_a[self.a_last], minlength=n_docs)

    def spelled(self, v: Vocabularies, names: list[str], n_docs: int) -> list[str]:
        """Per document ``a1,a2|b1;a3|b2,b3``."""
        group_a = np.cumsum(self.a_last) - self.a_last
        group_b = np.cumsum(self.b_last) - self.b_last
        # a token's place in the written order: all A of its group and before, and B of the groups before
        at_a = np.arange(len(self.a)) + np.searchsorted(group_b, group_a)
        at_b = np.arange(len(self.b)) + np.searchsorted(group_a, group_b, "right")
        order = np.empty(len(self.a) + len(self.b), np.int64)
        order[at_a] = self.a + self.a_last * len(v.a_bytes)
        order[at_b] = self.b + self.b_last * len(v.b_bytes) + 2 * len(v.a_bytes)
        words = list(map(names.__getitem__, order.tolist()))
        cuts = np.concatenate(([0], np.cumsum(np.bincount(self.doc_a, minlength=n_docs) + np.bincount(self.doc_b, minlength=n_docs)))).tolist()
        return ["".join(words[lo:hi])[:-1] for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _encode(a: str, b: str):
    """(row, doc_id, text) to (row, doc_id, ids of A, ids of B)."""
    def run(batches):
        v = vocabularies(a, b)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for lo, hi in byte_chunks(texts, CHUNK):
                ids_a, ids_b = zip(*v.encode(texts[lo:hi]), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo),
                     pa.array([x.tobytes() for x in ids_a], pa.binary()), pa.array([x.tobytes() for x in ids_b], pa.binary())],
                    ["row", "doc_id", "a", "b"])
    return run


def _runs(batch: pa.RecordBatch, v: Vocabularies):
    """Alignments of the runs of rows of a batch of stored ids: (rows, numbers of ids, Aligned)."""
    a, b = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
    for lo, hi in byte_chunks([x + y for x, y in zip(a, b, strict=True)], CHUNK):
        n_a = np.array([len(x) for x in a[lo:hi]], np.int64) // v.a_kind.itemsize
        n_b = np.array([len(x) for x in b[lo:hi]], np.int64) // v.b_kind.itemsize
        yield lo, hi, n_a, n_b, Aligned(v, np.frombuffer(b"".join(a[lo:hi]), v.a_kind), np.frombuffer(b"".join(b[lo:hi]), v.b_kind), n_a, n_b)


def _hash(pairs: np.ndarray) -> np.ndarray:
    return mix(pairs.astype(np.uint64)).view(np.int64)


def _count_pairs(a: str, b: str):
    """Stored ids to (pair, h, n): a task's distinct pairs with their counts."""
    def run(batches):
        v, held = vocabularies(a, b), []

        def merged():
            pairs = np.concatenate([np.empty(0, np.int64), *[x for x, _ in held]])
            values, inverse = np.unique(pairs, return_inverse=True)
            n = np.zeros(len(values), np.int64)
            np.add.at(n, inverse, np.concatenate([np.empty(0, np.int64), *[y for _, y in held]]))
            return values, n

        def out(values, n):
            return pa.RecordBatch.from_arrays([pa.array(values), pa.array(_hash(values)), pa.array(n)], ["pair", "h", "n"])
        size = 0
        for batch in batches:
            for *_, aligned in _runs(batch, v):
                held.append(np.unique(aligned.pairs, return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield out(*held[0])
                        held, size = [], 0
        yield out(*merged())
    return run


# ------------------------------------------------------- counts by perfect hash
def _build_bucket(group: pa.Table) -> pa.Table:
    keys = group.column("pair").to_numpy()
    levels, numbers = perfect_hash.build(keys.astype(np.uint64))
    placed = np.empty(len(keys), np.int64)
    placed[numbers] = keys
    return pa.table({"bucket": group.column("bucket").slice(0, 1), "levels": pa.array([levels], pa.list_(pa.binary())),
                     "keys": pa.array([placed.tobytes()], pa.binary())})


def _add_up(counts: pa.Table, mph: pa.Table) -> pa.Table:
    """Dense vector of a bucket from some tasks' counts."""
    table = perfect_hash.PerfectHash(mph.column("levels")[0].as_py())
    dense = np.zeros(table.size, np.int64)
    np.add.at(dense, table.numbers(counts.column("pair").to_numpy().astype(np.uint64)), counts.column("n").to_numpy())
    return pa.table({"bucket": mph.column("bucket"), "salt": mph.column("salt"), "dense": pa.array([dense.tobytes()], pa.binary())})


def _sum_vectors(group: pa.Table) -> pa.Table:
    dense = np.sum([np.frombuffer(x, np.int64) for x in group.column("dense").to_pylist()], axis=0)
    return pa.table({"bucket": group.column("bucket").slice(0, 1), "salt": group.column("salt").slice(0, 1),
                     "dense": pa.array([dense.tobytes()], pa.binary())})


_BUCKET_TABLE = "bucket long, levels array<binary>, keys binary"
_VECTOR = "bucket long, salt long, dense binary"


def _hashed(pairs: DataFrame, n_buckets: int) -> DataFrame:
    """A minimal perfect hash for each bucket of ``pairs`` (``pair``, ``h``; distinct)."""
    dealt = pairs.select(F.pmod("h", F.lit(n_buckets)).alias("bucket"), "pair")
    return dealt.groupBy("bucket").applyInArrow(_build_bucket, _BUCKET_TABLE)


def pair_counts(partials: DataFrame) -> tuple[DataFrame, int, int]:
    """Corpus-wide counts from the tasks' ones: a stored row (``bucket, levels,
    keys, dense``) per bucket, the number of buckets and of pairs."""
    distinct = scratch(partials.select("pair", "h").distinct(), "alignment-pairs")
    n_pairs = distinct.count()
    n_buckets = max(1, round(n_pairs / BUCKET))
    tables = scratch(_hashed(distinct, n_buckets), "alignment-hash")
    salts = -(-max(1, partials.rdd.getNumPartitions()) // FAN_IN)
    dealt = partials.select(F.pmod("h", F.lit(n_buckets)).alias("bucket"),
                            F.pmod(F.spark_partition_id(), F.lit(salts)).cast("long").alias("salt"), "pair", "n")
    of_salt = tables.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), "levels")
    keys = ["bucket", "salt"]
    used = of_salt.join(dealt.select(*keys).distinct(), keys, "left_semi")
    vectors = scratch(dealt.groupBy(*keys).cogroup(used.groupBy(*keys)).applyInArrow(_add_up, _VECTOR), "alignment-vectors", "zstd")
    while salts > 1:
        salts = -(-salts // FAN_IN)
        fewer = vectors.withColumn("salt", F.pmod("salt", F.lit(salts)).cast("long"))
        vectors = scratch(fewer.groupBy(*keys).applyInArrow(_sum_vectors, _VECTOR), "alignment-vectors", "zstd")
    return scratch(tables.join(vectors.select("bucket", "dense"), "bucket"), "alignment-counts", "zstd"), n_buckets, n_pairs


def _rows(batches):
    """Bucket rows to (pair, h, n)."""
    for batch in batches:
        for keys, dense in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            pairs = np.frombuffer(keys, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(_hash(pairs)), pa.array(np.frombuffer(dense, np.int64))],
                                             ["pair", "h", "n"])


class Counts:
    """The broadcast table: per bucket a perfect hash, keys to verify, counts."""

    def __init__(self, rows, n_buckets: int):
        self.n_buckets = n_buckets
        self.buckets = {r["bucket"]: (perfect_hash.PerfectHash([bytes(x) for x in r["levels"]]),
                                      np.frombuffer(r["keys"], np.int64), np.frombuffer(r["dense"], np.int64)) for r in rows}

    def get(self, pairs: np.ndarray) -> np.ndarray:
        """Counts; 0 for pairs that the table lacks."""
        out = np.zeros(len(pairs), np.int64)
        bucket = _hash(pairs) % self.n_buckets
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)).tolist():
            if k not in self.buckets:
                continue
            table, keys, dense = self.buckets[k]
            at = order[cuts[k]:cuts[k + 1]]
            number = table.numbers(pairs[at].astype(np.uint64))
            known = (number >= 0) & (keys[number] == pairs[at])
            out[at[known]] = dense[number[known]]
        return out


def _look_up(a: str, b: str, counts, best):
    """Stored ids to the rows of documents; links of pairs outside the table are handed on."""
    def run(batches):
        v, names, table, highest = vocabularies(a, b), _names(a, b), counts.value, best.value
        for batch in batches:
            for lo, hi, n_a, n_b, aligned in _runs(batch, v):
                size = hi - lo
                pairs, inverse = np.unique(aligned.pairs, return_inverse=True)
                n = table.get(pairs)
                top = (n > 0) & (n == highest[pairs % len(v.b_bytes)])
                sums = np.zeros(size, np.int64)
                np.add.at(sums, aligned.doc, n[inverse])
                outside = n[inverse] == 0
                far, often = np.unique(aligned.doc[outside] * len(pairs) + inverse[outside], return_counts=True)
                offsets = np.searchsorted(far, np.arange(size + 1) * len(pairs)).astype(np.int32)
                missed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(
                    [pa.array(pairs[far % max(len(pairs), 1)]), pa.array(often.astype(np.int64))], ["pair", "links"]))
                shas = [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in aligned.spelled(v, names, size)]
                count = lambda x: pa.array(np.asarray(x, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, size), batch.column(1).slice(lo, size), count(n_a), count(n_b),
                     count(aligned.groups(size)), count(np.bincount(aligned.doc, minlength=size)),
                     count(np.bincount(aligned.doc[top[inverse]], minlength=size)), count(sums), pa.array(shas, pa.string()), missed],
                    ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "missed"])
    return run


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = BYTE_VOCABULARY, b: str = PIECE_VOCABULARY) -> DataFrame:
    """``row, doc_id, a, b``: ids of both tokenizers as little-endian numbers."""
    ship_package(docs.sparkSession)
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(_encode(a, b), f"row long, doc_id {kind}, a binary, b binary")


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str = BYTE_VOCABULARY,
                     b: str = PIECE_VOCABULARY, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``
    for every row.

    Null and empty texts, and texts whose tokens do not spell a space and the
    text, have no tokens: zeros and an empty digest.  Null ids and repeated rows
    are documents like any others; texts are encoded whole; an empty table gives
    no rows; of pairs with equal highest counts each is a B id's best; other
    columns are ignored whatever their names."""
    spark = docs.sparkSession
    ids = scratch(encoded(docs, id_col, text_col, a, b), "alignment-ids", "zstd")
    kind = ids.schema["doc_id"].dataType.simpleString()
    partials = scratch(ids.select("a", "b").mapInArrow(_count_pairs(a, b), "pair long, h long, n long"), "alignment-partials", "zstd")
    tables, n_buckets, n_pairs = pair_counts(partials)
    counts = tables.select("keys", "dense").mapInArrow(_rows, "pair long, h long, n long")
    n_b = len(vocabularies(a, b).b_bytes)
    highest = np.zeros(n_b, np.int64)
    for r in counts.groupBy(F.pmod("pair", F.lit(n_b)).alias("b")).agg(F.max("n").alias("n")).collect():  # an entry of B each
        highest[r["b"]] = r["n"]
    table = tables
    if n_pairs > max_pairs:
        # rows by the power of two that a count reaches: 64 at most
        reach = {r["k"]: r["count"] for r in counts.groupBy(F.floor(F.log2("n")).alias("k")).count().collect()}
        least = next(k for k in range(65) if sum(n for x, n in reach.items() if x >= k) <= max_pairs)
        frequent = scratch(counts.where(F.floor(F.log2("n")) >= least), "alignment-frequent")
        n_buckets = max(1, round(frequent.count() / BUCKET))
        again = _hashed(frequent, n_buckets).withColumn("salt", F.lit(0).cast("long"))
        dealt = frequent.select(F.pmod("h", F.lit(n_buckets)).alias("bucket"), F.lit(0).cast("long").alias("salt"), "pair", "n")
        vectors = dealt.groupBy("bucket", "salt").cogroup(again.groupBy("bucket", "salt")).applyInArrow(_add_up, _VECTOR)
        table = again.drop("salt").join(vectors.select("bucket", "dense"), "bucket")
    shared = spark.sparkContext.broadcast(Counts(table.collect(), n_buckets))  # max_pairs keys and counts at most
    out = ids.mapInArrow(
        _look_up(a, b, shared, spark.sparkContext.broadcast(highest)),
        f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
        "groups_sha256 string, missed array<struct<pair: bigint, links: bigint>>")
    if n_pairs > max_pairs:
        out = scratch(out, "alignment-rows")
        rare = out.select("row", F.explode("missed").alias("m")).select("row", "m.pair", "m.links")
        best = spark.createDataFrame(enumerate(highest.tolist()), "b long, most long")
        found = rare.join(counts.select("pair", "n"), "pair").join(F.broadcast(best), F.pmod("pair", F.lit(n_b)) == F.col("b"))
        more = found.groupBy("row").agg(F.sum(F.when(F.col("n") == F.col("most"), F.col("links"))).alias("more_best"),
                                        F.sum(F.col("n") * F.col("links")).alias("more_sum"))
        out = out.join(more, "row", "left").withColumns({
            "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
            "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0))})
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(read_table(spark, sf_dir, "documents"))
