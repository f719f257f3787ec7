"""Ranked lexical search for many queries at once, by shared sub-expressions.

A score is a sum over the query's terms, so queries that have terms in common
have parts of their sums in common.  These parts are found before the corpus is
scored and added up once per document:

1. one pass over the texts keeps, per document, its number of terms and how
   often it holds each term that any query of the block asks for; document
   counts and weights come from that table;
2. terms that the same queries ask for are one class, whose sum is needed only
   as a whole.  Of the classes that several queries ask for, the pair asked for
   by most queries becomes a new node, their sum, and stands for both in those
   queries, again and again until no pair is shared: a graph in which every node
   is the sum of two earlier ones;
3. a block of documents gets one accumulator row per node: the classes from the
   postings, the other nodes along the graph, each once, and every query adds
   the few nodes that are left to it.

Tasks keep the best documents of every query and drop all that cannot enter
them.  What a task holds depends on the queries of a block and ``DOCUMENTS``
documents; the results of tasks are merged in two steps, so no task gets more
than a small share of them.

Terms are known by a 64-bit hash of their bytes.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlag.llm.common import read_table, scratch, ship_package
from airlag.llm.words import byte_chunks, word_hashes, word_spans

TOP = 50
#: Queries scored in one pass over the postings; more of them are dealt into blocks.
QUERIES_AT_ONCE = 1024
#: Documents whose accumulators a task holds at once.
DOCUMENTS = 256
#: Of a query's shared classes so many (the most shared) are searched for pairs;
#: a query with more of them shares less work and has the same result.
PAIRED = 64
#: Tasks' results that meet in the first step of merging, in groups per query.
MERGE_GROUPS = 64

_TERM_BYTE = np.zeros(256, bool)
for _lo, _hi in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _TERM_BYTE[_lo:_hi + 1] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


# ------------------------------------------------------------- in the tasks
def terms_of(texts: list[bytes]):
    """Text number and hash of every term of a list of texts."""
    joined = _LOWER[np.frombuffer(b"\n".join(texts), np.uint8)]
    starts, ends = word_spans(joined, ~_TERM_BYTE)
    firsts = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return np.searchsorted(firsts, starts, "right") - 1, word_hashes(joined, starts, ends)


def _postings(asked):
    """Per document its number of terms, and the asked terms (by number) with their counts."""
    def run(batches):
        known = asked.value  # sorted
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            for lo, hi in byte_chunks(texts):
                text, hashes = terms_of(texts[lo:hi])
                n = np.bincount(text, minlength=hi - lo)
                at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                keys, tf = np.unique(text[hit] * len(known) + at[hit], return_counts=True)
                offsets = np.searchsorted(keys, np.arange(hi - lo + 1) * len(known)).astype(np.int32)
                lists = lambda x, kind: pa.ListArray.from_arrays(offsets, pa.array(x, kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()),
                     lists(keys % max(len(known), 1), pa.int32()), lists(tf, pa.int64())], ["doc_id", "n", "terms", "tfs"])
    return run


class Plan:
    """Classes of terms and the graph over them for a block of queries.

    ``class_of[term]``: its class; ``single[c]``: the only query that asks for
    class ``c``, or -1; rows of accumulators: shared classes first (``row_of``),
    then ``sums`` (row = row + row); ``rest[q]``: rows that query q adds up."""

    def __init__(self, queries: list[np.ndarray], n_terms: int):
        asked_by = defaultdict(list)
        for q, terms in enumerate(queries):
            for t in terms.tolist():
                asked_by[t].append(q)
        classes: dict[tuple, int] = {}
        self.class_of = np.zeros(n_terms, np.int64)
        for t, by in asked_by.items():
            self.class_of[t] = classes.setdefault(tuple(by), len(classes))
        self.single = np.array([by[0] if len(by) == 1 else -1 for by in classes], np.int64)
        shared = [(c, by) for by, c in classes.items() if len(by) > 1]
        self.row_of = np.full(len(classes), -1, np.int64)
        self.row_of[[c for c, _ in shared]] = np.arange(len(shared))
        self.n_rows, self.sums = len(shared), []
        holders = {r: set(by) for r, (_, by) in enumerate(shared)}
        self.rest = [set() for _ in queries]
        for r, by in holders.items():
            for q in by:
                self.rest[q].add(r)
        self._pair(holders)

    def _pair(self, holders: dict[int, set]) -> None:
        pairs: Counter = Counter()
        for rows in self.rest:
            few = sorted(heapq.nlargest(PAIRED, rows, key=lambda r: (len(holders[r]), -r)))
            pairs.update((a, b) for i, a in enumerate(few) for b in few[i + 1:])
        queue = [(-n, pair) for pair, n in pairs.items() if n > 1]
        heapq.heapify(queue)
        while queue:
            count, (a, b) = heapq.heappop(queue)
            both = holders[a] & holders[b]
            if len(both) != -count:  # counts only fall: look at the pair again in its turn
                if len(both) > 1:
                    heapq.heappush(queue, (-len(both), (a, b)))
                continue
            new, self.n_rows = self.n_rows, self.n_rows + 1
            self.sums.append((new, a, b))
            holders[a] -= both
            holders[b] -= both
            holders[new] = both
            with_new: Counter = Counter()
            for q in both:
                self.rest[q] -= {a, b}
                with_new.update(heapq.nlargest(PAIRED, self.rest[q], key=lambda r: (len(holders[r]), -r)))
                self.rest[q].add(new)
            for r, n in with_new.items():
                if n > 1:
                    heapq.heappush(queue, (-n, (r, new)))

    def scores(self, n_queries: int, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
        """Scores [query, document] of a block of documents from its postings."""
        out = np.zeros((n_queries, n_docs), np.int64)
        cls = self.class_of[term]
        one = self.single[cls]
        own = one >= 0
        np.add.at(out, (one[own], doc[own]), value[own])
        rows = np.zeros((self.n_rows, n_docs), np.int64)
        np.add.at(rows, (self.row_of[cls[~own]], doc[~own]), value[~own])
        for new, a, b in self.sums:
            np.add(rows[a], rows[b], out=rows[new])
        for q, left in enumerate(self.rest):
            for r in left:
                out[q] += rows[r]
        return out


def _div(a: int, values: np.ndarray, by: int) -> np.ndarray:
    """(a * value) div by, without overflow on the way."""
    if len(values) and a * int(values.max()) >= 1 << 63:
        return np.array([a * v // by for v in values.tolist()], np.int64)
    return a * values // by


def _best(query, doc_id, null, score, top: int):
    """The first ``top`` rows of each query: highest scores, then smallest ids, null ids last."""
    order = np.lexsort((doc_id, null, -score, query))
    query = query[order]
    first = np.searchsorted(query, query)
    return order[np.arange(len(order)) - first < top]


def _score(shared, top: int):
    """Postings to the best documents of a task for every query."""
    def run(batches):
        plan, weights, n_queries, n_all, l_all = shared.value
        least = np.zeros(n_queries, np.int64)  # a score below it cannot enter
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)]
        for batch in batches:
            for lo in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(lo, DOCUMENTS)
                ids, size = part.column(0), part.num_rows
                null = ids.is_null().to_numpy(zero_copy_only=False)
                ids = ids.fill_null(0).to_numpy().astype(np.int64)
                terms, tf = part.column(2).flatten().to_numpy(), part.column(3).flatten().to_numpy()
                doc = np.repeat(np.arange(size), part.column(2).value_lengths().to_numpy())
                m = 50 + _div(50 * n_all, part.column(1).to_numpy(), l_all)
                value = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
                scores = plan.scores(n_queries, doc, terms, value, size)
                query, at = np.nonzero((scores >= least[:, None]) & (scores > 0))
                held = [np.concatenate(x) for x in zip(held, (query, ids[at], null[at], scores[query, at]), strict=True)]
                if len(held[0]) > 2 * top * n_queries:
                    held = _cut(held, top)
                    full = np.bincount(held[0], minlength=n_queries) >= top
                    last = np.searchsorted(held[0], np.arange(n_queries), "right") - 1
                    least[full] = held[3][last[full]]
        query, doc_id, null, score = _cut(held, top)
        yield pa.RecordBatch.from_arrays(
            [pa.array(query, pa.int32()), pa.array(doc_id, mask=null), pa.array(score)], ["query", "doc_id", "score"])
    return run


def _cut(held, top):
    keep = _best(*held, top)
    return [x[keep] for x in held]


# ----------------------------------------------------------------- in Spark
def postings(docs: DataFrame, asked: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, terms, tfs`` of every document; ``asked``: sorted hashes of the terms to keep."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_postings(spark.sparkContext.broadcast(asked)), "doc_id long, n long, terms array<int>, tfs array<long>")


def _search_block(docs: DataFrame, queries: list[np.ndarray], top: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    asked = np.unique(np.concatenate([np.empty(0, np.uint64), *queries]))
    table = scratch(postings(docs, asked, id_col, text_col), "search-postings", "zstd")
    n_all, l_all = table.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held_by = dict(table.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # a row per asked term
    # a term that no document holds makes no posting, so its weight is never used
    weights = np.array([math.floor(1000 * math.log((2 * n_all + 2) / (2 * held_by.get(t, 0) + 1))) for t in range(len(asked))], np.int64)
    plan = Plan([np.searchsorted(asked, q) for q in queries], len(asked))
    shared = spark.sparkContext.broadcast((plan, weights, len(queries), n_all, max(l_all, 1)))
    scored = table.where(F.size("terms") > 0).mapInArrow(_score(shared, top), "query int, doc_id long, score long")
    scored = scored.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(MERGE_GROUPS)))
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    some = Window.partitionBy("query", "g").orderBy(*order)
    every = Window.partitionBy("query").orderBy(*order)
    return (scored.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top).drop("rank", "g")
            .withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= top))


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: for every row of ``items`` the ``top``
    documents with the highest scores above 0, equal scores by ascending id.

    The items are the queries: their terms go to the tasks in blocks of about
    ``QUERIES_AT_ONCE`` items.  Null and empty texts have no terms, so such
    items get no rows and such documents count for nothing; repeated rows are
    documents (or items) of their own; null ids come last among equal scores;
    texts are read whole; an empty table gives no rows; other columns are
    ignored whatever their names."""
    spark = docs.sparkSession
    ship_package(spark)
    slim = items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text"))
    blocks = max(1, -(-slim.count() // QUERIES_AT_ONCE))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    kind = slim.schema["item_id"].dataType.simpleString()
    out = None
    for b in range(blocks):
        rows = slim.where(block == b).orderBy("item_id", "text").collect()  # the queries of one block
        text, hashes = terms_of([(r["text"] or "").encode() for r in rows])
        queries = [np.unique(hashes[text == i]) for i in range(len(rows))]
        found = _search_block(docs, queries, top, id_col, text_col)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], f"query int, item_id {kind}")
        part = found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '{_TERMS}') AS terms FROM documents),
n AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM n),
i AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all({_LOW}, '{_TERMS}')) AS terms FROM benchmark),
q AS (SELECT q, item_id, unnest(terms) AS term FROM i),
tf AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(terms) AS term FROM d)
       WHERE term IN (SELECT term FROM q) GROUP BY r, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
part AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * nn) // ll)))) AS s
         FROM tf JOIN w USING (term) JOIN n USING (r), total),
score AS (SELECT q, item_id, r, doc_id, sum(s)::BIGINT AS score FROM q JOIN part USING (term) GROUP BY q, item_id, r, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
           FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {TOP}
"""
