"""Exact Jaccard self-join of documents on word n-grams.

Documents with equal shingle sets are one node.  Two nodes that reach the
threshold have sizes within its ratio and share a shingle among the first few
of both in any common order (prefix filter).  The order puts shingles that are
known to be frequent last, so that shared lines and passages rarely make
candidates.  Per shared prefix shingle:

1. every member is compared with the smallest node (a star, linear in the
   group); the links found are joined into components;
2. groups that still hold several components are laid out in tiles by size
   band, hot groups in several tiles per band: there the largest component's rows
   meet the others only, not each other.  Tiles are gone through in rounds:
   a row hands on its few most promising pairs with other components, these are
   settled and components joined, so that most other pairs of the tile need no
   look any more; the next round hands on four times as many, until a round has
   left nothing out.  What rounds put out grows with the rows, not their pairs.

Both ways compare hashed bitmap signatures first: a shingle flips one bit, so
the number of different bits is at most the size of the symmetric difference,
which bounds the overlap from above.  Signatures grow with the set; the longer
of two is folded to the length of the other.  Stars and tiles carry a short form;
the pairs it allows are held against the long one, on which few differences meet.  What passes
is settled by exact intersection of the sorted shingle arrays, one star per
node first, and of the others only those that still lie between two components.  Arrays are made
once per node.  Every pair that reaches the threshold is compared or already lies in one component,
so the components are those of the full join, and no group is ever held or paired as a whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airlag.llm.bitmaps import bit_set
from airlag.llm.common import read_table, scratch, ship_package
from airlag.llm.components import components
from airlag.llm.words import Words, byte_chunks, mix, shingle_set

#: Default for near duplicates; the contract of the query names its own.
SHINGLE, PERCENT = 5, 80
#: Least length of a signature in 64-bit words.
SIGNATURE_WORDS = 16
#: Bits per shingle that sets at the threshold may differ in, for the short and the long form.
SHORT_BITS, LONG_BITS = 4.5, 18
#: A shingle is put last if it is found this often in one run of texts ...
LOCAL_REPEATS = 2
#: ... and this often over all runs.
FREQUENT = 4
RUN_SHINGLES = 4_000_000
TILE = 512
#: Growth of the pairs per row from round to round.
MORE_PAIRS = 4
#: Bytes of text shingled at once.
CHUNK = 1 << 20
#: Width of a size band in threshold ratios.
BAND = 4
_U64 = np.uint64


# ------------------------------------------------------------- in the tasks
def node_of(shingles: np.ndarray) -> np.uint64:
    """64-bit hash of a shingle set."""
    with np.errstate(over="ignore"):
        both = shingles.sum(dtype=_U64) ^ mix(np.bitwise_xor.reduce(shingles)[None])[0]
        return mix((both + _U64(len(shingles)))[None])[0]


def sign_words(n: int, percent: int, bits: float) -> int:
    """Length of a signature of ``n`` shingles: a power of two of 64-bit words."""
    words, wanted = SIGNATURE_WORDS, bits * 2 * n * (100 - percent) / (100 + percent)
    while 64 * words < wanted:
        words *= 2
    return words


def signature(shingles: np.ndarray, percent: int) -> np.ndarray:
    """Parity of the number of shingles on each bit, in the long form."""
    width = 64 * sign_words(len(shingles), percent, LONG_BITS)
    bits = np.bincount((shingles >> _U64(20)).astype(np.int64) & (width - 1), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(_U64)


def folded(sign: np.ndarray, words: int) -> np.ndarray:
    return sign if len(sign) == words else np.bitwise_xor.reduce(sign.reshape(-1, words), 0)


def most_apart(total, percent: int):
    """Largest symmetric difference of two sets of ``total`` shingles together that reach the threshold."""
    return total - 2 * -(-percent * total // (100 + percent))


def needed_overlap(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares at least with any partner."""
    return -(-percent * n // 100)


def shingle_sets(column: pa.Array, shingle: int):
    """(row, sorted shingles) of every text of an Arrow column, whole texts, A-Z in lower case."""
    texts = [(t or "").encode().lower() for t in column.to_pylist()]
    for lo, hi in byte_chunks(texts, CHUNK):
        words = Words(texts[lo:hi])
        for d in range(hi - lo):
            yield lo + d, shingle_set(words.hashes[words.of(d)], shingle)


def _count_repeats(shingle: int):
    def run(batches):
        held, size, nodes = [], 0, set()

        def flush():
            values, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, _U64), np.empty(0, np.int64))
            often = n >= LOCAL_REPEATS
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often].astype(np.int64))],
                                              ["shingle", "n"])
        for batch in batches:
            for _, s in shingle_sets(batch.column(0), shingle):
                if len(s) == 0 or (node := int(node_of(s))) in nodes:
                    continue
                nodes.add(node)
                held.append(s)
                size += len(s)
                if size >= RUN_SHINGLES:
                    yield flush()
                    held, size, nodes = [], 0, set()
        yield flush()
    return run


def _describe(shingle: int, percent: int, frequent):
    """Per document its node, size, prefix and signature; the prefix only for the first of equal sets in a batch."""
    def run(batches):
        hot = frequent.value
        for batch in batches:
            node, size, signs, longs, prefix, first, seen = [], [], [], [], [], [], set()
            for _, s in shingle_sets(batch.column(batch.num_columns - 1), shingle):
                n = len(s)
                size.append(n)
                key = int(node_of(s).view(np.int64)) if n else None
                node.append(key)
                first.append(n > 0 and key not in seen)
                long = signature(s, percent) if first[-1] else None
                longs.append(None if long is None else long.tobytes())
                signs.append(None if long is None else folded(long, sign_words(n, percent, SHORT_BITS)).tobytes())
                if first[-1]:
                    seen.add(key)
                    late = hot.has(s)
                    prefix.append(np.concatenate((s[~late], s[late]))[:n - needed_overlap(n, percent) + 1] >> _U64(16))
                else:
                    prefix.append(np.empty(0, _U64))
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(offsets, pa.array(
                np.concatenate([*prefix, np.empty(0, _U64)]).astype(np.int64)), mask=pa.array([not f for f in first]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(node, pa.int64()), pa.array(size, pa.int64()), lists,
                 pa.array(signs, pa.binary()), pa.array(longs, pa.binary())],
                [*batch.schema.names[:-1], "node", "n", "prefix", "sign", "long_sign"])
    return run


def _arrays_of(shingle: int, wanted):
    """Shingle arrays of the texts (``h``, ``text``) whose hash is wanted."""
    def run(batches):
        want = wanted.value
        for batch in batches:
            some = batch.filter(pa.array(want.has(batch.column(0).to_numpy().view(_U64)), pa.bool_()))
            nodes, arrays, seen = [], [], set()
            for _, s in shingle_sets(some.column(1), shingle):
                key = int(node_of(s).view(np.int64)) if len(s) else None
                if key is not None and key not in seen:
                    seen.add(key)
                    nodes.append(key)
                    arrays.append(s)
            offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*arrays, np.empty(0, _U64)]).view(np.int64)))],
                ["node", "shingles"])
    return run


def _may_reach(percent: int):
    """Pairs (a, b, n, m, two signatures) that the signatures allow."""
    def run(batches):
        for batch in batches:
            most = most_apart(batch.column(2).to_numpy() + batch.column(3).to_numpy(), percent)
            keep = []
            for x, y, limit in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), most.tolist(), strict=True):
                x, y = np.frombuffer(x, _U64), np.frombuffer(y, _U64)
                words = min(len(x), len(y))
                keep.append(int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= limit)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def _intersect(percent: int):
    """Pairs of which the sorted arrays reach the threshold."""
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
    return run


def _tile_pairs(percent: int, width: int):
    """Pairs of different components in a tile that the signatures allow: of
    every row the ``width`` most promising, other components first, each
    component's closest pair before its next.  ``more``: the row has others;
    rows (node, null) name all nodes that are in some pair.  side 0: the tile's
    own rows, compared with each other in tiles on the diagonal; 1: rows of
    another tile of the band or of the band below."""
    def run(batches):
        for batch in batches:
            out_a, out_b, out_more, met = [], [], [], []
            for diagonal, members in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                cols = {f: members.values.field(f).to_numpy() for f in ("side", "node", "comp", "n")}
                signs = [np.frombuffer(x, _U64) for x in members.values.field("sign").to_pylist()]
                words = min(len(x) for x in signs)
                signs = np.stack([folded(x, words) for x in signs])
                own = np.flatnonzero(cols["side"] == 0)
                other = np.flatnonzero(cols["side"] == 1)
                in_pair = np.zeros(len(signs), bool)
                for at, i in enumerate(own):
                    j = np.concatenate((other, own[at + 1:])) if diagonal else other
                    j = j[cols["comp"][j] != cols["comp"][i]]
                    if not len(j):
                        continue
                    most = most_apart(cols["n"][j] + cols["n"][i], percent)
                    apart = np.bitwise_count(signs[j] ^ signs[i]).sum(1).astype(np.int64)
                    ratio = 100 * np.minimum(cols["n"][j], cols["n"][i]) >= percent * np.maximum(cols["n"][j], cols["n"][i])
                    fits = (apart <= most) & ratio
                    j, slack = j[fits], (most - apart)[fits]
                    if not len(j):
                        continue
                    in_pair[j] = in_pair[i] = True
                    more = len(j) > width
                    if more:
                        order = np.lexsort((cols["node"][j], -slack, cols["comp"][j]))
                        comp = cols["comp"][j][order]
                        turn = np.arange(len(order)) - np.searchsorted(comp, comp)
                        j = j[order[np.lexsort((cols["node"][j][order], -slack[order], turn))[:width]]]
                    out_a.append(np.minimum(cols["node"][j], cols["node"][i]))
                    out_b.append(np.maximum(cols["node"][j], cols["node"][i]))
                    out_more.append(np.full(len(j), more))
                met.append(cols["node"][in_pair])
            none = np.empty(0, np.int64)
            met = np.unique(np.concatenate([none, *met]))
            a, b = np.concatenate([none, *out_a, met]), np.concatenate([none, *out_b, met])
            more = np.concatenate([np.empty(0, bool), *out_more, np.zeros(len(met), bool)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(b, mask=np.arange(len(b)) >= len(b) - len(met)), pa.array(more)], ["a", "b", "more"])
    return run


# ----------------------------------------------------------------- in Spark
def _stars(groups: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of every group's smallest node and another that may reach the threshold."""
    hubs = groups.groupBy("token").agg(F.min("node").alias("a"))
    pairs = (groups.join(hubs, "token").where(F.col("node") != F.col("a"))
             .select("a", F.col("node").alias("b")).distinct())
    return _allowed(pairs, nodes, "sign", percent)


def _allowed(pairs: DataFrame, nodes: DataFrame, sign: str, percent: int) -> DataFrame:
    """The pairs whose sizes and signatures (column ``sign``) allow the threshold."""
    left = nodes.select(F.col("node").alias("a"), "n", F.col(sign).alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col(sign).alias("y"))
    sized = pairs.join(left, "a").join(right, "b").where(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    return sized.select("a", "b", "n", "m", "x", "y").mapInArrow(_may_reach(percent), "a long, b long")


def _mixed(groups: DataFrame, comps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of groups with their component, and of the groups with several
    components the number of members (``size``), the largest component (``main``)
    and its number (``main_n``); of groups with the same members one is enough
    (the shingles of one passage)."""
    members = groups.where("g > 2").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    parts = members.groupBy("token", "comp").agg(
        F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("node")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("m2"))
    mixed = parts.groupBy("token").agg(
        F.count(F.lit(1)).alias("comps"), F.sum("c").alias("size"), F.max(F.struct("c", "comp")).alias("top"),
        F.bit_xor("m1").alias("m1"), F.bit_xor("m2").alias("m2")).where("comps > 1")
    mixed = mixed.groupBy("size", "m1", "m2").agg(F.min(F.struct("token", "top")).alias("x"))
    return members, mixed.select("x.token", "size", F.col("x.top.comp").alias("main"), F.col("x.top.c").alias("main_n"))


def _tiles(groups: DataFrame, nodes: DataFrame, comps: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs (a, b, more) of different components in one group that may reach
    the threshold, ``width`` a row, and (node, null) for all nodes in such pairs."""
    members, mixed = _mixed(groups, comps)
    hot = F.col("size") > TILE
    rows = members.join(mixed, "token").join(nodes.select("node", "n", "sign"), "node").withColumns({
        "step": F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)), "in_main": hot & (F.col("comp") == F.col("main")),
        "k": F.ceil(F.when(hot, F.col("size") - F.col("main_n")).otherwise(F.col("size")) / TILE).cast("int"),
        "k_main": F.when(hot, F.ceil(F.col("main_n") / TILE)).otherwise(0).cast("int")})
    # a band is BAND threshold ratios wide; the last of them (and a little more,
    # for rounding) has partners in the next band
    rows = rows.withColumns({"band": F.floor(F.col("step") / BAND).cast("int"), "high": F.pmod(F.col("step"), F.lit(float(BAND))) > BAND - 1.01})
    rows = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.when(F.col("in_main"), F.col("k_main")).otherwise(F.col("k"))).cast("int"))
    to = lambda k: F.filter(F.sequence(F.lit(-1), F.col(k) - 1), lambda i: i >= 0)
    tile = lambda main, band, i, j, side: F.struct(
        F.lit(main).alias("main"), band.alias("band"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    # outside the largest component of a hot group: rows meet each other ...
    own = F.transform(to("k"), lambda j: tile(False, F.col("band"), F.col("part"), j, 0))
    same = F.transform(F.filter(to("k"), lambda i: i < F.col("part")), lambda i: tile(False, F.col("band"), i, F.col("part"), 1))
    below = F.transform(F.filter(to("k"), lambda i: F.col("high")), lambda i: tile(False, F.col("band") + 1, i, F.col("part"), 1))
    # ... and its rows
    bands = F.when(F.col("high"), F.array("band", F.col("band") + 1)).otherwise(F.array("band"))
    out = F.flatten(F.transform(bands, lambda b: F.transform(to("k_main"), lambda j: tile(True, b, F.col("part"), j, 0))))
    main = F.flatten(F.transform(bands, lambda b: F.transform(to("k"), lambda i: tile(True, b, i, F.col("part"), 1))))
    dealt = rows.select("token", F.explode(F.when(F.col("in_main"), main).otherwise(F.concat(own, same, below, out))).alias("t"),
                        "node", "comp", "n", "sign")
    # a tile holds about three times TILE rows at most, by the hash
    tiles = dealt.groupBy("token", "t.main", "t.band", "t.i", "t.j").agg(
        F.collect_list(F.struct(F.col("t.side").alias("side"), "node", "comp", "n", "sign")).alias("members"))
    tiles = tiles.where((F.size("members") > 1) & F.exists("members", lambda m: m["side"] == 0))
    return tiles.select((~F.col("main") & (F.col("i") == F.col("j"))).alias("diagonal"), "members").mapInArrow(
        _tile_pairs(percent, width), "a long, b long, more boolean").groupBy("a", "b").agg(F.bool_or("more").alias("more"))


def _apart(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components."""
    of = lambda name: comps.select(F.col("node").alias(name), F.col("comp").alias(f"{name}_comp"))
    return (pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
            .where(F.coalesce("a_comp", "a") != F.coalesce("b_comp", "b")).select("a", "b"))


def _arrays(docs: DataFrame, nodes: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """``node, shingles`` of the asked nodes: of each one text is shingled again
    (a bit set of text hashes passes it)."""
    asked = scratch(asked.distinct(), "ngram-asked")
    wanted = bit_set(nodes.join(asked, "node", "left_semi"), "h")
    arrays = docs.select("h", "text").mapInArrow(_arrays_of(shingle, wanted), "node long, shingles array<long>")
    arrays = arrays.groupBy("node").agg(F.first("shingles").alias("shingles"))
    # stored, so that the join that follows may split the many pairs of one node
    return scratch(arrays.join(asked, "node", "left_semi"), "ngram-arrays")


def _links(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach the threshold by their shingle arrays."""
    left = arrays.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = arrays.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return scratch(pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(
        _intersect(percent), "a long, b long"), "ngram-links")


class _Search:
    """Links found so far, the components they make, pairs that are settled and
    shingle arrays of the nodes that were asked for."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, shingle: int, percent: int):
        self.docs, self.nodes, self.shingle, self.percent = docs, nodes, shingle, percent
        self.links = self.comps = self.tried = self.arrays = None

    def fetch(self, asked: DataFrame) -> None:
        if self.arrays is None:
            self.arrays = _arrays(self.docs, self.nodes, asked, self.shingle)
            return
        new = scratch(asked.distinct().join(self.arrays.select("node"), "node", "left_anti"), "ngram-new")
        if not new.isEmpty():
            self.arrays = self.arrays.unionByName(_arrays(self.docs, self.nodes, new, self.shingle))

    def settle(self, pairs: DataFrame) -> bool:
        """Settle those of the pairs that are not settled yet; whether there were any."""
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = scratch(pairs, "ngram-pairs")
        if pairs.isEmpty():
            if self.comps is None:
                self.links, self.tried, self.comps = pairs, pairs, components(pairs)
            return False
        allowed = scratch(_allowed(pairs, self.nodes, "long_sign", self.percent), "ngram-allowed")
        self.fetch(allowed.select(F.explode(F.array("a", "b")).alias("node")))
        links = _links(allowed, self.arrays, self.percent)
        self.links = links if self.links is None else self.links.unionByName(links)
        self.tried = pairs if self.tried is None else self.tried.unionByName(pairs)
        if self.comps is None or not links.isEmpty():
            self.comps = components(self.links)
        return True


def linked_rows(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
                text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """``doc_id``, the ``carry`` columns, ``n_shingles``, ``component`` for
    every row.  Rows have the same component exactly if links of similarity
    ``percent`` / 100 or more lead from one to the other; it is null for rows
    without words, which link with nothing.

    A null text has no words; a text of fewer words than a shingle is one
    shingle; repeated rows and equal sets share a component; an empty table
    gives no rows; other columns are ignored whatever their names."""
    spark = docs.sparkSession
    ship_package(spark)
    carry = carry or {}
    texts = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    repeats = texts.select("text").mapInArrow(_count_repeats(shingle), "shingle long, n long")
    frequent = bit_set(repeats.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT), "shingle")
    slim = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in carry.items()],
                       F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    rows = scratch(slim.mapInArrow(_describe(shingle, percent, frequent),
                                   f"{kept}, node long, n long, prefix array<long>, sign binary, long_sign binary"), "ngram-rows")
    nodes = scratch(rows.where("prefix is not null").groupBy("node").agg(
        F.min("h").alias("h"), *[F.first(c).alias(c) for c in ("n", "prefix", "sign", "long_sign")]), "ngram-nodes")
    tokens = nodes.select(F.explode("prefix").alias("token"), "node")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("g")).where("g > 1")
    groups = scratch(tokens.join(shared, "token"), "ngram-groups")

    stars = scratch(_stars(groups, nodes, percent), "ngram-stars")
    first = scratch(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "ngram-first")
    found = _Search(texts, nodes, shingle, percent)
    found.settle(first)
    found.settle(_apart(stars, found.comps))
    width, more = 1, True
    while more:
        offered = scratch(_tiles(groups, nodes, found.comps, percent, width), "ngram-offered")
        more = not offered.where("more").isEmpty()
        met = offered.where("b is null").select(F.col("a").alias("node"))  # later pairs are among these nodes
        if width == 1 and not met.isEmpty():
            found.fetch(met)
        found.settle(offered.where("b is not null").select("a", "b"))
        if more:
            groups = scratch(groups.join(met, "node", "left_semi"), "ngram-groups")
        width *= MORE_PAIRS
    comps = found.comps
    return rows.join(comps, "node", "left").select(
        "doc_id", *carry, F.col("n").alias("n_shingles"), F.coalesce("comp", "node").alias("component"))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``: the smallest id that links lead to; see ``linked_rows``."""
    rows = scratch(linked_rows(docs, shingle, percent, id_col, text_col), "ngram-members")
    least = scratch(rows.where("component is not null").groupBy("component").agg(
        F.min("doc_id").alias("component_id")), "ngram-classes")
    return rows.join(least, "component", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the row
    with the smallest id stays (then the smallest hash of id and text; of
    identical rows one).  Rows without words all stay."""
    keys = {"_k1": F.xxhash64(id_col, text_col), "_k2": F.xxhash64(text_col, id_col)}
    rows = scratch(linked_rows(docs, shingle, percent, id_col, text_col, carry=keys), "ngram-members")
    best = rows.where("component is not null").groupBy("component").agg(
        F.min(F.struct("doc_id", "_k1", "_k2")).alias("best"))
    stay = scratch(best.select("best._k1", "best._k2").unionByName(
        rows.where("component is null").select("_k1", "_k2").distinct()), "ngram-stay")
    kept = docs.withColumns(keys).join(stay, ["_k1", "_k2"], "left_semi")
    twice = rows.where("component is not null").groupBy("_k1", "_k2").count().where("count > 1")
    if not twice.isEmpty():
        wordless = F.coalesce(~F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
        kept = kept.withColumn("_k3", F.when(wordless, F.monotonically_increasing_id())).dropDuplicates(["_k1", "_k2", "_k3"])
    return kept.select(*docs.columns)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), shingle=3, percent=90)
