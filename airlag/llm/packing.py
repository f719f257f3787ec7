"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents are tokenised once; those longer than a sequence are cut, and full
pieces need no packing.  The other pieces are dealt by a hash into blocks of
about ``BLOCK`` pieces.  On each block several islands evolve packings, a
packing being a grouping of pieces into bins: crossover injects whole
well-filled bins of one parent into the other, removes the bins that hold
duplicates and best-fits the displaced pieces; mutation dissolves poor bins.
Between epochs the best packing of every island migrates to the next island of
the block, through a Spark join of slim state rows.  After the last epoch the
pieces of all bins with room left, with those of some full bins
to combine them with, are dealt anew and evolved; that packing is taken if it
needs fewer sequences, and so on until a round gains nothing.
A round has a fraction of the blocks of the first one, so the bin that a block
cannot fill is lost in ever fewer blocks.

A block is a bounded number of lengths, so state rows are bounded, every block
evolves on its own, and the work grows with the number of pieces.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airlag.llm.common import read_table, scratch, ship_package
from airlag.llm.tokens import VOCABULARY, token_ids

CAPACITY = 1024
END_ID = 2
BLOCK = 1 << 14
ISLANDS = 2
POPULATION = 4
EPOCHS = 3
OFFSPRING = 8
#: Islands that a task evolves in an epoch.
TASK_ISLANDS = 2
#: Bins that are not full are dealt anew, with one in ``MIXED`` of the full ones.
MIXED = 8
#: Rounds of dealing anew: so many at most, and so many in a row that gain nothing.
ROUNDS, PATIENCE = 4, 1
#: Share of a parent's bins that a crossover injects.
INJECT = 0.15


# ------------------------------------------------------------------ one block
def best_fit(items, lengths, bins, fills, capacity):
    """Put items, in the given order, into the fullest bin that has room;
    ``bins`` (lists of items) and ``fills`` are extended in place.  Open bins
    are found by a bit per free length."""
    by_room, mask = {}, 0
    for b, fill in enumerate(fills):
        if fill < capacity:
            by_room.setdefault(capacity - fill, []).append(b)
            mask |= 1 << (capacity - fill)
    for i in items:
        need = lengths[i]
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            spots = by_room[room]
            b = spots.pop()
            if not spots:
                mask ^= 1 << room
            bins[b].append(i)
            fills[b] += need
            room -= need
        else:
            b, room = len(bins), capacity - need
            bins.append([i])
            fills.append(need)
        if room:
            spots = by_room.setdefault(room, [])
            if not spots:
                mask |= 1 << room
            spots.append(b)


def fitness(packing) -> tuple:
    bins, fills = packing
    return -len(bins), sum(f * f for f in fills)


def crossover(a, b, lengths, capacity, rng):
    """Child of ``a`` with whole well-filled bins of ``b``."""
    bins_b, fills_b = b
    n = max(1, int(len(bins_b) * INJECT))
    jitter = capacity // 16 + 1
    chosen = sorted(range(len(bins_b)), key=lambda x: -(fills_b[x] + rng.randrange(jitter)))[:2 * n]
    chosen = rng.sample(chosen, min(n, len(chosen)))
    injected = {i for x in chosen for i in bins_b[x]}
    bins, fills, displaced = [], [], []
    for bin_, fill in zip(*a, strict=True):
        if injected.isdisjoint(bin_):
            bins.append(list(bin_))
            fills.append(fill)
        else:
            displaced += [i for i in bin_ if i not in injected]
    for x in chosen:
        bins.append(list(bins_b[x]))
        fills.append(fills_b[x])
    best_fit(sorted(displaced, key=lambda i: -lengths[i]), lengths, bins, fills, capacity)
    return bins, fills


def mutate(packing, lengths, capacity, rng):
    """Dissolve the poorest bins and a few others, and best-fit their pieces."""
    bins, fills = packing
    order = sorted(range(len(bins)), key=lambda x: fills[x])
    out = set(order[:max(1, len(order) // 50)]) | set(rng.sample(order, max(1, len(order) // 50)))
    loose = [i for x in out for i in bins[x]]
    kept = [(bins[x], fills[x]) for x in range(len(bins)) if x not in out]
    bins, fills = [list(b) for b, _ in kept], [f for _, f in kept]
    best_fit(sorted(loose, key=lambda i: -(lengths[i] + rng.randrange(8))), lengths, bins, fills, capacity)
    return bins, fills


def to_packing(assignment, lengths):
    bins = [[] for _ in range(max(assignment) + 1)]
    for i, b in enumerate(assignment):
        bins[b].append(i)
    return bins, [sum(lengths[i] for i in b) for b in bins]


def to_assignment(packing, n):
    out = [0] * n
    for b, items in enumerate(packing[0]):
        for i in items:
            out[i] = b
    return out


def evolve(lengths, population, seed, capacity=CAPACITY, size=POPULATION, offspring=OFFSPRING):
    """One epoch on one island.  ``population``: packings as bin numbers per
    piece, or empty at the start.  Returns the population, best first."""
    rng, n = random.Random(seed), len(lengths)
    goal = -(-sum(lengths) // capacity)
    pool = [to_packing(a, lengths) for a in population]
    noise = 0
    while len(pool) < size:  # best fit decreasing, then with noise on the order
        bins, fills = [], []
        best_fit(sorted(range(n), key=lambda i: -(lengths[i] + (rng.randrange(noise) if noise else 0))),
                 lengths, bins, fills, capacity)
        pool.append((bins, fills))
        noise = noise * 2 or 16
    pool.sort(key=fitness, reverse=True)
    for turn in range(offspring):
        if len(pool[0][0]) == goal:
            break
        if turn % 4 == 3:
            child = mutate(pool[0], lengths, capacity, rng)
        else:
            a, b = rng.sample(pool, 2) if len(pool) > 1 else (pool[0], pool[0])
            child = crossover(a, b, lengths, capacity, rng)
        pool.append(child)
        pool.sort(key=fitness, reverse=True)
        del pool[size:]
    return [to_assignment(p, n) for p in pool[:size]]


# ---------------------------------------------------------------------- Spark
def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every document's ids with
    ``end_id`` after them; longer ones in pieces of ``capacity``, of which the
    first may be shorter."""
    ship_package(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                take, rows = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(token_ids(text or "", vocabulary), np.uint32(end_id)).astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        take.append(i)
                        rows.append((k, s, e - s, zlib.crc32(ids[s:e].tobytes())))
                k, s, n, crc = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(take, pa.int64())), pa.array(k, pa.int32()), pa.array(s, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])

    return slim.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


_STATE = "block long, island int, rows array<long>, lengths array<int>, population array<array<int>>"


def _epoch(state: DataFrame, epoch: int, capacity: int, tasks: int) -> DataFrame:
    def run(frames):
        for frame in frames:
            frame["population"] = [
                evolve([int(x) for x in lengths], [[int(b) for b in p] for p in population],
                       f"{block}/{island}/{epoch}", capacity)
                for block, island, lengths, population in zip(
                    frame["block"], frame["island"], frame["lengths"], frame["population"], strict=True)]
            yield frame
    # the state is small and its evolution is not: tasks are counted by islands, not by bytes
    return scratch(state.repartition(tasks, "block", "island").mapInPandas(run, _STATE), "packing-islands")


def pack_lengths(items: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS,
                 epochs: int = EPOCHS, turn: int = 0) -> DataFrame:
    """Pack ``items`` (``row`` long, unique; ``length`` from 1 to ``capacity``):
    ``row, length, block, bin, offset, fill``.  ``turn`` deals them otherwise."""
    n_blocks = max(1, round(items.count() / block))
    dealt = items.select(F.pmod(F.xxhash64("row", F.lit(n_blocks), F.lit(turn)), F.lit(n_blocks)).alias("block"), "row", "length")
    # a block has about `block` rows by the hash, whatever the data
    blocks = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("length")).alias("minus"), "row"))).alias("items"))
    state = blocks.select(
        "block", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.col("items.row").alias("rows"),
        F.transform("items", lambda x: (-x["minus"]).cast("int")).alias("lengths"),
        F.array().cast("array<array<int>>").alias("population"))
    tasks = -(-n_blocks * islands // TASK_ISLANDS)
    state = _epoch(state, 0, capacity, tasks)
    for epoch in range(1, epochs):
        # elite migration: the best packing of an island replaces the last one of the next island
        elite = state.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"),
                             F.slice("population", 1, 1).alias("elite"))
        moved = state.join(elite, ["block", "island"]).select(
            "block", "island", "rows", "lengths",
            F.concat("elite", F.slice("population", 1, POPULATION - 1)).alias("population"))
        state = _epoch(moved, epoch, capacity, tasks)
    best = state.select("block", "rows", "lengths", F.col("population")[0].alias("bins"), F.struct(
        (-F.array_max(F.col("population")[0])).alias("minus_bins"), F.col("island")).alias("rank"))
    best = best.groupBy("block").agg(F.max_by(F.struct("rows", "lengths", "bins"), "rank").alias("b"))
    placed = best.select("block", F.explode(F.arrays_zip("b.rows", "b.lengths", "b.bins")).alias("p")).select(
        "block", F.col("p.rows").alias("row"), F.col("p.lengths").alias("length"), F.col("p.bins").alias("bin"))
    inside = Window.partitionBy("block", "bin")  # at most `capacity` rows each
    return placed.withColumns({
        "offset": F.sum("length").over(inside.orderBy("row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"),
        "fill": F.sum("length").over(inside)})


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
                   end_id: int = END_ID, vocabulary: str = VOCABULARY, block: int = BLOCK,
                   islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """Sequences of at most ``capacity`` tokens: ``doc_id, piece, start,
    length, ids_crc32, sequence_id, offset``, a row per piece.

    A null or empty text is its end id alone.  Texts of any length are encoded
    whole and cut, runs of one character included.  Null ids and repeated rows
    are packed like any others, pieces of equal length in any order; an empty
    table gives no rows; other columns are ignored whatever their names."""
    cut = scratch(pieces(docs, id_col, text_col, capacity, end_id, vocabulary)
                  .withColumn("row", F.monotonically_increasing_id()), "packing-pieces")
    short = cut.where(F.col("length") < capacity).select("row", "length")
    number = lambda turn: (F.col("block") * F.lit(1 << 20) + F.col("bin")) * F.lit(ROUNDS + 1) + F.lit(turn)
    slim = ["row", "length", "sequence_id", "offset", "fill"]
    placed = scratch(pack_lengths(short, capacity, block, islands, epochs).withColumn("sequence_id", number(0)).select(slim), "packing-placed")
    bins = lambda d: d.agg(F.count(F.when(F.col("offset") == 0, 1))).first()[0]
    idle = 0
    for turn in range(1, ROUNDS + 1):
        loose = (F.col("fill") < capacity) | (F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(MIXED)) == 0)
        again = scratch(pack_lengths(placed.where(loose).select("row", "length"), capacity, block, islands, epochs, turn)
                        .withColumn("sequence_id", number(turn)).select(slim), "packing-again")
        if bins(again) < bins(placed.where(loose)):
            placed, idle = scratch(placed.where(~loose).unionByName(again), "packing-placed"), 0
        elif (idle := idle + 1) == PATIENCE:
            break
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    full = cut.where(F.col("length") == capacity).withColumns(
        {"sequence_id": -1 - F.col("row"), "offset": F.lit(0).cast("long")}).select(columns)
    return full.unionByName(
        cut.join(placed.select("row", "sequence_id", "offset"), "row").select(columns))


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
