"""Fixed-size bit sets that tasks consult while they scan texts.

A set answers "certainly not" or "maybe" for 64-bit hashes.  It is built by
Spark's bitmap aggregates, its size is a parameter that does not depend on the
data, and operators use it only to leave out work whose result is known, never
to decide a result.  When the data outgrow it, more hashes count as maybe.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 16 MiB.
BITS = 1 << 27


class BitSet:
    def __init__(self, words: bytes, bits: int):
        self.words, self.bits = words, bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not self.words:
            return np.zeros(len(hashes), bool)
        at = hashes & np.uint64(self.bits - 1)
        byte = np.frombuffer(self.words, np.uint8)[(at >> np.uint64(3)).astype(np.int64)]
        return (byte >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0


def bit_set(df: DataFrame, col: str, bits: int = BITS):
    """Broadcast ``BitSet`` of the hashes in ``col``; ``bits`` a power of two of at least 2**15."""
    at = F.pmod(F.col(col), F.lit(bits)) + 1
    rows = (df.where(F.col(col).isNotNull()).select(at.alias("at"))
            .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("words")))
    out = bytearray()
    for r in rows.collect():  # bits / 2**15 rows of 4 KiB at most
        if not out:
            out = bytearray(bits // 8)
        lo = (r["bucket"] - 1) * 4096
        out[lo:lo + 4096] = r["words"]
    return df.sparkSession.sparkContext.broadcast(BitSet(bytes(out), bits))
