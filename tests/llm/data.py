"""Small tables with every odd case that the operators define."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau upsilon".split()

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as further columns of their input.
CLASHES = ["row", "size", "shard", "node", "n", "prefix", "s0", "k1", "k2", "bucket", "spans", "topic", "rate", "share",
           "component", "rule", "kept", "length", "block", "digest", "count"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def rows() -> list[tuple]:
    passage = prose(900, 60)
    near = prose(901, 300).split()
    out = [(i, prose(i, 40 + 13 * i % 260), ("en", "de", None)[i % 3], f"src{i % 3}", None) for i in range(1, 40)]
    out += [(100 + i, f"{prose(200 + i, 20)} {passage}\n{prose(300 + i, 90)}", "en", "src0", 5) for i in range(5)]
    out += [(200 + i, " ".join([*near[:10 * i], f"change{i}", *near[10 * i + 1:]]), "de", "src1", 7) for i in range(12)]
    out += [(300 + i, prose(77, 120), "en", "src0", 9) for i in range(6)]  # equal texts
    out += [(400, prose(88, 70), "en", None, 1)] * 4                       # repeated rows
    out += [(500, None, None, None, None), (501, "", "en", "src1", 0), (502, " \n\t ", "en", "src1", 4), (None, prose(99, 55), "de", "src1", 3),
            (503, "One two", "en", "src2", 7), (504, "one  TWO", "en", "src2", 8), (505, "Übung ÄÖ ß 你好  x  y 1 2 3", "de", "src2", 9),
            (506, "12 34 !!", "en", "src2", 8), (507, "a b " * 60, "en", "src2", 240), (508, "<|endoftext|> word's end\r\n\x0b\x0c\x1c\x85z", "en", "src2", 8)]
    out += [(600, prose(5000, 20_000), "en", "src0", 1)]                   # very long
    out += [(601, "x" * 30_000, "en", "src0", 1)]                          # one long word
    return out


def documents(spark, clashes: bool = True):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows(), DOCS).repartition(3)
    return df.select("*", *[F.lit("other").alias(c) for c in CLASHES]) if clashes else df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text) -> list[bytes]:
    return (text or "").encode().split()
