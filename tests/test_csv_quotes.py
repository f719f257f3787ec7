"""CSV records whose quoted fields hold line breaks, cut into splits of any size."""

import csv
import io

import pandas as pd
import pytest

from airlag import schema as S
from airlag.sources.csv_ingest import combine_monthly_csv, ends_inside
from pyspark.sql import functions as F


def read(spark, folder, size):
    keys = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    old = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        return combine_monthly_csv(spark, folder).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


NAMES = [S.ORIGINAL_NAMES[c] for c in S.RAW_COLS]
TEXT = next(i for i, f in enumerate(S.RAW_SCHEMA.fields) if i > 3 and f.dataType.typeName() == "string")


def month(values) -> str:
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(NAMES)
    for i, v in enumerate(values):
        w.writerow(["AA", f"01/{i + 1:02d}/2024", *["1" if f.dataType.typeName() != "string" else "x" for f in S.RAW_SCHEMA.fields[2:]]])
    text = out.getvalue().split("\n")
    for i, v in enumerate(values):
        row = text[i + 1].split(",")
        row[TEXT] = v
        text[i + 1] = ",".join(row)
    return "\n".join(text)


VALUES = ["plain", '"two\nlines"', '"a ""quoted""\n\n\nword, and ""\n"', 'inch 5" mark', '"x,\n"', '""', '"\n,AA,\n"', "last"]


@pytest.mark.parametrize("size", [9, 31, 64, 150, 100_000])
def test_quoted_line_breaks(spark, tmp_path, size):
    (tmp_path / "a.csv").write_text('A "report\n' + month(VALUES))
    (tmp_path / "b.csv").write_text(month(["b1", "b2"]))
    want = pd.concat([pd.read_csv(io.StringIO(month(v)), dtype=str) for v in (VALUES, ["b1", "b2"])])
    want = {(r[NAMES[1]], None if pd.isna(r[NAMES[TEXT]]) else r[NAMES[TEXT]]) for _, r in want.iterrows()}
    rows = read(spark, str(tmp_path), size)
    assert len(rows) == 10 and {(r[1], r[TEXT]) for r in rows} == want
    numbers = [i for i, f in enumerate(S.RAW_SCHEMA.fields) if f.dataType.typeName() != "string"]
    assert all(r[i] is not None for r in rows for i in numbers)


@pytest.mark.parametrize("size", [40, 100_000])
def test_a_quote_that_is_never_closed(spark, tmp_path, size):
    (tmp_path / "a.csv").write_text(month(['"in\norder"', '"open', "next", "more"]))
    rows = read(spark, str(tmp_path), size)
    assert sorted(r[1] for r in rows) == [f"01/0{i}/2024" for i in (1, 2, 3, 4)]
    assert {r[TEXT] for r in rows} >= {"in\norder", "next", "more"}


def test_states_of_a_line(spark):
    lines = ["", "a,b", '"a', 'a"', 'a,"b', '"a"', '"a""', '"a"",', ',"', 'x"y,"z"', '","', '"a"b"', '",', 'a""b']

    def slow(line, inside):
        state = "quoted" if inside else "start"
        for c in line:
            if c == '"':
                state = {"start": "quoted", "plain": "plain", "quoted": "closing", "closing": "quoted"}[state]
            elif state != "quoted":
                state = "start" if c == "," else "plain"
        return state == "quoted"

    df = spark.createDataFrame([(x,) for x in lines], "value string")
    for r in df.select("value", ends_inside(F.col("value"), False).alias("a"), ends_inside(F.col("value"), True).alias("b")).collect():
        assert (r["a"], r["b"]) == (slow(r["value"], False), slow(r["value"], True)), r
