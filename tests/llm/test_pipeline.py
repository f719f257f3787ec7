"""The pipeline's stages on the smallest tables, each judged on its own input."""

from collections import Counter

import corpus_pipeline
from airlag.llm import mixing, quality_rules
from tests.conftest import SF_SMALL
from tests.llm import data
from tests.llm.test_exact_text import brute_components, brute_windows


def test_stages_and_run(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, SF_SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = [tuple(r) for r in docs.collect()]
        seen.append((name, before, after))
        assert name == "packing" or docs.columns == columns
    (_, b1, a1), (_, b2, a2), (_, b3, a3), (_, b4, a4), (_, b5, a5) = seen
    assert set(a1) <= set(b1) and 0.5 * len(b1) < len(a1) < len(b1)
    assert all(len(data.words(r[1])) >= quality_rules.MIN_WORDS for r in a1)
    groups = brute_components([r[:2] for r in b2], 5, 80)
    assert Counter(r[0] for r in a2) == Counter({c: 1 for _, _, c in groups})
    removed = {d: n for d, _, n, _ in brute_windows([r[:2] for r in b3], 35)}
    words = {r[0]: len(data.words(r[1])) for r in a3}
    assert all(words[r[0]] == len(data.words(r[1])) - removed[r[0]] for r in b3) and len(a3) == len(b3)
    assert all(a == b for a, b in zip(sorted(a3), sorted(b3), strict=True) if not removed[b[0]])
    assert set(a4) <= set(b4)
    kept = sum(len(data.words(r[1])) + 1 for r in a4) / sum(len(data.words(r[1])) + 1 for r in b4)
    assert abs(kept - mixing.KEEP_TOKENS) < 0.15
    assert {r[0] for r in a5} == {r[0] for r in b5}
    whole = corpus_pipeline.run(spark, SF_SMALL)
    assert Counter(tuple(r)[:5] for r in whole.collect()) == Counter(r[:5] for r in a5)


def _tables(docs, labels, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_on_odd_rows_and_clashing_columns(spark, tmp_path):
    """Nulls in every column, empty and very long texts, copies, repeated rows,
    no label at all: each stage keeps columns, values and clean documents."""
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    sf = _tables(data.documents(spark), labels, tmp_path / "in")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == before.columns
        seen[name] = ([tuple(r)[:5] for r in before.collect()], [tuple(r)[:5] for r in docs.collect()])
    before, after = seen["quality_rules"]  # nothing is learned: the base alone rejects
    assert not Counter(after) - Counter(before)
    assert {r[0] for r in after} >= {r[0] for r in before if r[0] and r[0] < 40 and len(data.words(r[1])) >= quality_rules.MIN_WORDS}
    assert not {r[0] for r in after} & {500, 501, 502, 503, 504, 505, 506, 507, 601}
    before, after = seen["near_duplicates"]
    assert Counter(r[0] for r in after) == Counter({c: 1 for _, _, c in brute_components([r[:2] for r in before], 5, 80)})
    before, after = seen["substring_dedup"]
    assert len(before) == len(after) and 600 in {r[0] for r in after}
    assert not Counter(seen["mixing"][1]) - Counter(seen["mixing"][0])
    assert {r[0] for r in seen["packing"][1]} == {r[0] for r in seen["packing"][0]}


def test_stages_on_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    sf = _tables(data.empty(spark), labels, tmp_path / "in")
    assert corpus_pipeline.run(spark, sf).collect() == []
