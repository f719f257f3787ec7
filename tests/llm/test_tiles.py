"""Rows dealt to the tiles of a hot group."""

from __future__ import annotations

import numpy as np

from airlag.llm import ngram_join as J


def test_a_linked_part_of_a_hot_group_is_not_dealt_to_itself(spark, monkeypatch):
    linked, apart = 190, 10
    sign = bytes(8 * J.SIGNATURE_WORDS)  # all alike: every pair may reach the threshold
    nodes = spark.createDataFrame([(i, 100 + i % 3, sign) for i in range(linked + apart)], "node long, n long, sign binary")
    groups = nodes.selectExpr("7L as token", "node", f"{linked + apart}L as g")
    comps = nodes.where(f"node < {linked}").selectExpr("node", "0L as comp")
    dealt, pairs_of = spark.sparkContext.accumulator(0), J._tile_pairs

    def counted(percent, width):
        run = pairs_of(percent, width)

        def count(batches):
            for batch in batches:
                dealt.add(len(batch.column(1).flatten()))
                yield from run([batch])
        return count

    monkeypatch.setattr(J, "TILE", 16)
    monkeypatch.setattr(J, "_tile_pairs", counted)
    pairs = {(r.a, r.b) for r in J._tiles(groups, nodes, comps, 80, 1000).where("b is not null").collect()}
    everyone = np.arange(linked + apart)
    assert pairs == {(a, b) for a in everyone.tolist() for b in range(max(a + 1, linked), linked + apart)}
    assert dealt.value < 5 * (linked + apart)
