"""Every item as a query against the ranking of a stated set."""

import numpy as np
import pytest

from sparsewing.operators import blocks, wiring


@pytest.mark.parametrize("scale", (9, 900_000_000))  # many ties; products beyond 2**53
def test_every_item_as_a_query_in_a_grid(spark, monkeypatch, scale):
    monkeypatch.setattr(blocks, "ALL_QUERIES", 70)
    monkeypatch.setattr(blocks, "ALL_ITEMS", 90)
    g = np.random.default_rng(8)
    rows = g.integers(0, scale, (200, 12))
    rows[150:] = rows[:50]
    items = spark.createDataFrame([(7 * i, r) for i, r in enumerate(rows.tolist())], "item_id long, q array<long>").repartition(3)
    arms = [blocks.Exact("truth"), blocks.Coded("code", blocks.stack(wiring.uniform(spark, 12, 40, 4, 3), 12), (5,))]
    want = blocks.rankings(items, items.select("item_id"), arms, 6)
    assert sorted(blocks.all_rankings(items, arms, 6).collect()) == sorted(want.collect())
    few = items.filter("item_id < 28")
    assert sorted(blocks.all_rankings(few, arms, 6).collect()) == sorted(blocks.rankings(few, few.select("item_id"), arms, 6).collect())
