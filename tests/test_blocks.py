"""Blocked retrieval, matrix encodings and places against plain restatements."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsewing.operators import blocks, encode, knn, order, wiring


def md5(*p):
    return hashlib.md5(":".join(map(str, p)).encode()).hexdigest()


@pytest.fixture(scope="module")
def items(spark):
    g = np.random.default_rng(5)
    x = g.integers(-2, 3, (90, 8))
    x[10], x[20], x[30] = x[11], x[11], 0
    return x, spark.createDataFrame([(1000 + i, r.tolist()) for i, r in enumerate(x)], "item_id long, q array<long>").repartition(5)


def test_rankings_against_sorting_everything(spark, items):
    x, df = items
    w = wiring.uniform(spark, 8, 20, 3, 2)
    s = blocks.stack(w, 8)
    rows = w.collect()
    cells = sorted({r.cell for r in rows}, key=lambda c: (md5("prio", 1, c), c))
    assert s.cell.tolist() == cells
    m = np.zeros((8, 20), dtype=int)
    for r in rows:
        m[r.dim, r.cell] = r.w
    y = (8 * x - x.sum(axis=1, keepdims=True)) @ m
    code = lambda i, k: set(sorted(range(20), key=lambda c: (-y[i, c], md5("prio", 1, c), c))[:k])
    ask = [1000, 1010, 1011, 1030, 1089]
    q = spark.createDataFrame([(i,) for i in ask] + [(5,)], "item_id long")  # one that no item has
    arms = [blocks.Exact("truth"), blocks.Coded("a", s, (2, 5)), blocks.Coded("b", s, (3,), tie="item")]
    got = {}
    for r in blocks.rankings(df, q, arms, 7).collect():
        got.setdefault((r.arm, r.query_id), {})[r.rnk] = (r.item_id, r.d)
    assert set(got) == {(a, i) for a in ("truth", "a:2", "a:5", "b") for i in ask}
    for i in ask:
        others = [j for j in range(90) if 1000 + j != i]
        far = lambda j: int(((x[i - 1000] - x[j]) ** 2).sum())  # noqa: B023, E731
        want = sorted((far(j), 1000 + j) for j in others)[:7]
        assert [got["truth", i][r + 1] for r in range(7)] == [(j, d) for d, j in want]
        for arm, k, tie in (("a:2", 2, lambda j: md5("tie", 5, i, j)), ("a:5", 5, lambda j: md5("tie", 5, i, j)), ("b", 3, lambda j: md5("tie", 5, j))):  # noqa: B023
            want = sorted((2 * k - 2 * len(code(i - 1000, k) & code(j, k)), tie(1000 + j), 1000 + j) for j in others)[:7]
            assert [got[arm, i][r + 1] for r in range(7)] == [(j, d) for d, _, j in want]
    p = knn.truth(df, q, 7).collect()
    assert {(r.query_id, r.rnk, r.item_id, r.d) for r in p} == {(i, r, *got["truth", i][r]) for i in ask for r in range(1, 8)}


def test_blocks_of_any_size_give_one_ranking(spark, items, monkeypatch):
    _, df = items
    q = df.select("item_id").limit(4)
    arms = [blocks.Exact("truth"), blocks.Coded("a", blocks.stack(wiring.uniform(spark, 8, 20, 3, 2), 8), (4,))]
    rows = lambda: sorted(map(tuple, blocks.rankings(df.coalesce(1), q, arms, 5).collect()))
    one = rows()
    monkeypatch.setattr(blocks, "BLOCK", 12)  # three items at a time
    assert rows() == one and len(one) == 2 * 4 * 5


def test_bounds_are_checked(spark, items, monkeypatch):
    _, df = items
    monkeypatch.setattr(blocks, "MAX_QUERIES", 3)
    with pytest.raises(ValueError, match="more than 3 queries"):
        blocks.rankings(df, df.select("item_id"), [blocks.Exact("truth")], 2)
    parts = blocks.query_blocks(df)
    assert len(parts) == 45 and sorted(r.item_id for p in parts for r in p.collect()) == list(range(1000, 1090))
    monkeypatch.setattr(blocks, "BROADCAST_ROWS", 5)
    with pytest.raises(ValueError, match="more than 10 entries"):
        blocks.stack(wiring.uniform(spark, 8, 20, 3, 2), 8)
    with pytest.raises(ValueError, match="too large"):
        blocks.stacks(wiring.uniform(spark, 8, 20, 3, 2).withColumn("draw", F.lit(0)), 8)


def test_nothing_to_rank(spark, items):
    _, df = items
    arms = [blocks.Exact("truth")]
    assert blocks.rankings(df, df.select("item_id").limit(0), arms, 3).count() == 0
    assert blocks.rankings(df.limit(0), df.select("item_id"), arms, 3).count() == 0
    assert blocks.rankings(df.limit(1), df.limit(1).select("item_id"), arms, 3).count() == 0
    few = blocks.rankings(df.filter("item_id < 1003"), df.select("item_id"), arms, 5)
    assert sorted((r.query_id, r.rnk) for r in few.collect()) == [(i, r) for i in (1000, 1001, 1002) for r in (1, 2)]


def test_products_of_large_numbers():
    g = np.random.default_rng(1)
    for top in (10, 10**9, 2**45):
        a, b = g.integers(-top, top, (5, 4)), g.integers(-3, 4, (4, 6))
        assert (blocks.product(a, b) == np.array([[sum(int(u) * int(v) for u, v in zip(r, c, strict=True)) for c in b.T] for r in a])).all()
    s = blocks.Stack(g.integers(0, 2, (4, 30)), np.arange(30))
    small = g.integers(-5, 5, (8, 4))
    assert (s.winners(small, 6) == s.winners(small * 2**55, 6)).all() and s.winners(small, 99).shape == (8, 30)


def test_uneven_and_missing_values(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [4]), (3, None), (4, [None, 5, 6, 7])], "item_id long, q array<long>")
    w = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (2, 1, 1)], "dim long, cell long, w long")
    got = {(r.item_id, r.cell): r.y for r in encode.drive(df, w, 3).collect()}
    assert got == {(1, 0): 5, (1, 1): 3, (2, 0): 4, (2, 1): 0, (3, 0): 0, (3, 1): 0, (4, 0): 10, (4, 1): 6}
    assert {(r.item_id, r.rnk): r.cell for r in encode.encode(df, w, 3, 1).collect()}[1, 1] == 0


def test_places_and_running_totals(spark):
    g = np.random.default_rng(2)
    v = g.integers(0, 9, 300).tolist()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id long, v long").repartition(7)
    place = {r.id: r.p for r in order.place(df, [F.col("v").desc(), F.col("id")], "p").collect()}
    assert place == {i: k + 1 for k, i in enumerate(sorted(range(300), key=lambda i: (-v[i], i)))}
    before = {r.id: r.b for r in order.running(df, ["id"], "v", "b").collect()}
    assert before == {i: sum(v[:i]) for i in range(300)}
    mean = {r.v: r.m for r in order.average_places(df, "v", "m").collect()}
    assert mean == {x: sum(k + 1 for k, y in enumerate(sorted(v)) if y == x) / v.count(x) for x in set(v)}
    assert order.place(df.limit(0), ["id"], "p").count() == 0


def test_one_scan_for_all_arms(spark, items):
    _, df = items
    arms = [blocks.Exact("truth")] + [blocks.Coded(str(i), blocks.stack(wiring.uniform(spark, 8, 20, 3, i), 8), (4,)) for i in range(3)]
    plan = blocks.scores(blocks.rankings(df, df.select("item_id").limit(3), arms, 5), "truth", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_wirings_too_large_for_every_task(spark, monkeypatch):
    """The same ranks whether a wiring goes to every task or its cells are dealt into blocks."""
    g = np.random.default_rng(8)
    items = spark.createDataFrame([(i, g.integers(-3, 4, 6).tolist()) for i in range(60)], "item_id long, q array<long>").cache()
    rows = [(d, int(i), c, int(g.integers(1, 3))) for d in (-1, 0) for c in range(40) for i in g.choice(6, 2, replace=False)]
    w = spark.createDataFrame(rows, "draw long, dim long, cell long, w long").cache()
    queries = items.filter("item_id < 5").select("item_id")

    def ranks():
        it, arms = blocks.coded(items, [("a/", w, 1), ("b/", w.filter("cell < 3"), 2)], 6, (2, 5))
        return sorted(map(tuple, blocks.rankings(it, queries, [blocks.Front(blocks.Exact("truth"), 6), *arms], 7).collect())), arms

    plain, arms = ranks()
    assert not any(isinstance(a, blocks.Listed) for a in arms)
    monkeypatch.setattr(blocks, "BROADCAST_ROWS", 5)
    for name, n in (("CELLS", 7), ("ITEMS", 16)):
        monkeypatch.setattr(blocks, name, n)
    dealt, arms = ranks()
    assert sum(isinstance(a, blocks.Listed) for a in arms) == 4 and dealt == plain
