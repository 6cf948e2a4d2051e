"""Random wirings whose cells lie in many blocks: margins, evenness, and margins made from counts alone."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsewing.operators import generators, wiring


def made(spark, cells=120, dims=7, seed=1):
    g = np.random.default_rng(seed)
    rows = [(int(i), j, int(g.integers(1, 9))) for j in range(cells) for i in g.choice(dims, g.integers(1, 5), replace=False, p=np.arange(1, dims + 1) / (dims * (dims + 1) / 2))]
    return spark.createDataFrame(rows, "dim long, cell long, w long").cache()


def sums(x, side):
    return {r[side]: r["count"] for r in x.groupBy(side).count().collect()}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(generators, "BLOCK", 16)


def test_chains_over_blocks(spark, small_blocks):
    w = made(spark)
    path = generators.curveball_path(w, 2, [1, 4]).cache()
    weight = sorted(map(tuple, w.select("cell", "w").collect()))
    start = {(r.dim, r.cell) for r in w.collect()}
    for i in range(2):
        for m in (1, 4):
            x = path.filter((F.col("draw") == i) & (F.col("mark") == m)).cache()
            assert sums(x, "dim") == sums(w, "dim") and sums(x, "cell") == sums(w, "cell")
            assert x.select("dim", "cell").distinct().count() == len(start)
            assert sorted(map(tuple, x.select("cell", "w").collect())) == weight
        assert {(r.dim, r.cell) for r in x.collect()} != start
    again = generators.curveball(w.repartition(3), 2, 4)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, path.filter("mark = 4").select("draw", "dim", "cell", "w").collect()))


def test_evened_over_blocks(spark, small_blocks):
    w = made(spark)
    for equal_in, equal_out in ((False, False), (False, True), (True, False), (True, True)):
        x = generators.margin_control(w, 1, equal_in, equal_out)
        assert x.select("dim", "cell").distinct().count() == w.count()
        for side, flat in (("cell", equal_in), ("dim", equal_out)):
            got = sums(x, side)
            assert (max(got.values()) - min(got.values()) <= 1) if flat else got == sums(w, side)


def test_realised_over_blocks(spark, small_blocks):
    w = made(spark)
    m = w.groupBy(F.lit("dim").alias("side"), F.col("dim").alias("id")).agg(F.count("*").alias("n"))
    m = m.unionByName(w.groupBy(F.lit("cell").alias("side"), F.col("cell").alias("id")).agg(F.count("*").alias("n")))
    x = generators.realise(m, 2).cache()
    for i in range(2):
        y = x.filter(F.col("draw") == i)
        assert sums(y, "dim") == sums(w, "dim") and sums(y, "cell") == sums(w, "cell") and y.select("dim", "cell").distinct().count() == w.count()


def test_runs_of_equal_columns():
    """The runs make a matrix exactly where one exists."""
    g, found = np.random.default_rng(6), 0
    for _ in range(400):
        d, m = int(g.integers(1, 6)), int(g.integers(1, 7))
        c = g.integers(0, d + 1, m)
        r = np.bincount(g.integers(0, d, c.sum()), minlength=d)
        sizes = dict(zip(*[x.tolist() for x in np.unique(c, return_counts=True)], strict=True))
        try:
            generators.matrix_of(r, c, g)
        except ValueError:
            with pytest.raises(ValueError):
                generators.segments(r, sizes)
            continue
        total = np.zeros(d, dtype=np.int64)
        for k, (ends, column) in generators.segments(r, sizes).items():
            assert ends[-1] == sizes[k] and (column.sum(axis=1) == k).all()
            total += (np.diff(ends, prepend=0)[:, None] * column).sum(axis=0)
        assert (total == r).all()
        found += 1
    assert found > 100


@pytest.mark.parametrize("most", [2, 32])
def test_steepest_exchanges(spark, monkeypatch, most):
    """The walk over candidates takes the steps of a walk over all pairs of cells."""
    monkeypatch.setattr(generators, "MOST", most)
    w = made(spark, 60)
    dims, cells = 7, 60
    entry = np.zeros((cells, dims), dtype=np.int64)
    for r in w.collect():
        entry[r.cell, r.dim] = 1
    cycles = lambda e: sum(n * (n - 1) // 2 for i in range(dims) for j in range(i) for n in [int(e[:, i] @ e[:, j])])
    for a, b in np.random.default_rng([1, 0]).integers(dims, size=(12, 2)).tolist():
        best, at = 0, None
        for p in np.flatnonzero(entry[:, a] > entry[:, b]) if a != b else []:
            for q in np.flatnonzero(entry[:, b] > entry[:, a]):
                e = entry.copy()
                e[p, [a, b]], e[q, [a, b]] = (0, 1), (1, 0)
                if cycles(e) - cycles(entry) < best:
                    best, at = cycles(e) - cycles(entry), e
        entry = entry if at is None else at
    x = generators.diversify(w, 1, 12).select("dim", "cell", "w")
    assert wiring.co_occurrence(x).first().four_cycles == pytest.approx(cycles(entry), rel=0.05)
    assert sums(x, "dim") == sums(w, "dim") and sums(x, "cell") == sums(w, "cell")


def test_edges_dealt_by_cell(spark, monkeypatch):
    """The same wiring whatever number of parts its edges are dealt into; both sums then stay in their part."""
    monkeypatch.setattr(wiring, "EDGES", 50)
    g = np.random.default_rng(2)
    e = spark.createDataFrame([(int(a), int(b), int(c)) for a, b, c in zip(g.integers(0, 20, 400), g.integers(0, 30, 400), g.integers(1, 9, 400), strict=True)], "pre long, post long, weight long")
    d = spark.createDataFrame([(i, i % 4) for i in range(20)], "pre long, dim long")
    dealt = wiring.build(e, d, 3, rows=400)
    assert dealt.rdd.getNumPartitions() == 8 and sorted(map(tuple, dealt.collect())) == sorted(map(tuple, wiring.build(e, d, 3).collect()))
