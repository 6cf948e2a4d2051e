"""Wirings in parts: winners under them and under random wirings that are drawn in the task."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsewing import catalog
from sparsewing.functions.digests import Numbers, digests
from sparsewing.operators import blocks, packed, wiring


def test_digests_of_numbers():
    g = np.random.default_rng(1)
    x = np.concatenate([*(g.integers(0, 10**n, 9) for n in range(1, 19)), [0, 9, 10, -7, 2**63 - 1]])
    for front in ("prio:1:", "shuf:100:12:", "x" * 40 + ":", "y" * 90):
        first, last = digests(front, Numbers(x))
        assert [f"{a:016x}{b:016x}" for a, b in zip(first.tolist(), last.tolist(), strict=True)] == [hashlib.md5(f"{front}{v}".encode()).hexdigest() for v in x.tolist()]


def test_largest_drives_against_sorting(monkeypatch):
    """Also where many drives are equal, or larger than single precision tells apart."""
    monkeypatch.setattr(packed, "AT_ONCE", 32)
    monkeypatch.setattr(packed, "ROWS", 4)
    monkeypatch.setattr(packed, "DRAWN", 50)
    g = np.random.default_rng(2)
    n = g.integers(1, 5, 300)
    has = np.argsort(g.random((300, 9)), axis=1) < n[:, None]
    rows = [dict(cell=g.permutation(300).astype(np.int64).tobytes(), n=n.astype(np.int32).tobytes(), bits=np.packbits(has, axis=1).tobytes(), w=g.integers(1, 9, n.sum()).tobytes())]
    cells = packed.Cells(rows, 9, 1)
    for x in (g.integers(-2, 3, (11, 9)), g.integers(-(2**40), 2**40, (11, 9)), 2**40 + g.integers(0, 3, (11, 9)), np.zeros((11, 9), dtype=np.int64)):
        for weighted in (False, True):
            for seed in (None, 100):
                arm = packed.Arm("a", 0, shuffle=seed, weighted=weighted)
                y = x @ cells.entries(arm, np.arange(300)).astype(np.int64).T
                best = packed.largest(cells, arm, x, 7)
                assert (best.place.reshape(11, 7) == np.argsort(-y, axis=1, kind="stable")[:, :7]).all()
                assert (best.y == np.take_along_axis(y, best.place.reshape(11, 7), axis=1).ravel()).all()


def test_random_wirings_drawn_in_the_task(spark, monkeypatch):
    """The ranks under sources and random wirings are those under wirings that are written as rows, for parts of any size."""
    g = np.random.default_rng(8)
    items = spark.createDataFrame([(i, g.integers(-3, 4, 6).tolist()) for i in range(60)], "item_id long, q array<long>").cache()
    w = spark.createDataFrame([(int(i), c, int(g.integers(1, 4))) for c in range(40) for i in g.choice(6, int(g.integers(1, 5)), replace=False)], "dim long, cell long, w long").cache()
    queries = items.filter("item_id < 5").select("item_id")
    one = lambda x: x.withColumn("w", F.lit(1).cast("long"))
    draws = lambda x, f: f(x).withColumn("draw", F.lit(-1).cast("long")).unionByName(f(wiring.shuffle_inputs(x, 6, 100)).withColumn("draw", F.lit(0).cast("long")))
    same = lambda x: x
    some = w.filter("w >= 2 and dim in (0, 2, 3, 5)")
    _, plain = blocks.coded(items, [("a/", draws(w, one), 1), ("b/", draws(w, same), 2), ("c/", draws(some, one), 1)], 6, (2, 5))
    rank = lambda it, arms: sorted(map(tuple, blocks.rankings(it, queries, [blocks.Front(blocks.Exact("truth"), 6), *arms], 7).collect()))
    want = rank(items, plain)
    kinds = [packed.Source(), packed.Source(weighted=True), packed.Source(2, (0, 2, 3, 5))]
    arms = [packed.Arm(f"{n}/{b}", i, p, None if b < 0 else 100, x) for n, i, p, x in (("a", 0, 1, False), ("b", 1, 2, True), ("c", 2, 1, False)) for b in (-1, 0)]
    parts = packed.packed(w, 6, kinds).cache()
    assert rank(*packed.coded(items, parts, arms, 6, (2, 5))) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")
    try:
        monkeypatch.setattr(packed, "CELLS", 12)
        monkeypatch.setattr(packed, "ITEMS", 16)
        monkeypatch.setattr(packed, "TASKS", 2)
        assert rank(*packed.coded(items, packed.packed(w, 6, kinds).cache(), arms, 6, (2, 5))) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(Exception, match="count from 0"):
        packed.packed(w.withColumn("dim", F.col("dim") - 1), 6, [packed.Source()]).count()


@pytest.mark.parametrize("name", ["coverage_study", "primary_shuffled"])
def test_random_wirings_are_not_written(spark, monkeypatch, name):
    """No row is made for an entry of a random wiring: the only joins are those of the measured one and of items."""
    monkeypatch.setattr(wiring, "shuffle_inputs", None)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_conditions_share_one_wiring(spark, monkeypatch):
    """The measured wiring is built once for all conditions, and no random wiring is written."""
    from sparsewing.plans import protocol

    made, build = [], protocol.measured
    monkeypatch.setattr(protocol, "measured", lambda *x: made.append(x) or build(*x))
    monkeypatch.setattr(wiring, "shuffle_inputs", None)
    assert protocol.robustness(spark, "/root/testdata/sf0.001").count() == len(protocol.CONDITIONS) and len(made) == 1


def test_all_random_wirings_and_sizes_count(spark):
    """Forty random wirings and four numbers of winners, of which all but the primary one are corrected together."""
    rows = {r.k: r for r in catalog.QUERIES["primary_shuffled"](spark, "/root/testdata/sf0.001").collect()}
    assert sorted(rows) == [8, 16, 32, 64] and all(abs(41 * r.p_upper - round(41 * r.p_upper)) < 1e-6 for r in rows.values())
    p = sorted((r.p_two, k) for k, r in rows.items() if k != 16)
    assert rows[16].p_holm is None and abs(rows[p[0][1]].p_holm - min(1.0, 3 * p[0][0])) < 1e-8


def test_chains_in_parts(spark, monkeypatch):
    """Chains go to the tasks as bits; their entries are not made rows."""
    from sparsewing.operators import generators
    from sparsewing.plans import sweeps

    g = np.random.default_rng(3)
    w = spark.createDataFrame([(int(i), j, 1) for j in range(50) for i in g.choice(9, g.integers(1, 5), replace=False) if i != 4], "dim long, cell long, w long").cache()
    want = sorted((r.draw + 1, r.cell, r.dim) for r in generators.curveball_path(w, 2, [3], 1).collect())
    monkeypatch.setattr(generators, "path_rows", None)
    got = []
    for r in sweeps.pool_parts(spark, w, 2, 9, 1, sweeps=3).collect():
        cells = packed.Cells([r], 9, 1)
        assert (cells.n == cells.has.sum(axis=1)).all() and r.cells == len(cells.cell)
        row, dim = np.nonzero(cells.has)
        got += [(r.source, int(c), int(i)) for c, i in zip(cells.cell[row], dim, strict=True)]
    assert sorted(got) == want


def test_expected_overlap_without_rows_for_entries(spark, monkeypatch):
    """The same as from rows, for circuits of other dims and a spectrum with a zero."""
    from sparsewing.operators import generators, pairmodel

    g = np.random.default_rng(5)
    size = {"a": 7, "b": 4}
    entry = {c: g.random((n, 60)) < 0.4 for c, n in size.items()}
    rows = [(c, "dim", 3 * i, int(x.sum())) for c, m in entry.items() for i, x in enumerate(m)] + [(c, "cell", j, int(x.sum())) for c, m in entry.items() for j, x in enumerate(m.T) if x.any()]
    margins = spark.createDataFrame(rows, "flag string, side string, id long, n long").cache()
    lam = {c: g.random(n) * 5 for c, n in size.items()}
    lam["a"][2], d = 0.0, {"a": 2.0, "b": 0.7}
    spectrum = spark.createDataFrame([(c, 3 * i, float(x), d[c]) for c, v in lam.items() for i, x in enumerate(v)], "flag string, dim long, lam double, d double")
    made = generators.realise(margins, 2, sweeps=2, by=["flag"]).cache()
    wide = spectrum.join(made.select("flag", "draw").distinct(), "flag")
    want = {(r.flag, r.draw, r.k): (r.overlap, r.fall) for r in pairmodel.expected(pairmodel.cell_moments(made, wide, ["flag", "draw"]), ["flag", "draw"], [3, 8]).collect()}
    monkeypatch.setattr(generators, "_rows", None)
    bits, dims, names = generators.realised_bits(margins, 2, sweeps=2, by=["flag"])
    of = {r.g: r.flag for r in names.collect()}
    got = pairmodel.expected_of_bits(bits, 2, [(lam[of[i]][x // 3], d[of[i]]) for i, x in enumerate(dims)], [3, 8]).collect()
    assert {(of[r.g], r.draw, r.k) for r in got} == set(want) and len(want) == 8
    assert all(np.allclose((r.overlap, r.fall), want[of[r.g], r.draw, r.k], rtol=1e-9) for r in got)
    assert generators.realised_bits(margins.limit(0), 2) is None
    assert generators.realise(margins.limit(0), 2, by=["flag"]).columns == ["flag", "draw", "dim", "cell", "w"]
