"""Steps that must not hold, sort or shuffle what grows with the tables."""

import numpy as np
from pyspark.sql import functions as F

from sparsewing.operators import encode, generators, knn, learn, pairmodel, wiring
from sparsewing.plans import items, sweeps, wirings


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_asymmetric_sums_where_the_code_is_made(spark):
    g = np.random.default_rng(1)
    y = spark.createDataFrame([(i, c, int(v)) for i, row in enumerate(g.integers(-50, 50, (12, 9)).tolist()) for c, v in enumerate(row)], "item_id long, cell long, y long")
    code, queries = encode.winners(y, 3), spark.createDataFrame([(0,), (5,)], "item_id long")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        s = knn.asymmetric(code, y, queries)
        assert plan(s.select("query_id")).count("SortMergeJoin") == 1  # the choice of the queries' drives; none on the code
        got = {(r.query_id, r.item_id): r.s for r in s.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    value, won = {(r.item_id, r.cell): r.y for r in y.collect()}, [(r.item_id, r.cell) for r in code.collect()]
    assert got == {(q, i): sum(value[q, c] for j, c in won if j == i) for q in (0, 5) for i in range(12) if i != q}


def test_completion_by_rows(spark):
    g = np.random.default_rng(2)
    x = g.standard_normal((60, 3)) @ g.standard_normal((3, 8)) + 0.01 * g.standard_normal((60, 8))
    x[g.random(x.shape) < 0.3] = np.nan
    x[:, 7] = np.nan
    rows = [(i, [None if i % 2 and np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    table = spark.createDataFrame(rows, "item long, x array<double>")
    for rounds in (1, 9, 10, 11, 25):
        got = {r.item: r.y for r in learn.completed(table.repartition(5), 8, 3, rounds).collect()}
        assert np.abs(np.array([got[i] for i in range(60)]) - learn.complete(x, 3, rounds)).max() < 1e-9
    assert learn.completed(table.filter("item < 0"), 8, 3).count() == 0


def test_no_group_holds_the_response_matrix(spark):
    made = items.lowrank_impute(spark, "/root/testdata/sf0.001")
    assert "FlatMapGroups" not in plan(made)


def test_parts_of_a_wiring_hold_after_the_join(spark, monkeypatch):
    g = np.random.default_rng(3)
    edges = spark.createDataFrame([(int(a), int(b), int(c), "AR"[int(a) % 2]) for a, b, c in g.integers(0, (20, 30, 9), (400, 3))], "pre long, post long, weight long, flag string")
    dims = spark.createDataFrame([(i, i % 5) for i in range(20)], "pre long, dim long")
    monkeypatch.setattr(wiring, "EDGES", 100)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dealt = wiring.build(edges, dims, 3, by=["flag"], rows=400)
        above = plan(dealt).split("SortMergeJoin")[0]
        assert above.count("Exchange") == above.count("REPARTITION_BY_NUM") == 1  # the deal by cell; no sum is shuffled again
        assert sorted(dealt.collect()) == sorted(wiring.build(edges, dims, 3, by=["flag"]).collect())
        lam = spark.createDataFrame([(f, i, 1.0 + i, 50.0) for f in "AR" for i in range(5)], "flag string, dim long, lam double, d double")
        moments = plan(pairmodel.cell_moments(dealt, lam, ["flag"]))
        assert "BroadcastHashJoin [flag" in moments and moments.count("SortMergeJoin") == 1  # the spectrum goes to the wiring
        assert plan(wiring.align(dealt, dims)).count("SortMergeJoin") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_realised_wirings_are_summed_where_they_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(wiring, "EDGES", 1000)
    made = wirings.realised_entries(spark, "/root/testdata/sf0.001")
    above = plan(made).split("REPARTITION_BY_NUM")[0]
    assert "keys=[flag" in above and "dim#" in above and above.count("Exchange hashpartitioning(flag") == 1  # of the flags' counts alone
    assert all(r.entries == r.distinct_entries for r in made.collect())


def test_equal_cells_do_not_crowd_out_others(spark, monkeypatch):
    g = np.random.default_rng(4)
    base = [(i, j) for j in range(40) for i in g.choice(8, g.integers(1, 5), replace=False).tolist()]
    w = spark.createDataFrame([(i, 40 * copy + j) for copy in range(80) for i, j in base], "dim long, cell long")
    scans, scan = [], generators._candidates
    monkeypatch.setattr(generators, "_candidates", lambda *x: scans.append(x[3]) or scan(*x))
    x = np.zeros((8, 3200), dtype=np.int64)
    for r in generators.diversify(w, 1, 60).collect():
        x[r.dim, r.cell] += 1
    assert x.max() == 1 and max(scans) == generators.MOST and len(scans) <= 4
    was = np.zeros_like(x)
    was[tuple(np.array([(i, 40 * copy + j) for copy in range(80) for i, j in base]).T)] = 1
    assert (x.sum(axis=0) == was.sum(axis=0)).all() and (x.sum(axis=1) == was.sum(axis=1)).all()
    # the same steps over all cells, one of each pattern being enough
    left = was.copy()
    for a, b in np.random.default_rng([1, 0]).integers(8, size=(60, 2)).tolist():
        if a != b:
            s = left @ left.T
            lean, rest = generators._lean(s, a, b), np.delete(np.arange(8), [a, b])
            p, q = (np.flatnonzero((left[i] == 1) & (left[j] == 0)) for i, j in ((a, b), (b, a)))
            p, q = (k[np.unique(left[:, k].T, axis=0, return_index=True)[1]] for k in (p, q))
            gain = generators.swap_gains(left.T[:, rest], lean[rest], p, q)
            if gain.size and gain.min() < 0:
                i, j = np.unravel_index(gain.argmin(), gain.shape)
                left[[a, b], p[i]], left[[a, b], q[j]] = (0, 1), (1, 0)
    cycles = lambda m: int((np.triu(m @ m.T, 1) ** 2).sum())
    assert abs(cycles(x) - cycles(left)) <= 0.001 * cycles(was) and cycles(x) < cycles(was)


def test_overlaps_of_chains_without_rows_for_entries(spark):
    g = np.random.default_rng(5)
    w = spark.createDataFrame([(int(i) * 3, j, int(g.integers(1, 9))) for j in range(90) for i in g.choice(9, g.integers(1, 5), replace=False)], "dim long, cell long, w long")
    kept = generators.chains(w, 2, [1, 3], 4).cache()
    rows = generators.curveball_path(w, 2, [1, 3], 4).collect()
    assert sorted(rows) == sorted(generators.path_rows(kept, 2, [1, 3], 4).collect())
    want = {}
    for r in rows:
        want.setdefault((r.draw, r.mark, r.cell), []).append(r.dim)
    count = {}
    for (draw, mark, _), dims in want.items():
        for a in dims:
            for b in dims:
                if a < b:
                    count[draw, mark, a, b] = count.get((draw, mark, a, b), 0) + 1
    made = generators.path_overlaps(kept, 2, [1, 3])
    assert {tuple(r)[:4]: r.n for r in made.collect() if r.n} == count
    assert "Generate" not in plan(sweeps.convergence_pool(spark, "/root/testdata/sf0.001"))
