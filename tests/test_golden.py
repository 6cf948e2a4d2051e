"""Hand-checkable cases."""

from math import isclose, sqrt

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsewing.functions import numbers, vectors
from sparsewing.operators import collision, encode, generators, inference, knn, learn, metrics, wiring
from sparsewing.operators.graph import components


def codes(spark, rows):
    return spark.createDataFrame([(i, c, r + 1, 0) for i, cells in rows.items() for r, c in enumerate(cells)], "item_id long, cell long, rnk long, y long")


def ids(spark, *x):
    return spark.createDataFrame([(i,) for i in x], "item_id long")


def drives(spark, rows):
    return spark.createDataFrame([(i, c, v) for i, ys in enumerate(rows) for c, v in enumerate(ys)], "item_id long, cell long, y long")


def test_wiring_build(spark):
    """Two sources of one type add up, a source without a type counts nowhere, and its cell vanishes."""
    dims = spark.createDataFrame([(20, 4), (21, 4), (22, 7), (23, 7)], "pre long, dim long")
    edges = spark.createDataFrame([(20, 1, 6), (21, 1, 1), (21, 1, 2), (22, 1, 5), (23, 2, 3), (30, 3, 9), (30, 2, 9)], "pre long, post long, weight long")
    got = {(r.dim, r.cell): (r.w, r.partners) for r in wiring.build(edges, dims).collect()}
    assert got == {(4, 1): (9, 2), (7, 1): (5, 1), (7, 2): (3, 1)}
    assert [(r.dim, r.cell) for r in wiring.build(edges, dims, 5).orderBy("dim").collect()] == [(4, 1), (7, 1)]
    one = wiring.align(wiring.build(edges, dims), dims.filter("dim = 4"))
    assert [(r.cell, r.w, r.partners) for r in one.collect()] == [(1, 9, 2)]


def matrix(spark, rows):
    return spark.createDataFrame([(i, j, v) for i, row in enumerate(rows) for j, v in enumerate(row) if v], "dim long, cell long, w long")


def test_threshold(spark):
    w = matrix(spark, [[1, 0, 3, 2], [2, 0, 0, 1], [0, 0, 5, 0]])
    r = wiring.retained(w, 2).first()
    assert (r.entries, r.kept, r.weight, r.kept_weight) == (6, 4, 14, 12)
    assert wiring.inputs(w.filter("w >= 2")).filter("inputs = 1").count() == 2


def test_type_parser(spark):
    df = spark.createDataFrame([("DA1_lPN",), ("VA1d_adPN",), ("M_l2PNm16",), ("CB2004",), (None,)], "t string")
    assert [r.d for r in df.select(vectors.type_to_dim(F.col("t")).alias("d")).collect()] == ["DA1", "VA1d", None, None, None]


def test_winner_ties(spark):
    y = drives(spark, [[3, 5, 5, 5, 1]])
    assert [r.cell for r in encode.winners(y, 2, "index").orderBy("rnk").collect()] == [1, 2]
    assert {r.cell for r in encode.winners(y, 2, "include").collect()} == {1, 2, 3}
    assert [r.cell for r in encode.winners(drives(spark, [[9, 8, 7, 1, 0]]), 2).orderBy("rnk").collect()] == [0, 1]
    low, high = ({r.cell for r in encode.winners(y, 1, t).collect()} for t in ("random", "reverse"))
    assert low != high and low | high <= {1, 2, 3}


def test_both_ways_to_encode(spark, monkeypatch):
    g = np.random.default_rng(7)
    it = spark.createDataFrame([(i, [int(v) for v in g.integers(0, 4, 16)]) for i in range(30)], "item_id long, q array<long>")
    w = wiring.uniform(spark, 16, 50, 3, 1)
    fast = [sorted(map(tuple, encode.encode(it, w, 150, 6).collect())), sorted(map(tuple, encode.drive(it, w, 150).select("item_id", "cell", "y").collect()))]
    monkeypatch.setattr(encode, "BROADCAST_ROWS", 10)
    assert fast == [sorted(map(tuple, encode.encode(it, w, 150, 6).collect())), sorted(map(tuple, encode.drive(it, w, 150).select("item_id", "cell", "y").collect()))]


def test_average_precision(spark):
    q = spark.createDataFrame([(0,), (1,)], "item_id long")
    pred = spark.createDataFrame([(0, i + 1, x) for i, x in enumerate((100, 5, 101, 6))], "query_id long, rnk long, item_id long")
    true = spark.createDataFrame([(0, i + 1, x) for i, x in enumerate((100, 101, 102, 103))], "query_id long, rnk long, item_id long")
    s = {r.query_id: r for r in metrics.scores(pred, true, q, 4).collect()}
    assert isclose(s[0].ap, round((1 + 2 / 3) / 4, 9)) and s[0].recall == 0.5 and isclose(s[0].ap_retrieved, round((1 + 2 / 3) / 2, 9))
    assert (s[1].ap, s[1].recall) == (0.0, 0.0)
    o = {r.query_id: r.overlap for r in metrics.list_overlap(pred, true, q, 4).collect()}
    assert isclose(o[0], round((1 + 1 / 2 + 2 / 3 + 2 / 4) / 4, 9)) and o[1] == 0.0


def test_hamming_with_no_shared_winner(spark):
    c = codes(spark, {0: [0], 1: [0], 2: [0], 3: [1]})
    r = knn.hamming(c, ids(spark, 0), ids(spark, 0, 1, 2, 3), 3).orderBy("rnk").collect()
    assert [x.d for x in r] == [0, 0, 2] and {x.item_id for x in r[:2]} == {1, 2} and r[2].item_id == 3


def test_auc_and_bloom(spark):
    s = lambda a, b: spark.createDataFrame([(i, v, 1) for i, v in enumerate(a)] + [(9 + i, v, 0) for i, v in enumerate(b)], "item_id long, s double, novel int")
    assert metrics.auc(s((0.9, 0.8), (0.1, 0.2))).first().auc == 1.0
    assert metrics.auc(s((0.1, 0.2), (0.9, 0.8))).first().auc == 0.0
    c = codes(spark, {1: [0, 1], 2: [2, 3], 3: [2, 3]})
    nov = lambda *stored: {r.item_id: r.novelty for r in metrics.bloom(c, ids(spark, *stored), ids(spark, 1, 2)).collect()}
    assert nov(1) == {1: 0.0, 2: 1.0}
    assert nov(1, 2, 3) == {1: round(2 / 3, 9), 2: round(1 / 3, 9)}


def test_asymmetric_scores(spark):
    c = codes(spark, {10: [0, 2], 11: [1, 2], 12: [0, 2]})
    y = spark.createDataFrame([(0, 0, 1), (0, 1, 10), (0, 2, 100)], "item_id long, cell long, y long")
    assert {r.item_id: r.s for r in knn.asymmetric(c, y, ids(spark, 0)).collect()} == {10: 101, 11: 110, 12: 101}


def test_value_tags(spark):
    r = encode.value_tags(encode.winners(drives(spark, [[5, 1, 3, 0], [0, 4, 1, 2]]), 2), 4).orderBy("item_id", "cell").collect()
    assert [(x.item_id, x.cell, x.lev) for x in r] == [(0, 0, 15), (0, 2, 5), (1, 1, 10), (1, 3, 0)] and isclose(r[0].rec, 2 + 15.5 * 3 / 16)
    flat = encode.value_tags(encode.winners(drives(spark, [[3, 3]]), 1), 4).first()
    assert (flat.lev, flat.rec) == (0, 3.0)


def test_standardise(spark):
    y = drives(spark, [[1, 2, 5], [3, 2, 7]])
    s = {r.cell: (r.mean, r.sd) for r in encode.cell_stats(y, ids(spark, 0, 1)).collect()}
    assert s == {0: (2.0, 1.0), 1: (2.0, 0.0), 2: (6.0, 1.0)}
    z = {(r.item_id, r.cell): r.y for r in encode.standardise(y, encode.cell_stats(y, ids(spark, 0, 1))).collect()}
    assert z[0, 1] == z[1, 1] == 0 and z[0, 0] == -1000


def test_overlap_and_angles(spark):
    sets = spark.createDataFrame([(0, [0, 1]), (1, [1, 2]), (2, [3, 4])], "item_id long, cells array<long>")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (0, 0), (1, 2)], "a long, b long")
    assert {(r.a, r.b): r.overlap for r in collision.pair_overlap(pairs, sets).collect()} == {(0, 1): 0.5, (0, 2): 0.0, (0, 0): 1.0, (1, 2): 0.0}
    v = spark.createDataFrame([(0, [1, 0]), (1, [0, 2]), (2, [-3, 0]), (3, [1000000, 1732051])], "item_id long, q array<long>")
    p = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (0, 0)], "a long, b long")
    assert [round(r.angle, 4) for r in collision.angles(p, v).orderBy("b").collect()] == [0.0, 90.0, 180.0, 60.0]


def test_curve_and_half(spark):
    x = spark.createDataFrame([(0.5, 1.0), (1.5, 0.0), (2.5, 0.5), (3.9, 0.5), (7.0, 0.2)], "angle double, value double")
    assert [(r.lower, r.mean_angle, r.mean_value, r.pairs) for r in collision.curve(x, 2.0).orderBy("lower").collect()] == [(0.0, 1.0, 0.5, 2), (2.0, 3.2, 0.5, 2), (6.0, 7.0, 0.2, 1)]
    b = lambda *v: spark.createDataFrame([(5.0 + 10 * i, y, 10) for i, y in enumerate(v)], "mean_angle double, mean_value double, pairs long")
    r = collision.theta_half(b(1.0, 0.7, 0.4, 0.2)).first()
    assert isclose(r.theta, round(15 + 20 / 3, 6)) and r.status == "ok"
    assert collision.theta_half(b(0.9, 0.5, 0.2)).first().theta == 15.0
    assert [collision.theta_half(x).first().status for x in (b(0.4, 0.2), b(0.9, 0.8), b(0.9).limit(0))] == ["below_range", "above_range", "no_bins"]
    two = collision.theta_half(b(0.9, 0.3, 0.8, 0.1)).first()
    assert two.crossings == 2 and two.theta < 15
    v = spark.createDataFrame([(0, [1, 0]), (1, [-1, 0]), (2, [0, 1]), (3, [0, -1])], "item_id long, q array<long>")
    assert collision.participation(v).first().participation == 2.0


def test_inference(spark):
    real = spark.createDataFrame([("a", 100.0)], "k string, value double")
    null = spark.createDataFrame([("a", float(i)) for i in range(10)], "k string, value double")
    r = inference.randomization(real, null, ["k"]).first()
    assert (r.p_upper, r.p_lower, r.p_two) == (round(1 / 11, 9), 1.0, round(2 / 11, 9))
    t = inference.randomization(real.withColumn("value", F.lit(1.0)), spark.createDataFrame([("a", v) for v in (1.0, 1.0, 2.0)], "k string, value double"), ["k"]).first()
    assert (t.p_lower, t.p_upper) == (0.75, 1.0)
    p = spark.createDataFrame([("f", "x", 0.01), ("f", "y", 0.04), ("f", "z", 0.03), ("g", "x", 0.5), ("g", "y", 0.9)], "fam string, key string, p double")
    assert {(r.fam, r.key): r.adjusted for r in inference.holm(p, ["fam"], "key").collect()} == {("f", "x"): 0.03, ("f", "y"): 0.06, ("f", "z"): 0.06, ("g", "x"): 1.0, ("g", "y"): 1.0}
    e = spark.createDataFrame([(-0.02, 0.01), (-0.06, 0.01), (-0.02, 0.05)], "low double, high double")
    assert [r.equivalent for r in inference.equivalence(e, 0.05).collect()] == [True, False, False]
    m = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 0.6), ("c", 2, 0.6), ("d", 3, 0.9)], "m string, cost int, q double")
    assert {r.m for r in inference.pareto(m, ["cost"], "q").collect()} == {"b", "d"}
    one = lambda v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "trial long, value double")
    c = inference.contrast_bootstrap(one([1.1, 1.2, 1.0, 1.1]), one([1.0] * 4), 100, 4, 1).first()
    assert isclose(c.gap, 10.0) and c.low <= c.gap <= c.high
    rivals = spark.createDataFrame([("x", i, v) for i, v in enumerate((2.0, 0.0, 2.0, 0.0))] + [("y", i, v) for i, v in enumerate((0.0, 2.0, 0.0, 2.0))], "arm string, trial long, value double")
    b = inference.ratio_to_best(one([1.0] * 4), rivals, 100, 4, 1).first()
    assert b.ratio == 1.0 and b.high <= 1.0


def test_numbers():
    assert [numbers.storage_bits(*x) for x in ((4, 2), (5, 1), (8, 4), (1838, 64))] == [3, 3, 7, 397]
    assert numbers.fixed_bits(9, 2) == 8 and [numbers.value_winners(b, 3000) for b in (23, 252, 15)] == [1, 15, 0]
    assert numbers.pq_layout(23, 300) == [8, 8, 7] and len(numbers.pq_layout(288, 35)) == 35 and set(numbers.pq_layout(288, 35)) == {8, 9}
    assert isclose(numbers.t_quantile(0.975, 9), 2.2621571628, rel_tol=1e-8) and isclose(numbers.upper_normal(0.025), 1.959963984540054)
    lo, hi = numbers.clopper_pearson(5, 10)
    assert isclose(lo, 0.1870860284, abs_tol=1e-8) and isclose(hi, 0.8129139716, abs_tol=1e-8)
    lo, hi = numbers.wilson(100, 100)
    assert round(lo, 2) == 0.96 and isclose(hi, 1.0)
    cases = [([3, 2, 0], [2, 2, 1]), ([4, 1, 0], [2, 2, 1]), ([2, 2, 1], [3, 1, 1]), ([3, 2, 0], [3, 1, 1]), ([2, 2, 2], [3, 1, 1])]
    assert [numbers.gale_ryser(*c) for c in cases] == [True, False, True, False, False]


def test_generators_keep_their_margins(spark):
    g = np.random.default_rng(3)
    w = spark.createDataFrame([(int(i), int(j), int(g.integers(1, 9))) for j in range(40) for i in g.choice(8, g.integers(1, 6), replace=False)], "dim long, cell long, w long").cache()
    row, col = ({r[0]: r["count"] for r in w.groupBy(c).count().collect()} for c in ("dim", "cell"))
    weight = {r.cell: r.w for r in w.groupBy("cell").agg(F.sum("w").alias("w")).collect()}
    start = wiring.co_occurrence(w).first().four_cycles
    cb = generators.curveball(w, 3).cache()
    for d in range(3):
        for made in (cb, generators.margin_control(w, 3, False, False), generators.diversify(w, 3)):
            x = made.filter(F.col("draw") == d)
            assert ({r.dim: r["count"] for r in x.groupBy("dim").count().collect()}, {r.cell: r["count"] for r in x.groupBy("cell").count().collect()}) == (row, col)
        assert {r.cell: r.w for r in cb.filter(F.col("draw") == d).groupBy("cell").agg(F.sum("w").alias("w")).collect()} == weight
    dv = generators.diversify(w, 1).select("dim", "cell", "w")
    assert wiring.co_occurrence(dv).first().four_cycles < start
    even = generators.margins(generators.margin_control(w, 2, True, True)).groupBy("draw", "side").agg((F.max("n") - F.min("n")).alias("gap"), F.sum("n").alias("n")).collect()
    assert all(r.gap <= 1 and r.n == sum(row.values()) for r in even)
    assert sorted(map(repr, cb.collect())) == sorted(map(repr, generators.curveball(w.repartition(3), 3).collect()))


def test_allocation():
    half, five = np.full(30, 2), np.array([4.0, 1.0, 0.25, 1.0])
    for alpha in (-1.0, 0.0, 0.5, 1.0, 3.0, np.inf):
        assert generators.power_allocation(five, alpha, half).tolist() == [15] * 4  # half of the cells, and no more places
    assert generators.power_allocation(np.ones(6), np.inf, half).tolist() == [10] * 6
    assert generators.power_allocation(np.array([9.0, 4, 2, 1, 0.5, 0.1]), -1.0, half).tolist()[2:] == sorted(generators.power_allocation(np.array([9.0, 4, 2, 1, 0.5, 0.1]), -1.0, half).tolist()[2:])
    assert generators.power_allocation(np.array([1.0, 0, 0, 0, 0, 0]), 2.0, np.full(30, 3)).tolist() == [15] * 6
    wide = generators.power_allocation(np.r_[[4.0, 3, 2, 1], np.zeros(60)], 2.0, np.full(640, 6))
    assert wide[:4].tolist() == [320] * 4 and wide.sum() == 3840 and np.ptp(wide[4:]) <= 1
    assert generators.power_allocation(np.array([3.0, 1.0]), 1.0, np.full(40, 1), 40).tolist() == [30, 10]
    assert generators.power_allocation(np.array([2.0, 1.0, 1.0]), -1.0, np.full(50, 1), 50).tolist() == [10, 20, 20]
    for bad in ([1.0, np.nan], [-1.0, 1.0], [np.inf, 1.0]):
        with pytest.raises(ValueError):
            generators.power_allocation(np.array(bad), 1.0, half, 30)
    with pytest.raises(ValueError):
        generators.power_allocation(np.ones(3), 1.0, np.full(30, 2))
    with pytest.raises(ValueError):
        generators.power_allocation(np.ones(6), -np.inf, half)


def test_allocations_of_random_spectra():
    """Every allocation ends, holds all entries within the bounds of a matrix, follows the spectrum, and treats equals alike."""
    g, done = np.random.default_rng(5), 0
    while done < 1000:
        d, m = int(g.integers(1, 25)), int(g.integers(1, 60))
        lam = [g.random(d), np.arange(1, d + 1.0) ** -g.uniform(0, 4), np.where(g.random(d) < 0.5, 0, g.random(d)), g.integers(0, 3, d).astype(float), 10.0 ** g.uniform(-300, 300, d)][int(g.integers(5))]
        c = g.integers(0, d + 1, m) if g.random() < 0.7 else np.full(m, int(g.integers(0, d + 1)))
        alpha, top = float(g.choice([-3, -1, -0.5, 0, 0.5, 1, 2, 8, np.inf])), int(g.choice([max(1, m // 2), m]))
        if generators.room(c, d, top)[-1] < c.sum():
            continue
        f = generators.power_allocation(lam, alpha, c, top)
        assert f.sum() == c.sum() and f.min() >= 0 and f.max() <= top and numbers.gale_ryser(f.tolist(), c.tolist())
        value = np.maximum(lam, 1e-300)
        groups = [f[value == v] for v in np.unique(value)[::-1]]
        assert all(np.ptp(x) <= 1 for x in groups)
        for x, y in zip(groups, groups[1:], strict=False):
            assert alpha == 0 or (x.min() >= y.max() if alpha > 0 else x.max() <= y.min())
        done += 1


def test_matrices_of_margins_alone():
    g, found = np.random.default_rng(6), 0
    for _ in range(1500):
        d, m = int(g.integers(1, 6)), int(g.integers(1, 7))
        r, c = g.integers(0, m + 1, d), g.integers(0, d + 1, m)
        if g.random() < 0.8:
            r = np.bincount(g.integers(0, d, c.sum()), minlength=d)
        if numbers.gale_ryser(r.tolist(), c.tolist()):
            e = generators.matrix_of(r, c, g)
            assert (e.sum(axis=1) == r).all() and (e.sum(axis=0) == c).all()
            found += 1
        else:
            with pytest.raises(ValueError):
                generators.matrix_of(r, c, g)
    assert 300 < found < 1200


def test_realise(spark):
    rows = [("x", "dim", 5, 3), ("x", "dim", 6, 1), ("x", "cell", 1, 2), ("x", "cell", 2, 1), ("x", "cell", 3, 1), ("y", "dim", 5, 1), ("y", "cell", 9, 1)]
    m = spark.createDataFrame(rows, "k string, side string, id long, n long")
    got = generators.realise(m, 3, by=["k"]).collect()
    assert {(r.k, r.draw) for r in got} == {(k, i) for k in "xy" for i in range(3)}
    for i in range(3):
        mine = [r for r in got if (r.k, r.draw) == ("x", i)]
        assert {(r.dim, r.cell) for r in mine} == {(5, 1), (5, 2), (5, 3), (6, 1)} and all(r.w == 1 for r in mine)
    with pytest.raises(Exception, match="no 0/1 matrix"):
        generators.realise(spark.createDataFrame([("dim", 1, 2), ("cell", 1, 2)], "side string, id long, n long"), 1).collect()


def test_competition_and_completion():
    units, rows = np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]), np.array([[2.0, 1.0, 0.0]])
    rule = learn.Competition(rank=2, push=0.5, power=2.0)
    assert rule.currents(units, rows).tolist() == [[2.0, 1.0]]
    # the first unit moves to (2, 1, 0) less twice itself, the second away from it by half, its own current back
    assert rule.change(units, rows).tolist() == [[0.0, 1.0, 0.0], [-1.0, 0.0, 0.0]]
    assert (rule.fit(rows, np.array([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]), 2, 0.1)[:, 2] == 0).all()  # entries at zero stay there
    x = np.outer([1.0, 2, 3, 4], [1.0, 2, 3])
    y = x.copy()
    y[1, 1] = np.nan
    assert abs(learn.complete(y, 1, 2000)[1, 1] - 4.0) < 1e-2


def test_pca_and_pq(spark):
    g = np.random.default_rng(1)
    x = (g.standard_normal((60, 4)) * [5, 2, 1, 0.5] * 1000).astype(int)
    it = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "item_id long, q array<long>")
    mean, comp, val = learn.pca(it, it.select("item_id"), 4, 2)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(val, np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1][:2])
    assert (comp[np.arange(2), np.abs(comp).argmax(axis=1)] > 0).all()
    books = [(np.array([0]), np.array([[0.0], [10.0]])), (np.array([1, 2]), np.array([[1.0, 1.0], [-1.0, -1.0]]))]
    c = spark.createDataFrame([(0, [0, 0]), (1, [1, 1]), (2, [0, 0])], "item_id long, codes array<int>")
    q = spark.createDataFrame([(9, [0, 1, 1])], "item_id long, q array<long>")
    assert {r.item_id: r.d for r in learn.pq_adc(c, q, q.select("item_id"), books).collect()} == {0: 0.0, 1: 108.0, 2: 0.0}


def test_components_and_dense_index(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)], "u long, v long")
    assert {r.node: r.component for r in components(e).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    x = spark.createDataFrame([(v,) for v in (5, 3, 9, 3, 7)], "c long")
    assert sorted({(r.c, r.i) for r in wiring.dense_index(x, "c", "i").collect()}) == [(3, 0), (5, 1), (7, 2), (9, 3)]


def test_selector(spark):
    n = spark.createDataFrame([(1, "KC_a", "L"), (2, "PN_b", "L"), (3, "KC_c", "R")], "id long, kind string, side string")
    assert [r.id for r in wiring.select_nodes(n, kind_regex="KC", side=["L", "R"]).orderBy("id").collect()] == [1, 3]
    with pytest.raises(ValueError):
        wiring.select_nodes(n, colour="x")
    assert wiring.select_nodes(n, max_n=2).count() == 2


def test_breadth_ignores_what_is_missing(spark):
    r = spark.createDataFrame([(0, "a", 0.5), (3, "a", 0.1), (0, "b", 0.0), (1, "b", 0.5), (2, "b", 0.0), (3, "b", 0.5)], "item long, dim string, v double")
    assert {x.dim: x.b for x in r.groupBy("dim").agg(F.avg((F.col("v") > 0.2).cast("int")).alias("b")).collect()} == {"a": 0.5, "b": 0.5}
    assert isclose(sqrt(4), 2)


def test_components_of_the_whole_graph(spark, tmp_path):
    """Light edges join components too, and their nodes are not left out."""
    from sparsewing import catalog

    at = str(tmp_path)
    lines = [(1, 1, 200), (1, 2, 3), (2, 2, 1), (2, 3, 160), (3, 4, 1), (4, 5, 149)]
    spark.createDataFrame([(s, p, q, "N") for s, p, q in lines], "l_suppkey long, l_partkey long, l_quantity long, l_returnflag string").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(s, s) for s in range(1, 6)], "s_suppkey long, s_nationkey int").write.parquet(f"{at}/supplier.parquet")
    spark.createDataFrame([(n, f"n{n}", 0) for n in range(1, 6)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{at}/nation.parquet")
    spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string").write.parquet(f"{at}/region.parquet")
    got = {r.node: r.component for r in catalog.QUERIES["wcc_all"](spark, at).collect()}
    want = {}
    for s, p, _ in lines:  # brute force: labels fall until nothing changes
        want |= {s: s, 1000 + p: 1000 + p}
    for _ in want:
        for s, p, _ in lines:
            want[s] = want[1000 + p] = min(want[s], want[1000 + p])
    assert got == want and len(set(want.values())) == 3
    assert 3 not in {r.node for r in catalog.QUERIES["wcc"](spark, at).collect()}


def test_null_models_cover_the_measured_wiring(spark):
    """No entry of the default wiring is left out of the random wirings and their statistic."""
    from sparsewing import catalog
    from sparsewing.operators import wiring as w
    from sparsewing.plans.wirings import measured

    sf = "/root/testdata/sf0.001"
    q = {r.draw: r.q for r in catalog.QUERIES["curveball_q"](spark, sf).collect()}
    assert q[-1] == w.co_occurrence(measured(spark, sf)).first().q and len(q) == 6
    cells = {r.cell for r in measured(spark, sf).select("cell").distinct().collect()}
    assert {r.id for r in catalog.QUERIES["curveball_margins_all"](spark, sf).filter("side = 'cell'").collect()} == cells
