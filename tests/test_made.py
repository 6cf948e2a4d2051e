"""Made data, revisions and resampling against plain restatements."""

from math import isclose, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparsewing.operators import inference, overlay, synthetic


def test_moments_of_draws(spark):
    x = spark.range(20_000).select(*[synthetic.gamma(s, "g", 1, "id", s).alias(f"g{s}") for s in (1, 3)]).toPandas() / 1e9
    for s in (1, 3):
        v = x[f"g{s}"]
        assert v.min() >= 0 and abs(v.mean() - s) < 0.05 and abs(v.var() - s) < 0.2
    assert abs((x.g1 > log(2)).mean() - 0.5) < 0.02
    with pytest.raises(ValueError):
        synthetic.gamma(0, "g", "id")


def test_distinct_choices(spark):
    """Every pair of five positions about equally often; all of them where as many are wanted as there are."""
    x = spark.range(20_000).select(synthetic.chosen(F.lit(5), F.lit(2), 4, "c", "id").alias("p")).collect()
    seen = {}
    for r in x:
        assert len(set(r.p)) == 2 and all(0 <= i < 5 for i in r.p)
        seen[frozenset(r.p)] = seen.get(frozenset(r.p), 0) + 1
    assert len(seen) == 10 and max(abs(n / 20_000 - 0.1) for n in seen.values()) < 0.012
    assert sorted(spark.range(1).select(synthetic.chosen(F.lit(3), F.lit(3), 5, "c", "id").alias("p")).first().p) == [0, 1, 2]


def test_dirichlet_weights(spark):
    rows = synthetic.dirichlet(spark.range(6000).withColumnRenamed("id", "mix"), 50, 3, 3, 1, 2).toPandas()
    g = rows.groupby("mix")
    assert (g.part.nunique() == 3).all() and (g.weight.sum().between(999_997, 1_000_000)).all()
    w = rows.weight / 1e6
    assert abs(w.mean() - 1 / 3) < 1e-4 and abs(w.var() - 2 / (9 * 4)) < 0.003  # (k - 1) / (k^2 (k + 1))
    heavy = synthetic.dirichlet(spark.range(6000).withColumnRenamed("id", "mix"), 50, 3, 3, 4, 2).toPandas().weight / 1e6
    assert abs(heavy.var() - 2 / (9 * 13)) < 0.002
    few = synthetic.dirichlet(spark.range(50).withColumnRenamed("id", "mix"), 2, 2, 5, 1, 2).toPandas()
    assert (few.groupby("mix").part.nunique() == 2).all()


def test_mixtures_are_sums_of_their_parts(spark):
    items = spark.createDataFrame([(10, [1, 2]), (20, [3, 0]), (30, [0, 5])], "item_id long, q array<long>")
    parts, v = synthetic.mixtures(items, 40, 2, 3, seed=1)
    q = {10: (1, 2), 20: (3, 0), 30: (0, 5)}
    want = {}
    for r in parts.collect():
        for j in (0, 1):
            want[r.mix, j] = want.get((r.mix, j), 0) + r.weight * q[r.item_id][j]
    assert {(r.mix, r.dim): r.v for r in v.collect()} == want and len(want) == 80


def test_power_law(spark):
    x = np.array([r.q for r in synthetic.power_law(spark, 4000, 6, 2.0, 1).collect()])
    assert np.allclose(x.std(axis=0) / x.std(axis=0)[0], 1 / np.arange(1, 7), rtol=0.06) and np.abs(np.corrcoef(x.T) - np.eye(6)).max() < 0.06


BASE = [(1, "a", 5, "x"), (2, None, 6, "y"), (3, "c", None, "z")]
SCHEMA = "id long, name string, n int, other string"


def test_overlay(spark):
    base = spark.createDataFrame(BASE, SCHEMA)
    r1 = spark.createDataFrame([(1, 50), (2, None)], "id long, n int")
    r2 = spark.createDataFrame([(1, "A", None), (3, None, 7), (2, None, None)], "id long, name string, n long")
    got = {r.id: tuple(r)[1:] for r in overlay.overlay(base, [("one", r1), ("two", r2)], ["id"]).collect()}
    assert got == {1: ("A", 50, "x", ["one", "two"]), 2: (None, 6, "y", []), 3: ("c", 7, "z", ["two"])}
    r3 = spark.createDataFrame([(1, 60), (3, 7)], "id long, n int")
    got = sorted(map(tuple, overlay.history(base, [("one", r1), ("two", r2), ("three", r3)], ["id"]).collect()))
    assert got == [(1, "n", 1, "one", "5", "50"), (1, "n", 2, "three", "50", "60"), (1, "name", 1, "two", "a", "A"), (3, "n", 1, "two", None, "7")]


def test_overlay_refusals(spark):
    base = spark.createDataFrame(BASE, SCHEMA)
    one = lambda rows, s="id long, n int": [("r", spark.createDataFrame(rows, s))]
    with pytest.raises(Exception, match="unknown key"):
        overlay.overlay(base, one([(9, 1)]), ["id"]).collect()
    with pytest.raises(Exception, match="twice"):
        overlay.overlay(base, one([(1, 1), (1, 1)]), ["id"]).collect()
    with pytest.raises(ValueError, match="no column"):
        overlay.overlay(base, one([(1, 1)], "id long, size int"), ["id"])
    with pytest.raises(ValueError, match="lacks the key"):
        overlay.overlay(base, [("r", spark.createDataFrame([(1,)], "n int"))], ["id"])
    with pytest.raises(ValueError, match="no revisions"):
        overlay.overlay(base, [], ["id"])


def _h(*parts):
    import hashlib

    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def test_two_stage_and_coverage_in_plain_loops(spark):
    import hashlib

    g, n, draws = np.random.default_rng(1), 12, 4
    v = {d: g.random(n) + (0.2 if d < 0 else 0) for d in range(-1, draws)}
    scores = spark.createDataFrame([(d, 100 + t, float(x)) for d, xs in v.items() for t, x in enumerate(xs)], "draw long, trial long, value double").withColumn("k", F.lit(8).cast("long"))
    trials = spark.createDataFrame([(100 + t, t) for t in range(n)], "trial long, pos long")
    first = lambda *p: sorted(range(draws), key=lambda d: hashlib.md5(f"sub:{p[0]}:{d}:{':'.join(map(str, p[1:]))}".encode()).hexdigest())[:2]
    rel = []
    for r in range(15):
        at = [_h("boot", 3, r, s) % n for s in range(n)]
        rel.append(v[-1][at].sum() / np.mean([v[d][at].sum() for d in first(3, r)]) - 1)
    got = inference.two_stage_by(scores, trials, 15, 2, ["k"], 3).first()
    assert isclose(got.rel_low, np.quantile(rel, 0.05), abs_tol=1e-8) and isclose(got.rel_high, np.quantile(rel, 0.95), abs_tol=1e-8)
    truth = v[-1].sum() / np.mean([v[d].sum() for d in range(draws)]) - 1
    covered, widths = 0, []
    for a in range(6):
        have, rel = [_h("data", 3, a, s) % n for s in range(n)], []
        for r in range(10):
            at = [have[_h("boot", 3, a, r, s) % n] for s in range(n)]
            rel.append(v[-1][at].sum() / np.mean([v[d][at].sum() for d in first(3, a, r)]) - 1)
        lo, hi = np.quantile(rel, [0.05, 0.95])
        covered += lo <= truth <= hi
        widths.append(hi - lo)
    got = inference.coverage_study(scores.drop("k"), trials, 6, 10, 2, 3).first()
    assert (got.n, got.k) == (6, covered) and isclose(got.truth, truth, abs_tol=1e-8) and isclose(got.median_width, np.median(widths), abs_tol=1e-8)
    assert 0 <= got.low <= got.share <= got.high <= 1
