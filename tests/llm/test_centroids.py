"""Centroid clustering against plain rounds over Python's whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from sparsewing.llm import centroids


def plain(rows, k=40, rounds=5):
    """(vec_id, cluster, distance), the centroids."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    c = [q for _, q in order[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, x, strict=True)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        for j in range(len(c)):
            mine = [q for (_, q), o in zip(kept, of, strict=True) if o == j]
            if mine:
                c[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, near(q)[1], near(q)[0]) for i, q in kept], c


def frame(spark, rows, n=3):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(n)


def vectors(n, seed, spread=1.0):
    g = random.Random(seed)
    middle = [[g.gauss(0, spread) for _ in range(64)] for _ in range(9)]
    return [(i, [m + g.gauss(0, 0.2) for m in g.choice(middle)]) for i in range(n)]


def test_against_plain_rounds(spark):
    rows = vectors(300, 1) + [(1000 + i, [0.5] * 64) for i in range(60)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [math.nan] + [0.0] * 63), (2005, [math.inf] + [0.0] * 63), (2006, [None] + [0.0] * 63), (7, rows[7][1]), (None, [0.25] * 64)]
    want, c = plain(rows)
    got = centroids.described(frame(spark, rows)).collect()
    by_id = lambda x: (x[0] is None, x)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=by_id) == sorted(want, key=by_id)
    inertia = {j: sum(d for _, o, d in want if o == j) for j in range(len(c))}
    for r in got:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()
        assert (r.cluster_inertia, r.inertia) == (inertia[r.cluster], sum(inertia.values()))
    again = centroids.described(frame(spark, rows, 1)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))


def test_few_equal_and_no_vectors(spark):
    assert centroids.described(frame(spark, [])).count() == 0
    assert centroids.described(frame(spark, [(1, None), (2, [0.0])])).count() == 0
    rows = [(i, [1.0] * 64) for i in range(5)]  # five centroids in one place: the smallest number takes all, the others stay
    got = centroids.described(frame(spark, rows).withColumn("cluster", 0 * centroids.F.col("vec_id")).withColumn("q", centroids.F.lit("x"))).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 5


def test_components_at_the_edge(spark):
    rows = [(1, [2.0**19 - 1] * 64), (2, [-(2.0**19) + 1] * 64), (3, [2.0**19] * 64), (4, [1e300] + [0.0] * 63)]
    got = {r.vec_id: (r.distance, r.inertia) for r in centroids.described(frame(spark, rows), k=1, rounds=0).collect()}
    far = 64 * (2 * 256 * (2**19 - 1)) ** 2
    assert got == {1: (got[1][0], far), 2: (got[2][0], far)} and {got[1][0], got[2][0]} == {0, far}


@pytest.mark.parametrize("spread", [0.01, 1.0, 1000.0])
def test_the_screen_spares_distances_and_changes_none(spread):
    g = np.random.default_rng(3)
    q = np.floor(256 * np.array([v for _, v in vectors(500, 2, spread)])).astype(np.int64)
    c = np.concatenate([q[g.choice(500, 39, replace=False)], q[:1]])
    best, d, exact = centroids.nearest(q, centroids.compress(q), c, centroids.compress(c))
    every = ((q[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    low = ((centroids.compress(q)[:, None, :] - centroids.compress(c)[None, :, :]) ** 2).sum(axis=2)
    assert (low <= every * (1 + 1e-9) + 1).all()
    assert exact.max() <= 40 and (spread < 1 or exact.mean() < 15)
