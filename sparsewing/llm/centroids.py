"""Centroid clustering in whole numbers, screened by block norms.

A vector of ``DIMS`` components becomes whole numbers, floor(256 * x). Its segments of ``SEGMENT`` components are compressed
once into their sums and the norms of what the means leave. For a segment, with sums a and b, norms r and t and n components,
Cauchy-Schwarz gives

    |v - c|^2 >= (a - b)^2 / n + (r - t)^2,

and the sum over segments bounds the squared distance from below. The centroid with the least bound gets its exact distance
first; only centroids whose bound does not exceed it get theirs, in 64-bit integers. Bounds are floats with a margin for
rounding, so they never decide between two centroids, only spare a distance that is certainly greater: results are exact.

Each round is one scan of the stored vectors; a task adds up counts and sums per cluster, so what is shuffled and
collected is a row per cluster and task, and per cluster. Nothing depends on the number of rows in a cluster.

Edge cases: vectors that are null, of another length, or hold null or non-finite components are left out, as are those with
a component of 2**19 or more in size, whose squared distances no long can hold; repeated rows are vectors of their own; a
null id is clustered but starts no centroid; equal starting hashes order by the components; fewer vectors than centroids
give fewer centroids; ties go to the smaller number; a sum of distances that no long can hold is null; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewing.llm.common import bound_batches, write_table

DIMS, SEGMENT, SCALE, LARGEST = 64, 8, 256, 2.0**19
ROWS, PAIRS = 4096, 1 << 15


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, q): the vectors that count, as whole numbers."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = (F.size("x") == DIMS) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(F.col("x").isNotNull()).filter(fine)
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * SCALE).cast("int")).alias("q"))


def compress(q: np.ndarray) -> np.ndarray:
    """Rows of whole numbers to rows of (segment sums / sqrt(n), residual norms): distances between such rows are the bound."""
    s = q.reshape(len(q), -1, SEGMENT).astype(np.float64)
    total = s.sum(axis=2)
    left = np.maximum((s * s).sum(axis=2) - total * total / SEGMENT, 0.0)
    return np.concatenate([total / np.sqrt(SEGMENT), np.sqrt(left)], axis=1)


def _lists(col: pa.Array, width: int, kind) -> np.ndarray:
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(len(col), width)


def _compressed(batches):
    for b in batches:
        q = _lists(b.column(1), DIMS, np.int64)
        c = compress(q)
        offsets = pa.array(np.arange(len(c) + 1, dtype=np.int32) * c.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(c.ravel()))], names=["vec_id", "q", "norms"])


def nearest(q: np.ndarray, norms: np.ndarray, centroids: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the nearest centroid, exact squared distance and how many exact distances it took, for each row."""
    size = (norms * norms).sum(axis=1)[:, None] + (small * small).sum(axis=1)[None, :]
    low = size - 2.0 * (norms @ small.T)
    low -= size * 1e-9 + 1.0  # more than rounding can add
    row = np.arange(len(q))
    best = low.argmin(axis=1)
    d = ((q - centroids[best]) ** 2).sum(axis=1)
    open_ = low <= d[:, None]
    open_[row, best] = False
    i, j = np.nonzero(open_)
    far = np.full(low.shape, np.iinfo(np.int64).max)
    far[row, best] = d
    for at in range(0, len(i), PAIRS):
        a, b = i[at : at + PAIRS], j[at : at + PAIRS]
        far[a, b] = ((q[a] - centroids[b]) ** 2).sum(axis=1)
    best = far.argmin(axis=1)  # the first of equal ones
    return best, far[row, best], 1 + np.bincount(i, minlength=len(q))


def _blocks(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            s = b.slice(at, ROWS)
            yield s, _lists(s.column(1), DIMS, np.int64), _lists(s.column(2), 2 * DIMS // SEGMENT, np.float64)


def _sums(batches, centroids: np.ndarray):
    """A row per cluster that the task has met: its count and sums."""
    k, small = len(centroids), compress(centroids)
    n, s = np.zeros(k, np.int64), np.zeros((k, DIMS), np.int64)
    for _, q, norms in _blocks(batches):
        best = nearest(q, norms, centroids, small)[0]
        n += np.bincount(best, minlength=k)
        order = np.argsort(best, kind="stable")
        at = np.searchsorted(best[order], np.unique(best))
        s[np.unique(best)] += np.add.reduceat(q[order], at, axis=0)
    met = np.flatnonzero(n)
    cols = [pa.array(met, pa.int32()), pa.array(n[met]), pa.array(s[met].tolist(), pa.list_(pa.int64()))]
    yield pa.RecordBatch.from_arrays(cols, names=["cluster", "n", "s"])


def _assigned(batches, centroids: np.ndarray):
    small = compress(centroids)
    for b, q, norms in _blocks(batches):
        best, d, exact = nearest(q, norms, centroids, small)
        cols = [b.column(0), pa.array(best, pa.int32()), pa.array(d), pa.array(exact, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "cluster", "distance", "exact"])


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the floor of every cluster's mean; empty clusters stay. A row per cluster comes back."""
    part = vectors.mapInArrow(partial(_sums, centroids=centroids), "cluster int, n long, s array<long>")
    per = part.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(DIMS)]).alias("s"))
    out = centroids.copy()
    for r in per.collect():
        out[r.cluster] = [x // r.n for x in r.s]
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2) -> tuple[DataFrame, np.ndarray]:
    """``vectors`` (vec_id, embedding) to (vec_id, cluster, distance, exact) and the final centroids. ``exact``: the exact
    distances that the vector took."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = write_table(quantised(vectors).mapInArrow(_compressed, "vec_id long, q array<int>, norms array<double>"), "vectors")
    first = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = rows.filter("vec_id is not null").select("q", first.alias("h")).orderBy("h", "q").limit(k).collect()  # k rows
    if not start:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, exact int"), np.zeros((0, DIMS), np.int64)
    c = np.array([r.q for r in start], dtype=np.int64)
    for _ in range(rounds):
        c = moved(rows, c)
    return rows.mapInArrow(partial(_assigned, centroids=c), "vec_id long, cluster int, distance long, exact int"), c


def described(vectors: DataFrame, **how) -> DataFrame:
    """The clusters with the sums of their distances and the digests of their centroids."""
    spark = vectors.sparkSession
    got, c = cluster(vectors, **how)
    got = write_table(got.select("vec_id", "cluster", "distance"), "clusters")
    digests = [(i, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for i, row in enumerate(c.tolist())]
    per = got.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia"))
    per = per.crossJoin(F.broadcast(per.agg(F.try_sum("cluster_inertia").alias("inertia"))))  # one row
    per = per.join(F.broadcast(spark.createDataFrame(digests, "cluster int, centroid_sha256 string")), "cluster")  # k rows
    return got.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
