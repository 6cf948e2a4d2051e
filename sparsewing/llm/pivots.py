"""Near-duplicate vectors through a pivot-permutation index.

Reference points (pivots) are vectors with small hashes of their ids, ``max(64, sqrt(n) / 2)`` of them, spread out: of
``POOL`` times as many candidates, those within twice the threshold's angle of an earlier one are passed over. They only
shape the index; every vector is indexed, in one of two ways.

A vector within twice the threshold's angle of its nearest pivot has this pivot as its home. Whatever is within the
threshold of it lies, by the triangle inequality, within three times the angle of its home, and all vectors that near to
a pivot are in the pivot's own list. So no link of a vector with a home is missed, however dense its surroundings are.

Vectors without a home are described by their ``NEAREST`` pivots (cosine). Their lists are keyed by pairs of pivots, so two
of them meet as soon as their nearest pivots have two in common, and once for every further shared pair; a pair is judged
only under the smallest pair of its shared pivots. Vectors within the threshold, both without a home, that share fewer
than two of their nearest pivots are missed; the tests measure recall against brute force (at least 0.9 is asked; it is
1 on the test tables).

Judging computes the cosine in double precision and keeps pairs at or above the threshold. No pair leaves its task: a task
returns how many vectors each vector is linked with and a spanning forest of its links. Long lists are cut into blocks
of ``ROWS`` vectors (a pivot's own list of ``HOME_ROWS``), block pairs are dealt over buckets, and equal vectors of one label are one entry with a count.

Edge cases: null labels, null or zero vectors and vectors with null or non-finite components link with nothing; vectors
of different length are never compared; repeated rows are vectors of their own; a null id counts as a link of others, and
stays kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import partial
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewing.llm.common import bound_batches, checkpoint, partitions
from sparsewing.llm.graph import components

NEAREST, ROWS, HOME_ROWS, POOL, SLICE = 6, 512, 2048, 4, 1024


def _spread(x: np.ndarray, n: int, within: float) -> np.ndarray:
    """At most ``n`` rows of ``x`` in order, none with a cosine of ``within`` or more to an earlier one."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    got = np.zeros((min(n, len(x)), x.shape[1]))
    k = 0
    for r in x:
        if k == len(got):
            break
        if not k or (got[:k] @ r).max() < within:
            got[k] = r
            k += 1
    return got[:k]


def _slices(frames):
    """Vectors of one length, at most SLICE at a time, which bounds the table of their cosines with the pivots."""
    for f in frames:
        for d, g in f.groupby(f.embedding.map(len)):
            for at in range(0, len(g), SLICE):
                yield d, g.iloc[at : at + SLICE]


def _describe(frames, pivots: np.ndarray, angle: float, kind: type):
    """Keys of each class: the pivots within three times the angle, as pairs of equals, and without a home every pair of its
    nearest pivots. ``kind``: the type of the table's components, which go along as they are."""
    k = min(NEAREST, len(pivots))
    for d, g in _slices(frames):
        x = np.stack(g.embedding.to_numpy()).astype(np.float64)
        p = np.zeros((len(pivots), d))
        p[:, : min(d, pivots.shape[1])] = pivots[:, :d]
        p /= np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300)
        s = np.round(x / np.linalg.norm(x, axis=1, keepdims=True) @ p.T, 12)
        near = np.argsort(-s, axis=1, kind="stable")[:, :k].astype(np.int32)
        low = np.sort(near, axis=1)
        home = np.where(s[np.arange(len(s)), near[:, 0]] >= np.cos(min(2 * angle, np.pi)), near[:, 0], -1).astype(np.int32)
        raw = np.array([*(r.tobytes() for r in x.astype(kind)), None], dtype=object)[:-1]
        desc = np.array([*(r.tobytes() for r in low), None], dtype=object)[:-1]

        def rows(at, a, b, g=g, d=d, raw=raw, desc=desc, home=home):
            return pd.DataFrame({"label": g.label.to_numpy()[at], "d": d, "a": a, "b": b, "cid": g.cid.to_numpy()[at], "rows": g.rows.to_numpy()[at], "x": raw[at], "desc": desc[at], "home": home[at]})

        at, own = np.nonzero(s >= np.cos(min(3 * angle, np.pi)) - 1e-9)
        yield rows(at, own.astype(np.int32), own.astype(np.int32))
        at = np.flatnonzero(home < 0)
        if k < 2:
            yield rows(at, -1, -1)
        for i in range(k):
            for j in range(i + 1, k):
                yield rows(at, low[at, i], low[at, j])


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable number for 0..n-1 over the links (u, v)."""
    lab = np.arange(n)
    while True:
        m = np.minimum(lab[u], lab[v])
        new = lab.copy()
        np.minimum.at(new, u, m)
        np.minimum.at(new, v, m)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def _judge(f: pd.DataFrame, threshold: float, kind: type) -> pd.DataFrame:
    f = f.sort_values(["label", "d", "a", "b", "lo", "hi", "blk", "cid"], ignore_index=True)
    key = f[["label", "d", "a", "b", "lo", "hi"]].to_numpy()
    at = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
    ids, inv = np.unique(f.cid.to_numpy(), return_inverse=True)
    rows = np.zeros(len(ids), dtype=np.int64)
    rows[inv] = f.rows.to_numpy()
    links, us, vs = np.zeros(len(ids), dtype=np.int64), [], []
    for s, e in zip(at, [*at[1:], len(f)], strict=True):
        if e - s < 2:
            continue
        g = f.iloc[s:e]
        x = np.frombuffer(b"".join(g.x), dtype=kind).reshape(e - s, -1).astype(np.float64)
        desc = np.frombuffer(b"".join(g.desc), dtype=np.int32).reshape(e - s, -1)
        home = g.home.to_numpy()
        norm = np.sqrt((x * x).sum(axis=1))
        same = key[s, 4] == key[s, 5]
        cut = e - s if same else int((g.blk.to_numpy() == key[s, 4]).sum())
        for i in range(0, cut, 256):
            to = min(i + 256, cut)
            off = i if same else cut
            c = (x[i:to] @ x[off:].T) / (norm[i:to, None] * norm[None, off:])
            p, q = np.nonzero(c >= threshold - 1e-9)
            p, q = p + i, q + off
            if same:
                p, q = p[p < q], q[p < q]
            exact = (x[p] * x[q]).sum(axis=1) / (norm[p] * norm[q])
            p, q = p[exact >= threshold], q[exact >= threshold]
            if key[s, 2] == key[s, 3] >= 0:
                # the pair belongs to the smaller home of the two
                h, o = np.minimum(home[p], home[q]), np.maximum(home[p], home[q])
                own = np.where(h >= 0, h, o) == key[s, 2]
                p, q = inv[s + p[own]], inv[s + q[own]]
                np.add.at(links, p, rows[q])
                np.add.at(links, q, rows[p])
                us.append(p)
                vs.append(q)
                continue
            # without a home, to the key of its two smallest shared pivots
            hit = (desc[p][:, :, None] == desc[q][:, None, :]).any(axis=2)
            mine = hit & (np.cumsum(hit, axis=1) <= 2)
            first = desc[p, mine.argmax(axis=1)]
            second = desc[p, mine.shape[1] - 1 - mine[:, ::-1].argmax(axis=1)]
            own = ((first == key[s, 2]) & (second == key[s, 3])) | (desc.shape[1] < 2)
            p, q = inv[s + p[own]], inv[s + q[own]]
            np.add.at(links, p, rows[q])
            np.add.at(links, q, rows[p])
            us.append(p)
            vs.append(q)
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    lab = _forest(u, v, len(ids))
    on = np.flatnonzero(links > 0)
    return pd.DataFrame({"cid": ids[on], "links": links[on], "root": ids[lab[on]]})


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``vectors`` (vec_id, embedding, label) to (vec_id, n_links, component_id, kept), one row per vector."""
    spark = vectors.sparkSession
    bound_batches(spark)
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    kind = np.float32 if single else np.float64
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("embedding"), F.col("label").cast("long").alias("label"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = F.coalesce(F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0), F.lit(False))
    v = v.withColumn("cid", F.when(ok, F.xxhash64("label", "embedding")))
    good = v.filter("cid is not null")
    classes = checkpoint(good.groupBy("cid").agg(F.min("vec_id").alias("rep"), F.count("*").alias("rows"), F.first("label").alias("label"), F.first("embedding").alias("embedding")))
    n = classes.count()
    most = max(64, isqrt(n) // 2)
    sample = classes.select("rep", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(POOL * most).collect()
    width = max((len(r.embedding) for r in sample), default=1)
    pivots = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        pivots[i, : len(r.embedding)] = r.embedding
    angle = float(np.arccos(threshold))
    pivots = _spread(pivots, most, float(np.cos(min(2 * angle, np.pi))))
    listed = classes.select("cid", "rows", "label", "embedding").mapInPandas(partial(_describe, pivots=pivots, angle=angle, kind=kind), "label long, d int, a int, b int, cid long, rows long, x binary, desc binary, home int")
    path = checkpoint(listed)
    # only lists that are cut need their length; they are few, so the entries stay where they are
    long_ = checkpoint(path.groupBy("label", "d", "a", "b").agg(F.count("*").alias("m")).filter(F.col("m") > ROWS))
    k = path.join(F.broadcast(long_) if long_.count() <= 500_000 else long_, ["label", "d", "a", "b"], "left")
    k = k.withColumn("nb", F.ceil(F.coalesce("m", F.lit(1)) / F.when(F.col("a") == F.col("b"), HOME_ROWS).otherwise(ROWS)).cast("int")).withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    k = k.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumns({"lo": F.least("blk", "o"), "hi": F.greatest("blk", "o")})
    buckets = max(partitions(spark), n * NEAREST * (NEAREST - 1) // 2 // 20_000)
    k = k.withColumn("bucket", F.pmod(F.xxhash64("label", "d", "a", "b", "lo", "hi"), F.lit(buckets))).drop("nb", "o", "m")
    found = checkpoint(k.groupBy("bucket").applyInPandas(partial(_judge, threshold=threshold, kind=kind), "cid long, links long, root long"))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = components(found, "cid", "root", hashed=True).select(F.col("node").alias("cid"), F.col("component").alias("lab"))
    of = classes.select("cid", "rep", "rows").join(comp, "cid", "left").withColumn("lab", F.coalesce("lab", "cid"))
    least = of.groupBy("lab").agg(F.min("rep").alias("component_id"))
    of = of.join(least, "lab").join(links, "cid", "left").select("cid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"))
    out = v.select("vec_id", "cid").join(of, "cid", "left")
    comp_id = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), F.coalesce(F.col("vec_id") == comp_id, F.lit(True)).alias("kept"))
