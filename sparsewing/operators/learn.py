"""Fitted codes: principal components, product quantisation, competitive learning, low-rank completion.

Moments are added up by the executors; what is decomposed on the driver is a matrix of the dimensions, not of the items.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewing.operators.graph import reliable


def _moments(frames, d: int):
    n, s, g = 0, np.zeros(d), np.zeros((d, d))
    for f in frames:
        x = np.stack(f.x.to_numpy()).astype(np.float64) if len(f) else np.zeros((0, d))
        n, s, g = n + len(x), s + x.sum(axis=0), g + x.T @ x
    if n:
        yield pd.DataFrame({"n": [n], "s": [s.tolist()], "g": [g.ravel().tolist()]})


def moments(items: DataFrame, d: int, col: str = "q") -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and population covariance; one row of d * d sums per task comes back, added by position."""
    x = items.select(F.transform(col, lambda v: v.cast("double")).alias("x"))
    p = reliable(x.mapInPandas(partial(_moments, d=d), "n long, s array<double>, g array<double>"))
    n = p.agg(F.sum("n")).first()[0] or 0
    sums = lambda c: {r.k: r.v for r in p.select(F.posexplode(c).alias("k", "x")).groupBy("k").agg(F.sum("x").alias("v")).collect()}
    s, g = sums("s"), sums("g")
    mean = np.array([s[i] for i in range(d)]) / max(n, 1)
    return n, mean, np.array([g[i] for i in range(d * d)]).reshape(d, d) / max(n, 1) - np.outer(mean, mean)


def pca(items: DataFrame, train: DataFrame, d: int, k: int, col: str = "q") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (k x d, the largest loading of each positive) and variances, from training items only."""
    _, mean, cov = moments(items.join(train.select("item_id"), "item_id", "left_semi"), d, col)
    val, vec = np.linalg.eigh(cov)
    vec, val = vec[:, ::-1][:, :k].T, val[::-1][:k]
    sign = np.sign(vec[np.arange(k), np.abs(vec).argmax(axis=1)])
    return mean, vec * sign[:, None], val


def project(items: DataFrame, mean: np.ndarray, comp: np.ndarray, col: str = "q") -> DataFrame:
    """Scores of every item on every component (item_id, z)."""

    def run(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"item_id": f.item_id, "z": list((np.stack(f.x.to_numpy()) - mean) @ comp.T)})

    return items.select("item_id", F.transform(col, lambda v: v.cast("double")).alias("x")).mapInPandas(run, "item_id long, z array<double>")


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Lloyd's rounds on a bounded training sample, started by spread-out picks; empty centres stay."""
    g = np.random.default_rng(seed)
    c = x[[g.integers(len(x))]]
    while len(c) < min(k, len(x)):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1)
        c = np.vstack([c, x[[g.choice(len(x), p=d / d.sum()) if d.sum() > 0 else 0]]])
    for _ in range(rounds):
        a = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.stack([x[a == i].mean(axis=0) if (a == i).any() else c[i] for i in range(len(c))])
    return c


SAMPLE = 5000


def pq_fit(items: DataFrame, bits: list[int], d: int, seed: int, col: str = "q") -> list[tuple[np.ndarray, np.ndarray]]:
    """(dims, centroids) per subspace, from at most SAMPLE training items (those with the smallest digests)."""
    rows = items.orderBy(F.md5(F.concat(F.lit(f"pq:{seed}:"), F.col("item_id").cast("string")))).limit(SAMPLE).select(col).collect()
    x = np.array([r[0] for r in rows], dtype=np.float64)
    return [(part, kmeans(x[:, part], 1 << b, seed + i)) for i, (part, b) in enumerate(zip(np.array_split(np.arange(d), len(bits)), bits, strict=True))]


def pq_encode(items: DataFrame, books: list, col: str = "q") -> DataFrame:
    """(item_id, codes): the nearest centroid in each subspace."""

    def run(frames):
        for f in frames:
            if len(f):
                x = np.stack(f.x.to_numpy())
                codes = np.stack([((x[:, None, p] - c[None]) ** 2).sum(axis=2).argmin(axis=1) for p, c in books], axis=1)
                yield pd.DataFrame({"item_id": f.item_id, "codes": list(codes.astype(np.int32))})

    return items.select("item_id", F.transform(col, lambda v: v.cast("double")).alias("x")).mapInPandas(run, "item_id long, codes array<int>")


def pq_adc(codes: DataFrame, items: DataFrame, queries: DataFrame, books: list, col: str = "q") -> DataFrame:
    """(query_id, item_id, d): distance of a query to an item's reconstruction, by table lookup. Queries are a bounded set."""
    q = items.join(queries.select("item_id"), "item_id").select(F.col("item_id").alias("query_id"), F.transform(col, lambda v: v.cast("double")).alias("x")).collect()
    ids = np.array([r.query_id for r in q])
    x = np.array([r.x for r in q])
    tables = [((x[:, None, p] - c[None]) ** 2).sum(axis=2) for p, c in books]

    def run(frames):
        for f in frames:
            if len(f):
                k = np.stack(f.codes.to_numpy())
                d = sum(t[:, k[:, i]] for i, t in enumerate(tables)).T
                yield pd.DataFrame({"query_id": np.tile(ids, len(f)), "item_id": np.repeat(f.item_id.to_numpy(), len(ids)), "d": d.ravel()})

    return codes.mapInPandas(run, "query_id long, item_id long, d double").filter("query_id <> item_id")


@dataclass(frozen=True)
class Competition:
    """Units that compete for samples, after the published rule of competing hidden units: the unit with the largest input
    current moves towards the sample, the unit of rank ``rank`` away from it by ``push``, and both decay with their current,
    which keeps their norms at one. ``power`` is the exponent of the units' metric."""

    rank: int
    push: float = 0.4
    power: float = 2.0

    def currents(self, units: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return rows @ (units * np.abs(units) ** (self.power - 2)).T if self.power != 2 else rows @ units.T

    def change(self, units: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The summed change of all units over some rows, scaled to a largest entry of one."""
        current = self.currents(units, rows)
        last = min(self.rank, len(units))
        # ties go to the unit with the smaller number
        named = np.lexsort((np.broadcast_to(np.arange(len(units)), current.shape), -current), axis=1)
        out = np.zeros_like(units)
        for place, sign in ((0, 1.0), (last - 1, -self.push)):
            unit = named[:, place]
            np.add.at(out, unit, sign * rows)
            out -= sign * np.bincount(unit, weights=np.take_along_axis(current, unit[:, None], axis=1)[:, 0], minlength=len(units))[:, None] * units
        return out / max(np.abs(out).max(), np.finfo(float).tiny)

    def fit(self, rows: np.ndarray, units: np.ndarray, epochs: int, rate: float, batch: int = 50, seed: int = 1) -> np.ndarray:
        """Units after ``epochs`` passes over the rows in random order, at a rate that falls to zero. Entries that are zero at the
        start stay zero. The order of the samples matters, so this runs on one machine over a bounded sample."""
        wired, rng = units != 0, np.random.default_rng(seed)
        steps = [part for _ in range(epochs) for part in np.array_split(rng.permutation(len(rows)), max(1, -(-len(rows) // batch)))]
        for k, part in enumerate(steps):
            falling = rate * (1 - (k * epochs // len(steps)) / epochs)
            units = units + falling * np.where(wired, self.change(units, rows[part]), 0.0)
        return units


def random_units(m: int, d: int, seed: int, wired: np.ndarray | None = None) -> np.ndarray:
    units = np.random.default_rng([seed, m, d]).standard_normal((m, d))
    return units if wired is None else np.where(wired, units, 0.0)


def complete(x: np.ndarray, rank: int = 5, rounds: int = 50) -> np.ndarray:
    """Missing entries (NaN) of one response matrix by repeated truncated decomposition, from column means."""
    gap = np.isnan(x)
    mean = np.where(gap.all(axis=0), 0.0, np.nansum(x, axis=0) / np.maximum((~gap).sum(axis=0), 1))
    y = np.where(gap, mean, x)
    for _ in range(rounds):
        u, s, v = np.linalg.svd(y, full_matrices=False)
        new = np.where(gap, (u[:, :rank] * s[:rank]) @ v[:rank], x)
        if np.abs(new - y).max() < 1e-9:
            return new
        y = new
    return y


EVERY = 10


def completed(rows: DataFrame, dims: int, rank: int = 5, rounds: int = 50) -> DataFrame:
    """(item, y): the rows (item, x) of one response matrix, ``dims`` values each, with what is missing (null or NaN) filled in as by
    ``complete``. The right singular vectors are those of the sums of products of the dims, which a task adds up over
    its rows, and a row is projected by itself; so a task holds a batch of rows, and the driver a matrix of the dims for each task. The
    rows are written anew after EVERY rounds, and in between carried on from there."""
    gap = F.lit(float("nan"))
    state = reliable(rows.select("item", F.transform("x", lambda v: F.coalesce(v, gap)).alias("x")))
    if not dims:
        return state.select("item", F.col("x").alias("y"))
    known = state.select(F.posexplode("x").alias("k", "v")).filter(~F.isnan("v")).groupBy("k").agg(F.avg("v").alias("v"))
    means = {r.k: r.v for r in known.collect()}  # a row per dim
    mean, held = np.array([means.get(i, 0.0) for i in range(dims)]), []

    def moved(f: pd.DataFrame, steps: list, begun: bool) -> tuple[np.ndarray, float]:
        x = np.stack(f.x.to_numpy()).astype(np.float64)
        y = np.stack(f.y.to_numpy()).astype(np.float64) if begun else np.where(np.isnan(x), mean, x)
        last = y
        for v in steps:
            last, y = y, np.where(np.isnan(x), (y @ v) @ v.T, x)
        return y, float(np.abs(y - last).max(initial=0))

    def carried(steps: list, begun: bool) -> DataFrame:
        def run(frames):
            for f in frames:
                if len(f):
                    yield pd.DataFrame({"item": f["item"], "x": f.x, "y": list(moved(f, steps, begun)[0])})

        return state.mapInPandas(run, f"item {rows.schema['item'].dataType.simpleString()}, x array<double>, y array<double>")

    def products(steps: list, begun: bool) -> tuple[np.ndarray, float]:
        def run(frames):
            g, most = np.zeros((dims, dims)), 0.0
            for f in frames:
                if len(f):
                    y, change = moved(f, steps, begun)
                    g, most = g + y.T @ y, max(most, change)
            yield pd.DataFrame({"most": [most], "g": [g.tobytes()]})

        got = state.mapInPandas(run, "most double, g binary").collect()  # a matrix of the dims for each task
        return sum((np.frombuffer(r.g).reshape(dims, dims) for r in got), np.zeros((dims, dims))), max((r.most for r in got), default=0.0)

    begun = False
    for i in range(rounds):
        g, change = products(list(held), begun)
        if i and change < 1e-9:
            break
        held.append(np.linalg.eigh(g)[1][:, ::-1][:, :rank])
        if len(held) == EVERY:  # the last step stays, as its change is not known yet
            state, begun, held = reliable(carried(held[:-1], begun)), True, held[-1:]
    return carried(held, begun).select("item", "y")
