"""Retrieval in blocks: many rankings of the same queries in one scan of the items.

An *arm* is a way to rank items: the exact distance, or the Hamming distance of winner codes under one wiring and one number of
winners. A task takes its items in Arrow batches, forms the distances of a block of items to all queries as matrix products,
and keeps, for every arm and query, only the ``n`` nearest so far; so it returns arms x queries x n rows whatever the
number of items, and no row for a pair. A window over those rows ends the ranking. With B random wirings as arms, B
rankings cost one scan.

All numbers are whole and the products exact: they are formed in doubles only where no sum can pass 2**53. Equal distances are
in the order of the md5 of (query, item), of the item alone, or of the id, as in ``knn``.

Queries are a stated set of at most ``MAX_QUERIES`` rows, which the driver fetches and broadcasts; larger sets go in blocks of
hashed ids, one scan each. A wiring that is sent to every task has at most ``encode.BROADCAST_ROWS`` entries. Both bounds are
checked; under larger wirings the items are encoded first, by blocks of cells and of items (``coded``).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparsewing.functions import rng
from sparsewing.operators.encode import BROADCAST_ROWS, priority
from sparsewing.operators.graph import reliable

MAX_QUERIES, BLOCK, EXACT = 20_000, 1 << 22, 2.0**53
#: Cells and items that meet in one task; a winner that is not there.
CELLS, ITEMS, NONE = 1 << 16, 1 << 13, -(1 << 63)
SCHEMA = "arm string, query_id long, item_id long, d long"


# ---------------------------------------------------------------- kernels
def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b in whole numbers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.rint(a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64) if top < EXACT else a @ b


def centred(x: np.ndarray) -> np.ndarray:
    return x * x.shape[1] - x.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Stack:
    """A wiring as a matrix (dims x cells), its columns in order of their priority, and the names of the cells."""

    weight: np.ndarray
    cell: np.ndarray

    def drives(self, x: np.ndarray) -> np.ndarray:
        return product(x, self.weight)

    def winners(self, x: np.ndarray, k: int) -> np.ndarray:
        """Columns of the ``k`` largest drives of each row of centred values, the largest first, equal ones by priority."""
        return self.first(self.drives(x), k)

    def first(self, y: np.ndarray, k: int) -> np.ndarray:
        m = len(self.cell)
        k = min(k, m)
        if float(np.abs(y).max(initial=0)) * m < 2.0**62:
            key = y * m + np.arange(m - 1, -1, -1)
            top = np.argpartition(key, m - k, axis=1)[:, m - k :] if k < m else np.broadcast_to(np.arange(m), y.shape)
            return np.take_along_axis(top, np.argsort(-np.take_along_axis(key, top, axis=1), axis=1), axis=1)
        return np.argsort(-y, axis=1, kind="stable")[:, :k]


def stack(wiring: DataFrame, dims: int | None = None, seed: int = 1) -> Stack:
    """Fetches a wiring (dim, cell, w) of at most BROADCAST_ROWS entries; ``dims`` are those of the items, or as many as it has."""
    rows = wiring.select("dim", "cell", F.col("w").cast("bigint").alias("w"), priority(seed).alias("p")).limit(BROADCAST_ROWS + 1).toArrow()
    if rows.num_rows > BROADCAST_ROWS:
        raise ValueError(f"a wiring of more than {BROADCAST_ROWS} entries is joined, not sent to every task")
    f = rows.to_pandas()
    return _stacked(f, dims if dims is not None else int(f.dim.max()) + 1 if len(f) else 0)


def _stacked(f, dims: int) -> Stack:
    cells = f[["p", "cell"]].drop_duplicates().sort_values(["p", "cell"])
    at = {c: i for i, c in enumerate(cells.cell)}
    weight = np.zeros((dims, len(cells)), dtype=np.int64)
    inside = f[(f.dim >= 0) & (f.dim < dims)]
    np.add.at(weight, (inside.dim.to_numpy(), inside.cell.map(at).to_numpy(dtype=np.int64)), inside.w.to_numpy())
    return Stack(weight, cells.cell.to_numpy(dtype=np.int64))


def stacks(wirings: DataFrame, dims: int, seed: int = 1) -> dict[int, Stack]:
    """Fetches wirings (draw, dim, cell, w), at most BROADCAST_ROWS entries each and sixteen times as many in all."""
    rows = wirings.select("draw", "dim", "cell", F.col("w").cast("bigint").alias("w"), priority(seed).alias("p")).limit(16 * BROADCAST_ROWS + 1).toArrow().to_pandas()
    if len(rows) > 16 * BROADCAST_ROWS or (len(rows) and rows.groupby("draw").size().max() > BROADCAST_ROWS):
        raise ValueError("the wirings are too large to be sent to every task; take fewer draws at a time")
    return {int(k): _stacked(f, dims) for k, f in rows.groupby("draw")}


# ---------------------------------------------------------------- arms
@dataclass(frozen=True)
class Exact:
    """Squared Euclidean distance of the values themselves, or of the centred ones."""

    name: str
    tie: str = "id"
    centre: bool = False

    def _values(self, x: np.ndarray) -> np.ndarray:
        return centred(x) if self.centre else x

    def prepared(self, q: np.ndarray) -> object:
        q = self._values(q)
        return q, (q * q).sum(axis=1)

    def distances(self, held, x: np.ndarray):
        q, size = held
        x = self._values(x)
        yield self.name, size[:, None] + (x * x).sum(axis=1)[None, :] - 2 * product(q, x.T)


@dataclass(frozen=True)
class Projected(Exact):
    """Squared Euclidean distance of the drives under a wiring, in whole steps of ``unit``."""

    wiring: Stack | None = None
    unit: int = 1

    def _values(self, x: np.ndarray) -> np.ndarray:
        return self.wiring.drives(centred(x)) // self.unit


@dataclass(frozen=True)
class Signed:
    """Hamming distance of the signs of the drives (above zero or not) under a wiring."""

    name: str
    wiring: Stack
    tie: str = "pair"

    def prepared(self, q: np.ndarray) -> np.ndarray:
        return (self.wiring.drives(centred(q)) > 0).astype(np.float32)

    def distances(self, held, x: np.ndarray):
        b = self.prepared(x)
        yield self.name, np.rint(held.sum(axis=1)[:, None] + b.sum(axis=1)[None, :] - 2 * (held @ b.T)).astype(np.int64)


@dataclass(frozen=True)
class Coded:
    """Hamming distance of the codes of the centred values under a wiring; one arm for each number of winners, named by it."""

    name: str
    wiring: Stack
    winners: tuple[int, ...]
    tie: str = "pair"

    def _bits(self, x: np.ndarray):
        top = self.wiring.winners(centred(x), max(self.winners))
        for k in self.winners:
            bits = np.zeros((len(x), len(self.wiring.cell)), dtype=np.float32)
            np.put_along_axis(bits, top[:, :k], 1.0, axis=1)
            yield f"{self.name}:{k}" if len(self.winners) > 1 else self.name, min(k, top.shape[1]), bits

    def prepared(self, q: np.ndarray) -> object:
        return list(self._bits(q))

    def distances(self, held, x: np.ndarray):
        for (name, k, q), (_, _, b) in zip(held, self._bits(x), strict=True):
            yield name, 2 * k - 2 * np.rint(q @ b.T).astype(np.int64)


@dataclass(frozen=True)
class Listed:
    """As ``Coded``, for codes that were made before: the row holds the winners, from the first on, at ``at``."""

    name: str
    at: int
    winners: tuple[int, ...]
    tie: str = "pair"

    def prepared(self, q: np.ndarray) -> list:
        out = []
        for k in self.winners:
            own = q[:, self.at : self.at + k]
            cells = np.unique(own[own != NONE])
            out.append((f"{self.name}:{k}" if len(self.winners) > 1 else self.name, k, int((own != NONE).sum(axis=1).max(initial=0)), cells, self._bits(own, cells)))
        return out

    @staticmethod
    def _bits(own: np.ndarray, cells: np.ndarray) -> np.ndarray:
        bits = np.zeros((len(own), len(cells)), dtype=np.float32)
        if len(cells):
            place = np.minimum(np.searchsorted(cells, own), len(cells) - 1)
            row, col = np.nonzero(cells[place] == own)
            bits[row, place[row, col]] = 1.0
        return bits

    def distances(self, held, x: np.ndarray):
        for name, k, many, cells, q in held:
            yield name, 2 * many - 2 * np.rint(q @ self._bits(x[:, self.at : self.at + k], cells).T).astype(np.int64)


@dataclass(frozen=True)
class Front:
    """An arm over the first ``dims`` values of a row."""

    arm: Exact | Coded
    dims: int

    @property
    def name(self) -> str:
        return self.arm.name

    @property
    def tie(self) -> str:
        return self.arm.tie

    def prepared(self, q: np.ndarray) -> object:
        return self.arm.prepared(q[:, : self.dims])

    def distances(self, held, x: np.ndarray):
        return self.arm.distances(held, x[:, : self.dims])


@dataclass
class Nearest:
    """The ``n`` nearest items of each query so far, as far as distances and ties decide."""

    ids: np.ndarray
    n: int
    tie: str
    seed: int
    d: list = field(default_factory=list)
    item: list = field(default_factory=list)
    more: list = field(default_factory=list)

    def __post_init__(self):
        self.d, self.item, self.more = ([np.zeros(0, np.int64) for _ in self.ids] for _ in range(3))
        self.limit = np.full(len(self.ids), np.iinfo(np.int64).max)

    def add(self, d: np.ndarray, items: np.ndarray, more: np.ndarray | None = None) -> None:
        """``d`` of every query (row) and item (column) of a block; ``more`` is kept along."""
        bound = self.limit
        if d.shape[1] > self.n:  # an item beyond n others of its own block is none of the n nearest, itself left aside
            bound = np.minimum(bound, np.partition(d, self.n, axis=1)[:, self.n])
        row, col = np.nonzero(d <= bound[:, None])
        away = items[col] != self.ids[row]
        row, col = row[away], col[away]
        start = np.searchsorted(row, np.arange(len(self.ids) + 1))
        for q in np.flatnonzero(np.diff(start)).tolist():
            c = col[start[q] : start[q + 1]]
            self.d[q], self.item[q] = np.concatenate([self.d[q], d[q, c]]), np.concatenate([self.item[q], items[c]])
            self.more[q] = np.concatenate([self.more[q], d[q, c] if more is None else more[q, c]])
            if len(self.d[q]) > self.n:
                self._cut(q)

    def _cut(self, q: int) -> None:
        d, item = self.d[q], self.item[q]
        edge = np.partition(d, self.n - 1)[self.n - 1]
        inner, rim = np.flatnonzero(d < edge), np.flatnonzero(d == edge)
        left = self.n - len(inner)
        if left < len(rim):
            rim = np.array(sorted(rim.tolist(), key=lambda i: self._order(q, int(item[i])))[:left], dtype=np.int64)
        keep = np.concatenate([inner, rim])
        self.d[q], self.item[q], self.more[q], self.limit[q] = d[keep], item[keep], self.more[q][keep], edge

    def _order(self, q: int, item: int):
        if self.tie == "id":
            return item
        of = f"{self.ids[q]}:{item}" if self.tie == "pair" else f"{item}"
        return md5(f"tie:{self.seed}:{of}".encode()).hexdigest(), item


# ---------------------------------------------------------------- maps
def _padded(col: pa.Array, dims: int) -> np.ndarray:
    """Rows of ``dims`` values from arrays of any length; what is missing is 0."""
    size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = np.asarray(col.flatten().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    if (size == dims).all():
        return flat.reshape(len(col), dims)
    out = np.zeros((len(col), dims), dtype=np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    place = np.arange(len(flat)) - np.repeat(at[:-1], size)
    inside = place < dims
    out[np.repeat(np.arange(len(col)), size)[inside], place[inside]] = flat[inside]
    return out


def _mapped(items: DataFrame, s: Stack, col: str, rows, schema: str) -> DataFrame:
    """``rows`` of (ids, drives) for every batch of items, as record batches."""
    held = items.sparkSession.sparkContext.broadcast(s)

    def run(batches):
        w = held.value
        step = max(1, (BLOCK >> 2) // max(1, len(w.cell)))
        for b in batches:
            for at in range(0, b.num_rows, step):
                x = b.slice(at, step)
                yield rows(w, x.column(0), w.drives(_padded(x.column(1), len(w.weight))))

    return items.select("item_id", col).mapInArrow(run, schema)


def drives(items: DataFrame, s: Stack, col: str = "q") -> DataFrame:
    """(item_id, cell, y) of every item and cell."""

    def rows(w, ids, y):
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(np.arange(len(y)), y.shape[1]))), pa.array(np.tile(w.cell, len(y))), pa.array(y.ravel())], names=["item_id", "cell", "y"])

    return _mapped(items, s, col, rows, f"item_id {_type(items)}, cell long, y long")


def codes(items: DataFrame, s: Stack, k: int, col: str = "q") -> DataFrame:
    """(item_id, cell, rnk, y) of the ``k`` winners of every item."""

    def rows(w, ids, y):
        top = w.first(y, k)
        n = top.shape[1]
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(np.repeat(np.arange(len(y)), n))), pa.array(w.cell[top].ravel()), pa.array(np.tile(np.arange(1, n + 1), len(y))), pa.array(np.take_along_axis(y, top, axis=1).ravel())],
            names=["item_id", "cell", "rnk", "y"],
        )

    return _mapped(items, s, col, rows, f"item_id {_type(items)}, cell long, rnk long, y long")


def _type(items: DataFrame) -> str:
    return items.schema["item_id"].dataType.simpleString()


# ---------------------------------------------------------------- wirings of any size
def winners(items: DataFrame, wirings: DataFrame, dims: int, k: int, seed: int = 1, col: str = "q") -> DataFrame:
    """(draw, item_id, cells): the ``k`` winners of every item, the first in front, under wirings (draw, dim, cell, w) of any size. A
    block of cells of one wiring meets a block of items in one task, which keeps the ``k`` largest drives of each item there;
    those of all blocks are ranked per item and wiring, ties in the order of ``Stack``."""
    parts = max(1, -(-wirings.select("cell").distinct().count() // CELLS))
    many = max(1, -(-items.count() // ITEMS))
    draws = [r.draw for r in wirings.select("draw").distinct().collect()]
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    w = wirings.select("draw", "dim", "cell", F.col("w").cast("long").alias("w"), F.pmod(F.xxhash64("cell"), F.lit(parts)).cast("int").alias("part"), each(many).alias("block"))
    it = items.select("item_id", col, F.pmod(F.xxhash64("item_id"), F.lit(many)).cast("int").alias("block"), each(parts).alias("part"))
    it = it.withColumn("draw", F.explode(F.array(*[F.lit(d).cast("long") for d in draws])))

    def run(key, wired, some):
        if not len(wired) or not len(some):
            return pd.DataFrame({"draw": [], "item_id": [], "cell": [], "y": []})
        s = _stacked(wired.assign(p=wired.cell.map({c: md5(f"prio:{seed}:{c}".encode()).hexdigest() for c in wired.cell.unique().tolist()})), dims)
        x, ids, out = centred(np.stack(some[col].to_numpy()).astype(np.int64)), some.item_id.to_numpy(), []
        step = max(1, BLOCK // max(1, len(s.cell)))
        for at in range(0, len(x), step):
            y = s.drives(x[at : at + step])
            top = s.first(y, k)
            out.append(pd.DataFrame({"draw": key[0], "item_id": np.repeat(ids[at : at + step], top.shape[1]), "cell": s.cell[top].ravel(), "y": np.take_along_axis(y, top, axis=1).ravel()}))
        return pd.concat(out)

    by, n = ["draw", "part", "block"], len(draws) * parts * many
    got = w.repartition(n, *by).groupBy(*by).cogroup(it.repartition(n, *by).groupBy(*by)).applyInPandas(run, f"draw long, item_id {_type(items)}, cell long, y long")
    first = Window.partitionBy("draw", "item_id").orderBy(F.col("y").desc(), priority(seed), "cell")
    ranked = got.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k)
    return ranked.groupBy("draw", "item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "cell"))), lambda x: x["cell"]).alias("cells"))


def coded(items: DataFrame, sets: list[tuple[str, DataFrame, int]], dims: int, sizes: tuple[int, ...], col: str = "q") -> tuple[DataFrame, list]:
    """Items of ``dims`` values, and the arms of every wiring of ``sets`` (name, wirings (draw, dim, cell, w), seed of priorities), named
    by set and draw. Wirings that are too large to be sent to every task encode the items first, whose rows then hold their
    values and, behind them, their winners."""
    k, out, arms, at = max(sizes), items.select("item_id", col), [], dims
    for i, (name, wirings, seed) in enumerate(sets):
        wirings = reliable(wirings.select("draw", "dim", "cell", "w"))
        n = {r.draw: r["count"] for r in wirings.groupBy("draw").count().collect()}
        if max(n.values(), default=0) <= BROADCAST_ROWS and sum(n.values()) <= 16 * BROADCAST_ROWS:
            arms += [Front(Coded(f"{name}{d}", s, sizes), dims) for d, s in sorted(stacks(wirings, dims, seed).items())]
            continue
        won = winners(items, wirings, dims, k, seed, col).groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.struct("draw", "cells"))).alias("_m"))
        out = out.join(won, "item_id", "left")
        rows = [F.slice(F.concat(F.coalesce(F.element_at("_m", F.lit(d).cast("long")), F.array().cast("array<long>")), F.array_repeat(F.lit(NONE).cast("long"), k)), 1, k) for d in sorted(n)]
        out = out.withColumn(f"_w{i}", F.concat(*rows)).drop("_m")
        arms += [Listed(f"{name}{d}", at + j * k, sizes) for j, d in enumerate(sorted(n))]
        at += len(n) * k
    behind = [c for c in out.columns if c.startswith("_w")]
    return (reliable(out.select("item_id", F.concat(col, *behind).alias(col))) if behind else out), arms


# ---------------------------------------------------------------- scans
def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.int64).reshape(len(col), -1)


def _scan(batches, held):
    ids, q, arms, n, seed = held.value
    ready = [a.prepared(q) for a in arms]
    best: dict[str, Nearest] = {}
    step = max(1, min(4096, BLOCK // max(1, len(ids))))
    for b in batches:
        for at in range(0, b.num_rows, step):
            s = b.slice(at, step)
            x, items = _matrix(s.column(1)), s.column(0).to_numpy(zero_copy_only=False)
            for arm, own in zip(arms, ready, strict=True):
                for name, d in arm.distances(own, x):
                    if name not in best:
                        best[name] = Nearest(ids, n, arm.tie, seed)
                    best[name].add(d, items)
    for name, top in best.items():
        size = [len(x) for x in top.d]
        cols = [pa.array([name] * sum(size)), pa.array(np.repeat(ids, size)), pa.array(np.concatenate(top.item)), pa.array(np.concatenate(top.d))]
        yield pa.RecordBatch.from_arrays(cols, names=["arm", "query_id", "item_id", "d"])


def fetched(items: DataFrame, queries: DataFrame, col: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids and values of the queries, at most MAX_QUERIES."""
    t = items.select("item_id", col).join(F.broadcast(queries.select("item_id").distinct().limit(MAX_QUERIES + 1)), "item_id", "left_semi").limit(MAX_QUERIES + 1).toArrow()
    if t.num_rows > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries in one block")
    return t.column(0).to_numpy(), _matrix(t.column(1)) if t.num_rows else np.zeros((0, 1), np.int64)


def rankings(items: DataFrame, queries: DataFrame, arms: list, n: int, seed: int = 5, col: str = "q") -> DataFrame:
    """(arm, query_id, rnk, item_id, d): the ``n`` nearest other items of each query under every arm, in one scan. ``items``: item_id
    and an array of whole numbers, all of one length, without nulls."""
    spark = items.sparkSession
    ids, q = fetched(items, queries, col)
    if not len(ids):
        return spark.createDataFrame([], "arm string, query_id long, rnk long, item_id long, d long")
    held = spark.sparkContext.broadcast((ids, q, arms, n, seed))

    def run(batches):
        return _scan(batches, held)

    got = items.select("item_id", col).mapInArrow(run, SCHEMA)
    ties = {"id": [], "pair": [rng.digest("tie", seed, "query_id", "item_id")], "item": [rng.digest("tie", seed, "item_id")]}
    kinds = {a.tie for a in arms}
    by_arm = {t: [a.name for a in arms if a.tie == t] for t in kinds}
    order = F.lit("")
    for t in kinds - {"id"}:
        named = F.substring_index("arm", ":", 1).isin(by_arm[t])
        order = F.when(named, ties[t][0]).otherwise(order)
    w = Window.partitionBy("arm", "query_id").orderBy("d", order, "item_id")
    return got.withColumn("rnk", F.row_number().over(w).cast("bigint")).filter(F.col("rnk") <= n).select("arm", "query_id", "rnk", "item_id", "d")


# ---------------------------------------------------------------- every item as a query
#: Queries and items that meet in one task, and queries that a task handles at once.
ALL_QUERIES, ALL_ITEMS, AT_ONCE = 1 << 15, 1 << 17, 32


class _Euclid:
    """Squared distances of an ``Exact`` arm, short of the query's own square: in doubles where every sum stays exact."""

    def __init__(self, arm: Exact, q: np.ndarray, x: np.ndarray):
        (self.q, own), (self.x, size) = arm.prepared(q), arm.prepared(x)
        self.own, self.size = own, size
        top = max(float(np.abs(v).max(initial=0)) for v in (self.q, self.x))
        self.exact = 8 * top * top * max(1, self.q.shape[1]) < EXACT
        if self.exact:
            self.q = np.column_stack([-2.0 * self.q, np.ones(len(self.q))])
            self.x = np.ascontiguousarray(np.column_stack([self.x, size]).astype(np.float64).T)

    def rows(self, at: int, to: int) -> np.ndarray:
        return self.q[at:to] @ self.x if self.exact else self.size[None, :] - 2 * product(self.q[at:to], self.x.T)

    def whole(self, i: int, d: np.ndarray) -> np.ndarray:
        return d.astype(np.int64) + self.own[i]


class _Shared:
    """Hamming distances of the codes of a ``Coded`` arm from lists of the items of each cell: only the items that share a winner with
    a query are counted."""

    def __init__(self, arm: Coded, k: int, q: np.ndarray, x: np.ndarray):
        step = max(1, BLOCK // max(1, len(arm.wiring.cell)))
        won = lambda v: np.concatenate([arm.wiring.winners(centred(v[i : i + step]), k) for i in range(0, len(v), step)])
        self.q, top = won(q), won(x)
        self.k, self.n = top.shape[1], len(x)
        order = np.argsort(top.ravel(), kind="stable")
        self.item = order // max(1, self.k)
        self.at = np.searchsorted(top.ravel()[order], np.arange(len(arm.wiring.cell) + 1))

    def rows(self, at: int, to: int) -> np.ndarray:
        out = np.empty((to - at, self.n), dtype=np.int64)
        for i in range(at, to):
            out[i - at] = np.bincount(np.concatenate([self.item[self.at[c] : self.at[c + 1]] for c in self.q[i].tolist()]), minlength=self.n)
        return np.subtract(2 * self.k, 2 * out, out=out)

    def whole(self, i: int, d: np.ndarray) -> np.ndarray:
        return d


def _first(query, d: np.ndarray, item: np.ndarray, n: int, tie: str, seed: int) -> np.ndarray:
    """The places of the ``n`` nearest, in order: by distance, tie and id."""
    if len(d) > n:
        near = np.flatnonzero(d <= np.partition(d, n - 1)[n - 1])
    else:
        near = np.arange(len(d))
    if tie == "id":
        return near[np.lexsort((item[near], d[near]))[:n]]
    own = f"{query}:" if tie == "pair" else ""
    return np.array(sorted(near.tolist(), key=lambda i: (d[i], md5(f"tie:{seed}:{own}{item[i]}".encode()).hexdigest(), item[i]))[:n], dtype=np.int64)


def _nearest(far, ids: np.ndarray, items: np.ndarray, n: int, tie: str, seed: int):
    """The distances and names of the ``n`` nearest other items of each query."""
    for at in range(0, len(ids), AT_ONCE):
        to = min(at + AT_ONCE, len(ids))
        d = far.rows(at, to)
        some = d[:, : 1 << 12]  # the n nearest of some items, itself left aside, bound those of all
        bound = np.partition(some, n, axis=1)[:, n] if some.shape[1] > n else d.max(axis=1)
        row, col = np.divmod(np.flatnonzero((d <= bound[:, None]).ravel()), d.shape[1])
        start = np.searchsorted(row, np.arange(to - at + 1))
        for i in range(at, to):
            c = col[start[i - at] : start[i - at + 1]]
            c = c[items[c] != ids[i]]
            own = far.whole(i, d[i - at, c])
            first = _first(ids[i], own, items[c], n, tie, seed)
            yield own[first], items[c[first]]


def all_rankings(items: DataFrame, arms: list, n: int, seed: int = 5, col: str = "q") -> DataFrame:
    """As ``rankings`` with every item as a query, for ``Exact`` arms and ``Coded`` ones of one size. A block of queries meets a block of
    items in one task, which keeps the ``n`` nearest of each query there, as one row; those of all blocks of items are merged
    per query. All pairs are compared, so the work is quadratic; what a task holds is two blocks."""
    total = items.count()
    many = max(-(-total // ALL_QUERIES), min(16, -(-total // 1024)), 1)
    parts = max(1, -(-total // ALL_ITEMS))
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    hashed = lambda k: F.pmod(F.xxhash64("item_id"), F.lit(k)).cast("int")
    by = ["qb", "ib"]
    q = items.select("item_id", col, hashed(many).alias("qb"), each(parts).alias("ib"))
    x = items.select("item_id", col, F.pmod(F.xxhash64(F.lit("item"), "item_id"), F.lit(parts)).cast("int").alias("ib"), each(many).alias("qb"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, made = ["query_id", "arm", "d", "item"], []
        if left.num_rows and right.num_rows:
            ids, own = left.column("item_id").to_numpy(), _matrix(left.column(col))
            others, x = right.column("item_id").to_numpy(), _matrix(right.column(col))
            for a, arm in enumerate(arms):
                far = _Euclid(arm, own, x) if isinstance(arm, Exact) else _Shared(arm, arm.winners[0], own, x)
                got = [(d.tobytes(), i.tobytes()) for d, i in _nearest(far, ids, others, n, arm.tie, seed)]
                made.append(pa.table([pa.array(ids), pa.array(np.full(len(ids), a, np.int32)), *(pa.array(v, pa.binary()) for v in zip(*got, strict=True))], names=names))
        return pa.concat_tables(made) if made else pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.binary(), pa.binary())], names=names)

    groups = 4 * many * parts if many * parts > 1 else 1  # few groups share a task
    met = q.repartition(groups, *by).groupBy(*by).cogroup(x.repartition(groups, *by).groupBy(*by)).applyInArrow(run, "query_id long, arm int, d binary, item binary")
    joined = met.groupBy("query_id", "arm").agg(F.collect_list(F.struct("d", "item")).alias("near"))

    def merge(batches):
        for b in batches:
            cols = [[], [], [], [], []]
            for query, a, near in zip(*(c.to_pylist() for c in b.columns), strict=True):
                d, item = (np.frombuffer(b"".join(x[k] for x in near), dtype=np.int64) for k in ("d", "item"))
                first = _first(query, d, item, n, arms[a].tie, seed)
                for c, v in zip(cols, ([arms[a].name] * len(first), [query] * len(first), range(1, len(first) + 1), item[first].tolist(), d[first].tolist()), strict=True):
                    c.extend(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), *[pa.int64()] * 4), strict=True)], names=["arm", "query_id", "rnk", "item_id", "d"])

    return joined.mapInArrow(merge, "arm string, query_id long, rnk long, item_id long, d long")


def query_blocks(items: DataFrame) -> list[DataFrame]:
    """All items as queries, in blocks of hashed ids of at most MAX_QUERIES."""
    n = items.count()
    k = max(1, -(-n // (MAX_QUERIES * 3 // 4)))
    ids = items.select("item_id")
    return [ids] if k == 1 else [ids.filter(F.pmod(F.xxhash64("item_id"), F.lit(k)) == i) for i in range(k)]


def scores(ranked: DataFrame, truth: str | tuple[str, ...], n: int) -> DataFrame:
    """(arm, query_id, ap, ap_retrieved, recall) of all arms but ``truth`` against it: an item is a hit where the arm of the truth
    ranks it for the same query, so one pass over the ranked rows scores every arm. For several truths, with a column
    ``truth`` and a row for each."""
    truths = (truth,) if isinstance(truth, str) else truth
    same = Window.partitionBy("query_id", "item_id")
    hits = F.array(*[F.struct(F.lit(t).alias("truth"), F.max((F.col("arm") == t).cast("long")).over(same).alias("hit")) for t in truths])
    h = ranked.select("arm", "query_id", "item_id", "rnk", hits.alias("x")).filter(~F.col("arm").isin(list(truths)))
    h = h.select("arm", "query_id", "rnk", F.explode("x").alias("x")).select("x.truth", "arm", "query_id", "rnk", "x.hit")
    run = F.sum("hit").over(Window.partitionBy("truth", "arm", "query_id").orderBy("rnk").rowsBetween(Window.unboundedPreceding, 0))
    p = h.withColumn("p", F.when(F.col("hit") == 1, run / F.col("rnk")).otherwise(0.0))
    g = p.groupBy("truth", "arm", "query_id").agg(F.sum("p").alias("p"), F.sum("hit").alias("hits"))
    out = g.select("truth", "arm", "query_id", F.round(F.col("p") / n, 9).alias("ap"), F.round(F.col("p") / F.greatest("hits", F.lit(1)), 9).alias("ap_retrieved"), F.round(F.col("hits") / n, 9).alias("recall"))
    return out.drop("truth") if isinstance(truth, str) else out
