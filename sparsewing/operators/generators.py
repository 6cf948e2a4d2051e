"""Random wirings with fixed margins, for any number of cells.

A wiring has few dims (those of a circuit, which every task knows) and any number of cells. A cell is one row, with the dims that
it has in every draw as bits. In each sweep the cells are dealt at random into blocks of about ``BLOCK``, and a block makes its
trades between dims among its own cells, which keeps its margins and so those of the wiring; the next sweep deals them
anew. A chain on blocks that do not depend on its state has the same even limit as one over all cells. Where all cells fit one
block, this is the plain chain. What a task holds is one block, whatever the wiring.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparsewing.operators.graph import reliable

SCHEMA = "draw long, dim long, cell long, w long"
BLOCK = 1 << 14
_STATE = "g int, cell long, now binary, past array<binary>"


# ---------------------------------------------------------------- cells as bits
def _pack(entry: np.ndarray) -> list[bytes]:
    """Bits (cells x draws x dims), a string of bytes for each cell."""
    return [r.tobytes() for r in np.packbits(entry, axis=2)]


def _unpack(col, draws: int, dims: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(col), dtype=np.uint8).reshape(len(col), draws, -(-dims // 8))
    return np.unpackbits(raw, axis=2, count=dims).astype(bool)


def _random(seed: tuple[int, ...], *keys: np.ndarray) -> np.ndarray:
    """Random 64-bit numbers of whole keys, the same in any block."""
    x = np.full(len(keys[0]), np.random.SeedSequence(list(seed)).generate_state(1, np.uint64)[0])
    for k in keys:
        x = (x ^ k.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def _cells(wiring: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """(cell, has, ws), a row per cell with its sorted dims and weights; all dims; the number of cells."""
    w = wiring.select("dim", "cell", (F.col("w") if "w" in wiring.columns else F.lit(1)).cast("long").alias("w"))
    cells = reliable(w.groupBy("cell").agg(F.array_sort(F.collect_set("dim")).alias("has"), F.array_sort(F.collect_list("w")).alias("ws")))
    dims = np.array(sorted(r.dim for r in cells.select(F.explode("has").alias("dim")).distinct().collect()), dtype=np.int64)  # of one circuit
    return cells, dims, cells.count()


def _bits(f: pd.DataFrame, dims: np.ndarray) -> np.ndarray:
    """Cells x dims."""
    out = np.zeros((len(f), len(dims)), dtype=bool)
    n = f.has.map(len).to_numpy()
    if n.sum():
        out[np.repeat(np.arange(len(f)), n), np.searchsorted(dims, np.concatenate(f.has.to_list()))] = True
    return out


def _blocks(cells: int) -> int:
    return max(1, -(-cells // BLOCK))


def _block(blocks: list[int], seed: int, sweep: int):
    n = F.element_at(F.array(*[F.lit(int(b)) for b in blocks]), F.col("g") + 1)
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(sweep), "g", "cell"), n).cast("int")


def _dealt(state: DataFrame, blocks: list[int], seed: int, sweep: int) -> DataFrame:
    """With the cells of every group dealt into its number of blocks: (g, block) is a group of rows."""
    return state.withColumn("block", _block(blocks, seed, sweep)).repartition(sum(blocks), "g", "block").groupBy("g", "block")


def trade(entry: np.ndarray, trades: int, rng: np.random.Generator) -> None:
    """Trades between two random rows of a 0/1 matrix: what only one of them has is pooled, shuffled and dealt back in the same
    numbers. Row sums and column sums stay; a trade that changes nothing counts too."""
    for _ in range(trades):
        a, b = rng.choice(len(entry), 2, replace=False)
        apart = np.flatnonzero(entry[a] ^ entry[b])
        n = int(entry[a, apart].sum())
        if 0 < n < len(apart):
            pool = rng.permutation(apart)
            entry[a, pool], entry[b, pool] = False, True
            entry[a, pool[:n]], entry[b, pool[:n]] = True, False


def _mixed(state: DataFrame, draws: int, dims: list[int], blocks: list[int], marks: list[int], seed: int) -> DataFrame:
    """Every chain of every group after each of the numbers of sweeps in ``marks``, kept in ``past`` in their order."""
    last = max(marks)
    rounds = [range(1, last + 1)] if max(blocks) == 1 else [[r] for r in range(1, last + 1)]

    def round_of(sweeps):
        def run(key, f: pd.DataFrame) -> pd.DataFrame:
            g, block = int(key[0]), int(key[1])
            f = f.sort_values("cell", ignore_index=True)
            entry = _unpack(f.now, draws, dims[g])
            past = [list(p) for p in f.past]
            for r in sweeps:
                for i in range(draws if dims[g] > 1 else 0):
                    x = np.ascontiguousarray(entry[:, i].T)
                    trade(x, len(x), np.random.default_rng([seed, r, g, block, i]))
                    entry[:, i] = x.T
                if r in marks:
                    for p, now in zip(past, _pack(entry), strict=True):
                        p.append(now)
            return pd.DataFrame({"g": np.full(len(f), g, np.int32), "cell": f.cell, "now": _pack(entry), "past": past})

        return run

    for sweeps in rounds if last else []:
        state = _dealt(state, blocks, seed, sweeps[0]).applyInPandas(round_of(sweeps), _STATE)
    return state if last else state.withColumn("past", F.array("now"))


def _rows(state: DataFrame, draws: int, dims: list[np.ndarray], marks: list[int], seed: int, weighted: bool = False) -> DataFrame:
    """(g, draw, mark, dim, cell, w) of the kept states. If ``weighted``, each cell's weights ``ws`` are permuted over its inputs."""
    dealt = state.select("g", "cell", "past", *(["ws"] if weighted else []))

    def run(frames):
        for f in frames:
            for g, f in f.groupby("g"):
                cell = f.cell.to_numpy(np.int64)
                for m, mark in enumerate(marks):
                    entry = _unpack([p[m] for p in f.past], draws, len(dims[g]))
                    for draw in range(draws):
                        c, d = np.nonzero(entry[:, draw])
                        w = np.ones(len(c), dtype=np.int64)
                        if weighted and len(c):
                            place = np.arange(len(c)) - np.searchsorted(c, c)
                            w = np.concatenate(f.ws.to_list())[np.lexsort((_random((seed, draw, mark), cell[c], place), c))]
                        yield pd.DataFrame({"g": np.int32(g), "draw": draw, "mark": mark, "dim": dims[g][d], "cell": cell[c], "w": w})

    return dealt.mapInPandas(run, "g int, draw long, mark long, dim long, cell long, w long")


def _start(cells: DataFrame, dims: np.ndarray, draws: int) -> DataFrame:
    """Every draw begins as the wiring itself."""

    def run(frames):
        for f in frames:
            entry = np.broadcast_to(_bits(f, dims)[:, None], (len(f), draws, len(dims)))
            yield pd.DataFrame({"g": np.zeros(len(f), np.int32), "cell": f.cell, "now": _pack(entry), "past": [[] for _ in range(len(f))]})

    return cells.select("cell", "has").mapInPandas(run, _STATE)


def curveball(wiring: DataFrame, draws: int, sweeps: int = 5, seed: int = 1) -> DataFrame:
    """(draw, dim, cell, w): ``draws`` independent chains of ``sweeps`` trades per dim from the same wiring."""
    return curveball_path(wiring, draws, [sweeps], seed).select("draw", "dim", "cell", "w")


def curveball_path(wiring: DataFrame, draws: int, marks: list[int], seed: int = 1) -> DataFrame:
    """(draw, mark, dim, cell, w): every chain after each of the numbers of sweeps in ``marks``, from one walk a draw; the chains
    are those of ``curveball``. Each cell keeps its weights, which are dealt anew at each mark and do not steer the walk."""
    state, dims = _chains(wiring, draws, marks, seed)
    return path_rows(state, draws, marks, seed, dims)


def chains(wiring: DataFrame, draws: int, marks: list[int], seed: int = 1) -> DataFrame:
    """(cell, ws, dims, past): the chains of ``curveball_path`` with a row a cell, which has its dims in every draw as a string of bits for
    each mark, and its weights; ``dims``, the same in all rows, names the bits."""
    state, dims = _chains(wiring, draws, marks, seed)
    return state.select("cell", "ws", F.array(*[F.lit(int(x)) for x in dims]).cast("array<long>").alias("dims"), "past")


def _chains(wiring: DataFrame, draws: int, marks: list[int], seed: int) -> tuple[DataFrame, np.ndarray]:
    marks = sorted(set(marks))
    cells, dims, n = _cells(wiring)
    mixed = _mixed(_start(cells, dims, draws), draws, [len(dims)], [_blocks(n)], marks, seed)
    return mixed.select("cell", "past").join(cells.select("cell", "ws"), "cell"), dims


def dims_of(state: DataFrame) -> np.ndarray:
    return np.array([x for r in state.select("dims").limit(1).collect() for x in r.dims], dtype=np.int64)


def path_rows(state: DataFrame, draws: int, marks: list[int], seed: int = 1, dims: np.ndarray | None = None) -> DataFrame:
    """(draw, mark, dim, cell, w) of ``chains``."""
    held = state.select(F.lit(0).alias("g"), "cell", "ws", "past")
    return _rows(held, draws, [dims_of(state) if dims is None else dims], sorted(set(marks)), seed, weighted=True).drop("g").select("draw", "mark", "dim", "cell", "w")


def path_overlaps(state: DataFrame, draws: int, marks: list[int]) -> DataFrame:
    """(draw, mark, a, b, n): the cells that every two dims a < b share in ``chains``, without a row for an entry or a pair of
    entries: products of the bits of a batch, summed in a task."""
    marks, dims = sorted(set(marks)), dims_of(state)
    pairs = np.triu_indices(len(dims), 1)

    def run(batches):
        total = np.zeros((len(marks), draws, len(dims), len(dims)))
        for f in batches:
            size = draws * -(-len(dims) // 8)
            raw = np.frombuffer(b"".join(f.column(0).flatten().to_pylist()), dtype=np.uint8).reshape(f.num_rows, len(marks), size)
            for m in range(len(marks)):
                x = np.unpackbits(raw[:, m].reshape(f.num_rows, draws, -1), axis=2, count=len(dims))
                for i in range(draws):
                    y = x[:, i].astype(np.float32)  # a batch has far fewer cells than 2**24
                    total[m, i] += y.T @ y
        for m, mark in enumerate(marks):
            for i in range(draws):
                n = np.rint(total[m, i][pairs]).astype(np.int64)
                cols = [np.full(len(n), i), np.full(len(n), mark), dims[pairs[0]], dims[pairs[1]], n]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["draw", "mark", "a", "b", "n"])

    return state.select("past").mapInArrow(run, "draw long, mark long, a long, b long, n long").groupBy("draw", "mark", "a", "b").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- margins kept or evened
def level(entry: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
    """Moves entries of a 0/1 matrix along its rows until the columns hold ``target``; row sums stay. A fuller column has a
    row that a less full one lacks, so a move from above its target to below it exists whenever the surplus column holds more."""
    have = entry.sum(axis=0)
    if have.sum() != target.sum():
        raise ValueError("the targets do not hold as many entries as the matrix")
    while (have != target).any():
        over, under = np.flatnonzero(have > target), np.flatnonzero(have < target)
        a, b = over[have[over].argmax()], under[have[under].argmin()]
        rows = np.flatnonzero(entry[:, a] & ~entry[:, b])
        if not len(rows):
            raise ValueError("no 0/1 matrix has these margins")
        n = min(len(rows), have[a] - target[a], target[b] - have[b])
        moved = rng.permutation(rows)[:n]
        entry[moved, a], entry[moved, b] = False, True
        have[a] -= n
        have[b] += n


def even(total: int, n: int, rng: np.random.Generator) -> np.ndarray:
    out = np.full(n, total // n, dtype=np.int64)
    out[rng.permutation(n)[: total % n]] += 1
    return out


def margin_control(wiring: DataFrame, draws: int, equal_in: bool, equal_out: bool, sweeps: int = 5, seed: int = 1) -> DataFrame:
    """Margins kept, or evened on one side or both: entries of the given wiring are moved until the margins are reached, and then
    mixed by trades. Entries count 1. Blocks even their dims on their own, with the remainders dealt in turn, so that all of
    them together are even; cells of several blocks are evened by making the wiring anew from its margins."""
    cells, dims, n = _cells(wiring)
    blocks, d = _blocks(n), len(dims)
    state = _start(cells, dims, draws)
    if equal_in and blocks > 1:
        return realise(_evened(cells, dims, n, equal_out, seed), draws, sweeps, seed)
    if equal_in or equal_out:
        dealt = _dealt(state, [blocks], seed, 0)
        has = cells.select(F.lit(0).alias("g"), "cell", F.size("has").alias("n"))
        total = {r.block: r.n for r in _dealt(has, [blocks], seed, 0).agg(F.sum("n").alias("n")).collect()}  # a row per block
        before, at = {}, 0
        for b in sorted(total):
            before[b], at = at, at + total[b] % d

        def run(key, f: pd.DataFrame) -> pd.DataFrame:
            block = int(key[1])
            f = f.sort_values("cell", ignore_index=True)
            entry = _unpack(f.now, draws, d)
            for i in range(draws):
                g = np.random.default_rng([seed, i, equal_in, equal_out, block])
                x = np.ascontiguousarray(entry[:, i].T)
                if equal_in:
                    level(x, even(total[block], len(f), g), g)
                if equal_out:
                    each, more = divmod(total[block], d)
                    target = np.full(d, each, dtype=np.int64)
                    turn = np.random.default_rng([seed, i]).permutation(d)
                    target[turn[(before[block] + np.arange(more)) % d]] += 1
                    level(x.T, target, g)
                entry[:, i] = x.T
            return pd.DataFrame({"g": np.zeros(len(f), np.int32), "cell": f.cell, "now": _pack(entry), "past": f.past})

        state = dealt.applyInPandas(run, _STATE)
    mixed = _mixed(state, draws, [d], [blocks], [sweeps], seed)
    return _rows(mixed, draws, [dims], [sweeps], seed).select("draw", "dim", "cell", "w")


def _evened(cells: DataFrame, dims: np.ndarray, n: int, equal_out: bool, seed: int) -> DataFrame:
    """Margins (side, id, n) with as many inputs for every cell, the remainder to the first cells by digest."""
    spark = cells.sparkSession
    fan = {r.dim: r.n for r in cells.select(F.explode("has").alias("dim")).groupBy("dim").agg(F.count("*").alias("n")).collect()}
    total = sum(fan.values())
    if equal_out:
        fan = dict(zip(dims.tolist(), even(total, len(dims), np.random.default_rng([seed, 1])).tolist(), strict=True))
    first = cells.select("cell").orderBy(F.xxhash64(F.lit(seed), "cell"), "cell").limit(total % n).withColumn("more", F.lit(1))
    inputs = cells.select("cell").join(first, "cell", "left").select(F.lit("cell").alias("side"), F.col("cell").alias("id"), (F.lit(total // n) + F.coalesce("more", F.lit(0))).cast("long").alias("n"))
    return inputs.unionByName(spark.createDataFrame([("dim", int(k), int(v)) for k, v in fan.items()], "side string, id long, n long"))


def swap_gains(apart: np.ndarray, lean: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """How the number of four-cycles changes when cells p of row a and q of row b change rows, for every pair. With m a row's
    overlaps with another row and e that row's entries, an exchange adds (e_q - e_p)(m_a - m_b) + (e_q - e_p)**2, summed over
    the other rows. ``apart``: cells x rows; ``lean``: m_a - m_b, zero for a and b themselves, whose columns are left out."""
    x, y = apart[p].astype(np.int64), apart[q].astype(np.int64)
    gap = x.sum(axis=1)[:, None] + y.sum(axis=1)[None, :] - 2 * (x @ y.T)
    return (y @ lean)[None, :] - (x @ lean)[:, None] + gap


def _strings(cells: DataFrame, dims: np.ndarray) -> DataFrame:
    """(cell, bits): the dims of each cell as a string of bits, which a scan reads without an object for a cell or a dim."""

    def run(batches):
        for b in batches:
            has = b.column(1)
            x = np.zeros((b.num_rows, len(dims)), dtype=bool)
            x[np.repeat(np.arange(b.num_rows), has.value_lengths().to_numpy()), np.searchsorted(dims, has.flatten().to_numpy())] = True
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in np.packbits(x, axis=1)], pa.binary())], names=["cell", "bits"])

    return cells.select("cell", "has").mapInArrow(run, "cell long, bits binary")


def _read(col: pa.Array, dims: int) -> np.ndarray:
    """Cells x dims of such strings."""
    raw = np.frombuffer(b"".join(col.to_pylist()), dtype=np.uint8).reshape(len(col), -(-dims // 8))
    return np.unpackbits(raw, axis=1, count=dims).astype(bool)


def overlaps_of(cells: DataFrame, dims: np.ndarray) -> np.ndarray:
    """Shared cells of every two dims of ``cells`` (cell, bits): a matrix of dims for each task, summed."""

    def run(batches):
        total = np.zeros((len(dims), len(dims)), dtype=np.int64)
        for b in batches:
            x = _read(b.column(0), len(dims)).astype(np.float64)
            total += np.rint(x.T @ x).astype(np.int64)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["a", "b", "n"])

    out = np.zeros((len(dims), len(dims)), dtype=np.int64)
    for r in cells.select("bits").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        out[r.a, r.b] = r.n
    return out


AHEAD, MOST, WIDEST, PART = 64, 64, 4096, 1 << 15
_NO = np.iinfo(np.int64).max


def _lean(shared: np.ndarray, a: int, b: int) -> np.ndarray:
    out = shared[a] - shared[b]
    out[[a, b]] = 0
    return out


def _patterns(strings: DataFrame, most: int) -> DataFrame:
    """(bits, names): cells with the same dims are alike but for their names, of which a pattern keeps the ``most`` smallest."""
    first = F.row_number().over(Window.partitionBy("bits").orderBy("cell"))
    kept = strings.withColumn("r", first).filter(F.col("r") <= most)
    kept = reliable(kept.groupBy("bits").agg(F.array_sort(F.collect_list("cell")).alias("names")))
    return reliable(kept.coalesce(max(1, kept.count() // PART)))  # a part gives the best of its patterns for every pair


def _candidates(patterns: DataFrame, dims: np.ndarray, wanted: list, most: int, ahead: int) -> dict:
    """For each of ``wanted`` (draw, a, b, lean, cells left aside): the ``most`` of ``patterns`` (bits, names) with a but not b that
    lean most to a, and those with b but not a that lean least: {(draw, a, b): ((names, bits, leans), the same for b)}, in order of
    their leans and smallest names. A pattern has the first ``ahead`` of its names that are not left aside."""
    spark = patterns.sparkSession
    asides = {draw: np.array(sorted(aside), dtype=np.int64) for draw, _, _, _, aside in wanted}
    held = spark.sparkContext.broadcast(([(draw, a, b, lean) for draw, a, b, lean, _ in wanted], asides))

    def run(batches):
        pairs, asides = held.value
        best: dict = {}  # (k, side): scores, smallest names, bits and names of the first ``most`` so far
        for f in batches:
            x = _read(f.column(0), len(dims))
            bits = np.packbits(x, axis=1)
            of = f.column(1)
            size, flat = of.value_lengths().to_numpy(), of.flatten().to_numpy()
            end = np.cumsum(size)
            free, least = {}, {}
            for draw, aside in asides.items():
                free[draw] = ~np.isin(flat, aside)
                least[draw] = np.minimum.reduceat(np.where(free[draw], flat, _NO), end - size)
            score = np.rint(x.astype(np.float64) @ np.array([lean for _, _, _, lean in pairs], dtype=np.float64).T).astype(np.int64)
            apart = {}
            for k, (draw, a, b, _) in enumerate(pairs):
                for side, own, other, sign in ((0, a, b, -1), (1, b, a, 1)):
                    if (draw, own, other) not in apart:
                        apart[draw, own, other] = np.flatnonzero(x[:, own] & ~x[:, other] & (least[draw] != _NO))
                    at = apart[draw, own, other]
                    s = sign * score[at, k]
                    have = best.get((k, side))
                    if have is not None and len(have[0]) == most:
                        at, s = at[s <= have[0][-1]], s[s <= have[0][-1]]
                    elif len(at) > most:
                        edge = np.partition(s, most - 1)[most - 1]
                        at, s = at[s <= edge], s[s <= edge]
                    if len(at):
                        name = least[draw][at]
                        at = at[first := np.lexsort((name, s))[:most]]
                        s, name, strings = s[first], name[first], bits[at]
                        names = np.empty(len(at), dtype=object)
                        for j, i in enumerate(at.tolist()):
                            own_names = slice(end[i] - size[i], end[i])
                            names[j] = flat[own_names][free[draw][own_names]][:ahead].tobytes()
                        if have is not None:
                            s, name, strings, names = (np.concatenate([old, new]) for old, new in zip(have, (s, name, strings, names), strict=True))
                            first = np.lexsort((name, s))[:most]
                            s, name, strings, names = s[first], name[first], strings[first], names[first]
                        best[k, side] = s, name, strings, names
        for (k, side), (s, name, strings, names) in best.items():
            of = [pa.array(np.full(len(s), i, np.int32)) for i in (k, side)]
            rows = [pa.array([r.tobytes() for r in strings], pa.binary()), pa.array(names.tolist(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*of, pa.array(name), *rows, pa.array(s)], names=["k", "side", "least", "bits", "names", "s"])

    got = patterns.select("bits", "names").mapInArrow(run, "k int, side int, least long, bits binary, names binary, s long")
    first = F.row_number().over(Window.partitionBy("k", "side").orderBy("s", "least"))
    out = {}
    for r in got.withColumn("r", first).filter(F.col("r") <= most).select("k", "side", "r", "bits", "names", "s").collect():
        out.setdefault((r.k, r.side), []).append((r.r, r.bits, r.names, r.s))
    held.unpersist()
    found = {}
    for k, (draw, a, b, _, _) in enumerate(wanted):
        both = []
        for side, sign in ((0, -1), (1, 1)):
            rows = sorted(out.get((k, side), []))
            names = [np.frombuffer(r[2], dtype=np.int64).tolist() for r in rows]
            both.append((names, _read(pa.array([r[1] for r in rows], pa.binary()), len(dims)), np.array([sign * r[3] for r in rows], dtype=np.int64)))
        found[draw, a, b] = tuple(both)
    return found


class _Walk:
    """One draw of ``diversify``: the pairs of rows in their order, the overlaps as they are, and the cells changed so far."""

    def __init__(self, draw: int, dims: int, steps: int, seed: int, shared: np.ndarray):
        self.pairs = np.random.default_rng([seed, draw]).integers(dims, size=(steps, 2)).tolist()
        self.draw, self.at, self.shared, self.changed = draw, 0, shared.copy(), {}

    def ahead(self, n: int) -> list:
        pairs = {(a, b) for a, b in self.pairs[self.at : self.at + n] if a != b}
        return [(self.draw, a, b, _lean(self.shared, a, b), set(self.changed)) for a, b in sorted(pairs)]

    def go(self, found: dict, since: np.ndarray, most: int, n: int) -> None:
        """Steps as long as no pattern outside of ``found`` can do better; ``since``: the overlaps when it was found. The first step is taken in any case where ``most`` is WIDEST."""
        end, begun = min(self.at + n, len(self.pairs)), self.at
        while self.at < end:
            a, b = self.pairs[self.at]
            if a != b:
                lean, was = _lean(self.shared, a, b), _lean(since, a, b)
                sides = []
                for side, (own, other) in enumerate(((a, b), (b, a))):
                    of, bits, s = found[self.draw, a, b][side]
                    left = [next((c for c in names if c not in self.changed), _NO) for names in of]  # a step changes one cell of a pattern at most
                    keep = np.lexsort((np.array(left, dtype=np.int64), s if side else -s))
                    keep = keep[[left[i] != _NO for i in keep.tolist()]]
                    late = [(c, x) for c, x in sorted(self.changed.items()) if x[own] and not x[other]]
                    names = [left[i] for i in keep.tolist()] + [c for c, _ in late]
                    # what the cells that were not found may lean by now
                    drift = np.maximum(lean - was, 0).sum() if side == 0 else np.minimum(lean - was, 0).sum()
                    sides.append((names, np.concatenate([bits[keep], np.array([x for _, x in late], dtype=bool).reshape(len(late), len(lean))]), s[-1] + drift if len(of) == most else None))
                (pn, px, pmost), (qn, qx, qleast) = sides
                rest = np.delete(np.arange(len(lean)), [a, b])
                both = np.concatenate([px, qx])[:, rest]
                gain = swap_gains(both, lean[rest], np.arange(len(pn)), np.arange(len(pn), len(pn) + len(qn)))
                best = int(gain.min()) if gain.size else 0
                ps, qs = (px @ lean).tolist(), (qx @ lean).tolist()
                floor = []
                if pmost is not None:
                    floor.append(min([*qs, *([] if qleast is None else [qleast])], default=np.inf) - pmost)
                if qleast is not None:
                    floor.append(qleast - max([*ps, *([] if pmost is None else [pmost])], default=-np.inf))
                if min(floor, default=np.inf) < min(best, 0) and not (most >= WIDEST and self.at == begun):
                    return
                if best < 0:
                    i, j = np.unravel_index(gain.argmin(), gain.shape)
                    for names, bits, k, own, other in ((pn, px, i, a, b), (qn, qx, j, b, a)):
                        old = bits[k].astype(np.int64)
                        new = old.copy()
                        new[own], new[other] = 0, 1
                        self.shared += np.outer(new, new) - np.outer(old, old)
                        self.changed[names[k]] = new.astype(bool)
            self.at += 1


def diversify(wiring: DataFrame, draws: int, steps: int = 200, seed: int = 1) -> DataFrame:
    """Fewer four-cycles with the same margins: for one pair of rows after another, the exchange of two entries that lowers
    their number most. An exchange depends on the overlaps of all dims and on the two cells, so the driver walks through the
    pairs with the overlaps and, for each, the patterns of cells that promise most, which one scan finds for many pairs; it scans
    again where a pattern that was not found might do better. It holds those patterns and the changed cells, two a step. Cells
    with the same dims count as one pattern, so a scan grows with the patterns, and equal cells do not crowd out others."""
    cells = reliable(wiring.groupBy("cell").agg(F.collect_set("dim").alias("has")))
    dims = np.array(sorted(r.dim for r in cells.select(F.explode("has").alias("dim")).distinct().collect()), dtype=np.int64)  # of one circuit
    strings = reliable(_strings(cells, dims))
    patterns = _patterns(strings, steps)
    shared = overlaps_of(strings, dims)
    walks = [_Walk(i, len(dims), steps, seed, shared) for i in range(draws)]
    most, ahead = MOST, AHEAD
    while left := [x for x in walks if x.at < steps]:
        wanted = [p for x in left for p in x.ahead(ahead)]
        found = _candidates(patterns, dims, wanted, most, ahead) if wanted else {}
        stuck = False
        for x in left:
            at, since = x.at, x.shared.copy()
            x.go(found, since, most, ahead)
            stuck |= x.at == at
        most, ahead = (min(4 * most, WIDEST), max(1, ahead // 4)) if stuck else (MOST, AHEAD)
    new = [(x.draw, int(c), dims[bits].tolist()) for x in walks for c, bits in x.changed.items()]
    changed = wiring.sparkSession.createDataFrame(new, "draw long, cell long, new array<long>")  # two cells a step
    every = cells.select("cell", "has", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(draws - 1).cast("long"))).alias("draw"))
    return every.join(F.broadcast(changed), ["draw", "cell"], "left").select("draw", F.explode(F.coalesce("new", "has")).alias("dim"), "cell", F.lit(1).cast("long").alias("w"))


def margins(drawn: DataFrame) -> DataFrame:
    """(draw, side, id, n): row and column sums of every draw."""
    a = drawn.groupBy("draw", F.lit("dim").alias("side"), F.col("dim").alias("id")).agg(F.count("*").alias("n"))
    return a.unionByName(drawn.groupBy("draw", F.lit("cell").alias("side"), F.col("cell").alias("id")).agg(F.count("*").alias("n")))


# ---------------------------------------------------------------- allocation
def room(inputs: np.ndarray, d: int, top: int) -> np.ndarray:
    """How many entries any k = 0..d rows can hold at most: each of them ``top``, and a column no more than its inputs."""
    k = np.arange(d + 1)
    size, many = np.unique(np.asarray(inputs, dtype=np.int64), return_counts=True)
    return np.minimum((np.minimum(size[:, None], k) * many[:, None]).sum(axis=0), k * top)


def shares(lam: np.ndarray, alpha: float, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the dims, heaviest first, and their fan-outs in proportion to lam**alpha as far as ``most`` (the room of the
    first k dims, cut at the total) allows.

    ``most`` is concave, so the fan-outs nearest to proportion are the slopes of the greatest convex line below the points
    (sum of weights, room). Weights are taken relative to the first dim of each stretch of that line, from logarithms,
    so that none of them vanishes beside a larger one. Equal spectrum entries share what they got alike.
    """
    lam = np.asarray(lam, dtype=float)
    if not len(lam) or not np.isfinite(lam).all() or (lam < 0).any() or np.isnan(alpha) or alpha == -np.inf:
        raise ValueError("the spectrum must be finite and not negative, and alpha a number or infinite")
    log = np.log(np.maximum(lam, 1e-300))
    weight = np.sign(alpha) * log if np.isinf(alpha) else alpha * log
    order = np.lexsort((np.arange(len(lam)), -weight))
    weight = weight[order]
    if np.isinf(alpha):
        out = np.diff(most).astype(float)
    else:
        out, at = np.zeros(len(lam)), 0
        while at < len(lam):
            rel = np.exp(np.maximum(weight[at:] - weight[at], -700.0))
            slope = (most[at + 1 :] - most[at]) / np.cumsum(rel)
            to = int(np.flatnonzero(slope <= slope.min() * (1 + 1e-12))[-1]) + 1
            out[at : at + to] = rel[:to] * slope.min()
            at += to
    group = np.concatenate(([0], np.cumsum(np.diff(weight) != 0)))
    return order, (np.bincount(group, weights=out) / np.bincount(group))[group]


def whole(share: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whole fan-outs, falling like ``share``, whose first k never exceed most[k].

    Running sums are cut to whole numbers and their steps sorted, which keeps each within one of its share. Where the first k
    then hold too much, the last dim as large as the k-th gives one to the first dim that is smaller by two or more; such
    a dim exists, because ``most`` is concave and holds the total, and each gift makes the fan-outs more even, so they end.
    """
    upto = np.cumsum(share)
    cut = np.where(np.abs(upto - np.rint(upto)) < 1e-7, np.rint(upto), np.floor(upto)).astype(np.int64)
    cut[-1] = most[-1]
    f = np.sort(np.diff(np.concatenate(([0], cut))))[::-1].copy()
    while (over := np.flatnonzero(np.cumsum(f) > most[1:])).size:
        value = f[over[0]]
        f[np.flatnonzero(f == value)[-1]] -= 1
        f[np.flatnonzero(f <= value - 2)[0]] += 1
    start = np.flatnonzero(np.concatenate(([True], np.diff(share) != 0, [True])))
    for a, b in zip(start[:-1], start[1:], strict=True):  # equal shares end within one of each other
        each, more = divmod(int(f[a:b].sum()), b - a)
        f[a:b] = each + (np.arange(b - a) < more)
    return f


def power_allocation(lam: np.ndarray, alpha: float, inputs: np.ndarray, top: int | None = None) -> np.ndarray:
    """Whole fan-outs of the dims in proportion to lam**alpha, as far as a 0/1 matrix with ``inputs`` entries a cell and at most
    ``top`` (half of the cells) a dim exists; alpha = inf fills the dims with the largest spectrum entries first, and a
    negative alpha prefers small ones. An entry of 0 counts as 1e-300."""
    d, total = len(lam), int(np.sum(inputs))
    top = max(1, len(inputs) // 2) if top is None else top
    most = room(inputs, d, top)
    if most[-1] < total:
        raise ValueError("more connections than places")
    most = np.minimum(most, total)
    order, share = shares(lam, alpha, most)
    out = np.empty(d, dtype=np.int64)
    out[order] = whole(share, most)
    return out


def allocations(spectra: DataFrame, cells: DataFrame, alphas: list[float], by: list[str], part: float = 0.5) -> DataFrame:
    """(*by, alpha, dim, share, fan_out) for the spectrum (*by, dim, lam) of every circuit and the inputs (*by, cell, n) of its
    cells; no dim takes more than ``part`` of the cells. A circuit's spectrum is a row of its dims, and its cells count only by
    how many have how many inputs, so what a task holds does not grow with the cells."""
    lam = spectra.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("dim", F.col("lam").cast("double").alias("lam")))).alias("spectrum"))
    held = cells.groupBy(*by, F.col("n").cast("long").alias("n")).agg(F.count("*").alias("many")).groupBy(*by).agg(F.collect_list(F.struct("n", "many")).alias("held"))
    rows = lam.join(held, by).withColumn("alpha", F.explode(F.array(*[F.lit(float(a)) for a in alphas])))
    kept = rows.select(*by, "alpha", "spectrum", "held")
    types = {f.name: f.dataType.simpleString() for f in kept.schema.fields}

    def run(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                n = np.repeat(np.array([h["n"] for h in r.held]), [h["many"] for h in r.held])
                lams = np.array([x["lam"] for x in r.spectrum])
                most = np.minimum(room(n, len(lams), max(1, int(part * len(n)))), n.sum())
                if most[-1] < n.sum():
                    raise ValueError("more connections than places")
                order, share = shares(lams, r.alpha, most)
                yield pd.DataFrame({**{c: getattr(r, c) for c in by}, "alpha": r.alpha, "dim": np.array([x["dim"] for x in r.spectrum])[order], "share": share, "fan_out": whole(share, most)})

    return kept.mapInPandas(run, ", ".join(f"{c} {types[c]}" for c in by) + ", alpha double, dim long, share double, fan_out long")


# ---------------------------------------------------------------- margins alone
def matrix_of(rows: np.ndarray, columns: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A 0/1 matrix with these row and column sums, or ValueError where none exists. The rows, longest first, take the columns
    that have most left to give (equal ones in random order): what is left then stays as even as it can be, so a row finds no
    place only where no matrix has the margins."""
    if rows.sum() != columns.sum() or (rows < 0).any() or (columns < 0).any():
        raise ValueError("no 0/1 matrix has these margins")
    entry, left = np.zeros((len(rows), len(columns)), dtype=bool), columns.copy()
    for i in np.lexsort((rng.permutation(len(rows)), -rows)):
        n = int(rows[i])
        if n > len(columns):
            raise ValueError("no 0/1 matrix has these margins")
        first = np.lexsort((rng.permutation(len(columns)), -left))[:n]
        if n and left[first[-1]] <= 0:
            raise ValueError("no 0/1 matrix has these margins")
        entry[i, first] = True
        left[first] -= 1
    return entry


def segments(rows: np.ndarray, sizes: dict[int, int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A 0/1 matrix with these row sums and ``sizes[c]`` columns of sum c, or ValueError where none exists, as runs of equal
    columns: for each c the ends of its runs and their columns (runs x rows). The rows, longest first, take the columns that have
    most left to give, as in ``matrix_of``; a row cuts one run at most, so there are no more runs than sums and rows."""
    rows = np.asarray(rows, dtype=np.int64)
    if rows.sum() != sum(c * m for c, m in sizes.items()) or (rows < 0).any() or min(sizes, default=0) < 0:
        raise ValueError("no 0/1 matrix has these margins")
    runs = [(c, m, c, ()) for c, m in sorted(sizes.items())]
    for i in np.argsort(-rows, kind="stable").tolist():
        need, out = int(rows[i]), []
        for c, m, left, has in sorted(runs, key=lambda x: -x[2]):
            take = min(need, m)
            if take and left <= 0:
                raise ValueError("no 0/1 matrix has these margins")
            need -= take
            out += [(c, take, left - 1, (*has, i))] if take else []
            out += [(c, m - take, left, has)] if take < m else []
        if need:
            raise ValueError("no 0/1 matrix has these margins")
        runs = out
    found = {}
    for c in sizes:
        mine = [(m, has) for k, m, _, has in runs if k == c]
        column = np.zeros((len(mine), len(rows)), dtype=bool)
        for j, (_, has) in enumerate(mine):
            column[j, list(has)] = True
        found[c] = np.cumsum([m for m, _ in mine]), column
    return found


def realise(margins_: DataFrame, draws: int, sweeps: int = 5, seed: int = 1, by: list[str] | None = None) -> DataFrame:
    """(*by, draw, dim, cell, w): random wirings of given margins (*by, side, id, n), ``side`` being dim or cell: a matrix made from
    the margins alone, mixed by trades. Margins that no wiring has are refused. Cells with as many inputs are alike until
    they are mixed, so the matrix is made as runs of equal columns, and a cell takes its column by its place among them."""
    by = by or []
    made = _realised(margins_, draws, sweeps, seed, by)
    if made is None:
        return margins_.sparkSession.createDataFrame([], margins_.select(*by).schema.add("draw", "long").add("dim", "long").add("cell", "long").add("w", "long"))
    state, dims, known = made
    got = _rows(state, draws, dims, [sweeps], seed)
    if not by:
        return got.select("draw", "dim", "cell", "w")
    return got.join(F.broadcast(known), "g").select(*by, "draw", "dim", "cell", "w")  # a row per circuit


def realised_bits(margins_: DataFrame, draws: int, sweeps: int = 5, seed: int = 1, by: list[str] | None = None) -> tuple[DataFrame, list[np.ndarray], DataFrame] | None:
    """The wirings of ``realise`` without a row for an entry or a cell: (g, bits), the entries (cells x draws x dims) of some cells of
    circuit g as one string of bytes; the dims of each circuit; and its names (g, *by). None where there is no circuit."""
    made = _realised(margins_, draws, sweeps, seed, by or [])
    if made is None:
        return None
    state, dims, known = made

    def run(batches):
        for b in batches:
            g, past = b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False)
            for k in np.unique(g).tolist():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b"".join(past[g == k])], pa.binary())], names=["g", "bits"])

    return state.select("g", "past").mapInArrow(run, "g int, bits binary"), dims, known


def entries_of(bits: bytes, draws: int, dims: int) -> np.ndarray:
    """Cells x draws x dims of such a string."""
    return np.unpackbits(np.frombuffer(bits, dtype=np.uint8).reshape(-1, draws, -(-dims // 8)), axis=2, count=dims).astype(bool)


def _realised(margins_: DataFrame, draws: int, sweeps: int, seed: int, by: list[str]):
    """The mixed cells of all circuits, the dims of each, and their names (g, *by); None where there is none."""
    spark = margins_.sparkSession
    own = F.to_json(F.struct(*by)) if by else F.lit("{}")
    m = reliable(margins_.select(*by, "side", "id", F.col("n").cast("long").alias("n")).withColumn("_own", own))
    rows = m.filter("side = 'dim'").orderBy("_own", "id").collect()  # dims of the circuits
    sums = m.filter("side = 'cell'").groupBy("_own", "n").agg(F.count("*").alias("many")).collect()  # a row per circuit and number of inputs
    names = sorted({r._own for r in rows} | {r._own for r in sums})
    if not names:
        return None
    dims = [np.array([r.id for r in rows if r._own == k], dtype=np.int64) for k in names]
    sizes = [{r.n: r.many for r in sums if r._own == k} for k in names]
    made = [segments(np.array([r.n for r in rows if r._own == k], dtype=np.int64), s) for k, s in zip(names, sizes, strict=True)]
    blocks = [_blocks(sum(s.values())) for s in sizes]
    known = spark.createDataFrame(list(enumerate(names)), "g int, _own string")
    cells = m.filter("side = 'cell'").join(F.broadcast(known), "_own").select("g", F.col("id").alias("cell"), "n")  # a row per circuit
    # cells of every block by their inputs: where a block's cells stand among those of all
    counts = _dealt(cells, blocks, seed, 0)
    first, upto = {}, {}
    for r in sorted(cells.withColumn("block", _block(blocks, seed, 0)).groupBy("g", "block", "n").agg(F.count("*").alias("many")).collect()):
        first[r.g, r.block, r.n] = upto.get((r.g, r.n), 0)
        upto[r.g, r.n] = first[r.g, r.block, r.n] + r.many

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        g, block = int(key[0]), int(key[1])
        f = f.sort_values("cell", ignore_index=True)
        cell, n = f.cell.to_numpy(np.int64), f.n.to_numpy(np.int64)
        entry = np.zeros((len(f), draws, len(dims[g])), dtype=bool)
        for i in range(draws):
            order = np.lexsort((_random((seed, i), cell), n))
            for c in np.unique(n).tolist():
                mine = order[n[order] == c]
                turn = int(np.random.default_rng([seed, i, g, c]).integers(sizes[g][c]))
                ends, column = made[g][c]
                at = (first[g, block, c] + np.arange(len(mine)) + turn) % sizes[g][c]
                entry[mine, i] = column[np.searchsorted(ends, at, side="right")]
        return pd.DataFrame({"g": np.full(len(f), g, np.int32), "cell": cell, "now": _pack(entry), "past": [[] for _ in range(len(f))]})

    state = counts.applyInPandas(run, _STATE)
    name = known.join(m.filter("side = 'dim'").select("_own", *by).distinct(), "_own").select("g", *by)
    return _mixed(state, draws, [len(x) for x in dims], blocks, [sweeps], seed), dims, name
