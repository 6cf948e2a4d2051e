"""Weighted bipartite wirings (dim, cell, w, partners): building, restricting, describing and generating them."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparsewing.functions import rng


# ---------------------------------------------------------------- building
EDGES = 500_000


def build(edges: DataFrame, dims: DataFrame, threshold: int = 1, by: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """Edges (pre, post, weight) joined with the type of their source, summed per (dim, cell), with the number of distinct
    sources; entries below the threshold go, and cells without an entry vanish with them. ``by``: columns of the edges or of
    ``dims`` that tell wirings apart, each of which is built on its own. With ``rows``, the number of edges, they are dealt into
    parts of about EDGES by source for the join and then by cell, so that what a task sorts or sums does not grow with the table, and
    both sums need no other shuffle."""
    by = by or []
    n = 1 if rows is None else -(-rows // EDGES)
    if n > 1:  # the join by source would undo a deal by cell that came before it
        edges = edges.repartition(n, "pre")
    g = edges.join(dims.select("pre", "dim", *[c for c in by if c in dims.columns]), "pre").select(*by, "pre", "dim", F.col("post").alias("cell"), "weight")
    if n > 1:
        g = g.repartition(n, "cell")
    g = g.groupBy(*by, "pre", "dim", "cell").agg(F.sum("weight").alias("w"))
    g = g.groupBy(*by, "dim", "cell").agg(F.sum("w").alias("w"), F.count("*").alias("partners"))
    return g.filter(F.col("w") >= threshold)


def dealt(drawn: DataFrame, entries: int) -> DataFrame:
    """Wirings with about ``entries`` entries in all, dealt by cell into parts of about EDGES: what is summed per cell, or per dim and
    cell, then needs no other shuffle, and a task's sums do not grow with the wirings."""
    return drawn.repartition(max(1, -(-entries // EDGES)), "cell")


def select_edges(edges: DataFrame, pre: DataFrame, post: DataFrame) -> DataFrame:
    """Edges whose both ends are named: two semi-joins, no row is multiplied."""
    return edges.join(pre.select("pre").distinct(), "pre", "left_semi").join(post.select("post").distinct(), "post", "left_semi")


def no_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("pre <> post")


def select_nodes(nodes: DataFrame, seed: int = 0, max_n: int | None = None, **rules) -> DataFrame:
    """Conjunctive selector: ``x=value`` or a list for membership, ``x_regex`` anchored at the start; ``max_n`` samples."""
    for k, v in rules.items():
        if k.endswith("_regex"):
            nodes = nodes.filter(F.col(k[:-6]).rlike(f"^(?:{v})"))
        elif k not in nodes.columns:
            raise ValueError(f"unknown selector: {k}")
        else:
            nodes = nodes.filter(F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v)
    return rng.pick(nodes, max_n, "sel", seed, nodes.columns[0]) if max_n else nodes


def align(wiring: DataFrame, dims: DataFrame) -> DataFrame:
    """Restricts to the given dims, those of a circuit; cells left without inputs vanish."""
    return wiring.join(F.broadcast(dims.select("dim").distinct()), "dim", "left_semi")


def dense_index(df: DataFrame, col: str, out: str) -> DataFrame:
    """Numbers the distinct values of a column from 0 in order: offsets of range partitions, then positions inside them."""
    ids = df.select(col).distinct().repartitionByRange(col).sortWithinPartitions(col)
    ids = ids.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(col)))
    per = ids.groupBy("_p").agg(F.count("*").alias("_n")).withColumn("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ids = ids.join(F.broadcast(per.select("_p", "_b")), "_p").select(col, (F.col("_b") + F.col("_i") - 1).cast("bigint").alias(out))  # a row per partition
    return df.join(ids, col)


# ---------------------------------------------------------------- describing
def inputs(wiring: DataFrame) -> DataFrame:
    return wiring.groupBy("cell").agg(F.count("*").alias("inputs"), F.sum("w").cast("bigint").alias("weight"))


def fan_out(wiring: DataFrame) -> DataFrame:
    return wiring.groupBy("dim").agg(F.count("*").alias("fan_out"), F.sum("w").cast("bigint").alias("weight"))


def summary(wiring: DataFrame) -> DataFrame:
    """One row: size, mean, median and largest number of inputs, spread of the fan-out, the dim with the largest one."""
    i = inputs(wiring).agg(F.count("*").alias("cells"), F.sum("inputs").alias("nnz"), F.avg("inputs").alias("mean_inputs"), F.expr("percentile(inputs, 0.5)").alias("median_inputs"), F.max("inputs").alias("max_inputs"), F.count_if(F.col("inputs") == 1).alias("single_input"))
    f = fan_out(wiring).agg(F.count("*").alias("dims"), (F.stddev_pop("fan_out") / F.avg("fan_out")).alias("fan_out_cv"), F.max("fan_out").alias("max_fan_out"), F.max_by("dim", F.struct("fan_out", -F.col("dim"))).alias("top_dim"))
    return i.crossJoin(f)  # one row each


def histogram(wiring: DataFrame) -> DataFrame:
    return inputs(wiring).groupBy("inputs").agg(F.count("*").alias("cells"))


def overlaps(wiring: DataFrame) -> DataFrame:
    """Shared cells of every two dims that have any (a < b). Cells have few inputs, so the self-join stays near the input."""
    a, b = wiring.select("cell", F.col("dim").alias("a")), wiring.select("cell", F.col("dim").alias("b"))
    return a.join(b, "cell").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def co_occurrence(wiring: DataFrame) -> DataFrame:
    """Q: squares of shared cells; four-cycles: pairs of shared cells."""
    return overlaps(wiring).agg(F.sum(F.col("shared") * F.col("shared")).alias("q"), F.sum(F.col("shared") * (F.col("shared") - 1) / 2).cast("bigint").alias("four_cycles"))


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    x = a.select("dim", "cell", F.lit(1).alias("x")).join(b.select("dim", "cell", F.lit(1).alias("y")), ["dim", "cell"], "full_outer")
    return x.agg(F.count("*").alias("either"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("both"))


def retained(wiring: DataFrame, threshold: int) -> DataFrame:
    """What a weight threshold keeps of the entries and of the weight."""
    keep = F.col("w") >= threshold
    return wiring.agg(F.count("*").alias("entries"), F.count_if(keep).alias("kept"), F.sum("w").cast("bigint").alias("weight"), F.sum(F.when(keep, F.col("w"))).cast("bigint").alias("kept_weight"))


def audit(wiring: DataFrame, thresholds: list[int], by: list[str]) -> DataFrame:
    """A row per wiring (``by``) and threshold: what stays of its entries (kept, weight) and their shares, cells, dims, inputs per
    cell, cells with one input, relative deviation of the fan-outs, the dim with the largest one (the smallest of equal ones),
    and Q and the four-cycles of shared cells. Entries are repeated for the thresholds that they reach, once, and summed per
    cell and per dim; pairs of dims come from a cell's own inputs, which are no more than the dims."""
    w = wiring.select(*by, "dim", "cell", "w")
    key = [*by, "threshold"]
    reached = F.filter(F.array(*[F.lit(int(t)) for t in sorted(set(thresholds))]), lambda t: t <= F.col("w"))
    kept = w.withColumn("threshold", F.explode(reached))
    cells = kept.groupBy(*key, "cell").agg(F.count("*").alias("inputs"), F.sum("w").alias("weight"), F.array_sort(F.collect_list("dim")).alias("dims"))
    per_cell = cells.groupBy(*key).agg(
        F.sum("inputs").alias("kept"), F.sum("weight").alias("weight"), F.count("*").alias("cells"), F.avg("inputs").alias("mean_inputs"),
        F.expr("percentile(inputs, 0.5)").alias("median_inputs"), F.max("inputs").alias("max_inputs"), F.count_if(F.col("inputs") == 1).alias("single_input"),
    )
    fan = kept.groupBy(*key, "dim").agg(F.count("*").alias("f"))
    per_dim = fan.groupBy(*key).agg(F.count("*").alias("dims"), (F.stddev_pop("f") / F.avg("f")).alias("fan_out_cv"), F.max("f").alias("max_fan_out"), F.max_by("dim", F.struct("f", -F.col("dim"))).alias("top_dim"))
    pairs = cells.select(*key, "dims", F.posexplode("dims").alias("i", "a")).select(*key, "a", F.explode(F.expr("slice(dims, i + 2, size(dims))")).alias("b"))
    shared = pairs.groupBy(*key, "a", "b").agg(F.count("*").alias("s"))
    loops = shared.groupBy(*key).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.sum(F.expr("s * (s - 1) div 2")).alias("four_cycles"))
    whole = w.groupBy(*by).agg(F.count("*").alias("entries"), F.sum("w").alias("all_weight"))
    out = per_cell.join(per_dim, key).join(loops, key, "left").join(whole, by)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select(
        "entries", "kept", F.round(F.col("kept") / F.col("entries"), 9).alias("kept_share"), F.col("weight").cast("bigint").alias("weight"), F.round(F.col("weight") / F.col("all_weight"), 9).alias("weight_share"),
        "cells", "dims", F.round("mean_inputs", 9).alias("mean_inputs"), "median_inputs", "max_inputs", "single_input", F.round("fan_out_cv", 9).alias("fan_out_cv"), "max_fan_out", "top_dim",
        zero("q"), zero("four_cycles"), *key,
    )


def shuffled_co_occurrence(wiring: DataFrame, thresholds: list[int], by: list[str], draws: int, seed: int) -> DataFrame:
    """(*by, threshold, draw, q): Q of ``draws`` random wirings for each wiring and threshold, in which every cell keeps its number of
    inputs and draws anew which of the wiring's dims they are. A cell's draw is the front of the dims in order of their digests,
    one order for all thresholds; a task sums the shared cells of every two dims, so only those sums are shuffled."""
    key = [*by, "threshold", "draw"]
    w = wiring.select(*by, "dim", "cell", "w")
    every = [int(t) for t in sorted(set(thresholds))]
    counts = [f"n{i}" for i in range(len(every))]
    per = w.groupBy(*by, "cell").agg(*[F.count_if(F.col("w") >= t).cast("int").alias(c) for c, t in zip(counts, every, strict=True)]).filter(F.greatest(F.lit(0), *counts) > 1)
    dims = w.groupBy(*by).agg(F.array_sort(F.collect_set("dim")).alias("dims"))  # a row per wiring
    types = {f.name: f.dataType.simpleString() for f in w.schema.fields}

    def run(frames):
        total: dict = {}
        for f in frames:
            for name, part in f.groupby(by, dropna=False):
                d, inputs, cell = part.dims.iloc[0].tolist(), part[counts].to_numpy(), [f":{c}".encode() for c in part.cell.tolist()]
                for draw in range(draws):
                    front = [f"null:{seed}:{draw}:{x}".encode() for x in d]
                    raw = np.frombuffer(b"".join([md5(x + c).digest() for x in front for c in cell]), dtype=">u8").reshape(len(d), len(cell), 2)
                    order = np.lexsort((raw[:, :, 1].T, raw[:, :, 0].T), axis=-1)  # equal digests: the smaller dim, as the sort is stable
                    place = np.argsort(order, axis=1)
                    for i, t in enumerate(every):
                        have = (place < inputs[:, i : i + 1])[inputs[:, i] > 1].astype(np.float64)
                        key = (*name, t, draw)
                        total[key] = total.get(key, 0) + np.triu(np.rint(have.T @ have).astype(np.int64), 1)
        for (*name, t, draw), m in total.items():
            a, b = np.nonzero(m)
            if len(a):
                yield pd.DataFrame({**dict(zip(by, name, strict=True)), "threshold": np.int32(t), "draw": draw, "a": a, "b": b, "s": m[a, b]})

    pairs = per.join(F.broadcast(dims), by).select(*by, "cell", "dims", *counts).mapInPandas(run, "".join(f"{c} {types[c]}, " for c in by) + "threshold int, draw long, a long, b long, s long")
    return pairs.groupBy(*key, "a", "b").agg(F.sum("s").alias("s")).groupBy(*key).agg(F.sum(F.col("s") * F.col("s")).alias("q"))


def feasible(fan_outs: DataFrame, cells: DataFrame, by: list[str], form: list[str]) -> DataFrame:
    """(*form, entries, excess, feasible): whether a 0/1 matrix exists with the row sums (*form, n) and the column sums (*by, cell,
    n): the largest r rows must not hold more than the columns can give to r rows. ``form`` begins with ``by`` and tells
    sets of row sums apart. Cells count by how many have how many inputs, so the join is of rows times distinct sums."""
    o = Window.partitionBy(*form).orderBy(F.col("n").desc())
    pre = fan_outs.withColumns({"r": F.row_number().over(o), "pre": F.sum("n").over(o.rowsBetween(Window.unboundedPreceding, 0))})
    held = cells.groupBy(*by, F.col("n").alias("c")).agg(F.count("*").alias("many"))
    bound = pre.join(held, by).groupBy(*form, "r", "pre").agg(F.sum(F.least("c", "r") * F.col("many")).alias("bound"), F.sum(F.col("c") * F.col("many")).alias("all"))
    return bound.groupBy(*form).agg(F.max("pre").alias("entries"), F.max(F.col("pre") - F.col("bound")).alias("excess"), (F.every(F.col("pre") <= F.col("bound")) & (F.max("pre") == F.max("all"))).alias("feasible"))


# ---------------------------------------------------------------- generating
def _cells(spark, cells: int | DataFrame) -> DataFrame:
    """Cells 0, 1, ... of a number, or those of a table (cell)."""
    return spark.range(cells).select(F.col("id").alias("cell")) if isinstance(cells, int) else cells.select("cell").distinct()


def _drawn(cells: DataFrame, dims: Column, n: int, tag: str, seed: int) -> DataFrame:
    """(dim, cell, w): the first ``n`` of an array of dims in order of their digests with the cell, made inside the cell's row."""
    order = F.array_sort(F.transform(dims, lambda d: F.struct(rng.digest(tag, seed, d, "cell").alias("h"), d.alias("d"))))
    return cells.select("cell", F.explode(F.slice(order, 1, n)).alias("x")).select(F.col("x.d").alias("dim"), "cell", F.lit(1).cast("bigint").alias("w"))


def uniform(spark, dims: int, cells: int | DataFrame, inputs_: int, seed: int, tag: str = "w") -> DataFrame:
    """Every cell draws the same number of different dims; a map over the cells."""
    if not 1 <= inputs_ <= dims:
        raise ValueError("inputs out of range")
    return _drawn(_cells(spark, cells), F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint")), inputs_, tag, seed)


def fly(spark, dims: int, cells: int | DataFrame, seed: int, share: float = 0.1) -> DataFrame:
    """A tenth of the dims (at least one) for each cell."""
    return uniform(spark, dims, cells, max(1, round(share * dims)), seed)


def degenerate(spark, dims: int, cells: int | DataFrame, inputs_: int, pool: int, seed: int) -> DataFrame:
    """All cells draw from one small pool of dims."""
    d = rng.pick(spark.range(dims).withColumnRenamed("id", "dim"), pool, "pool", seed, "dim").agg(F.collect_list("dim").alias("pool"))
    return _drawn(_cells(spark, cells).crossJoin(F.broadcast(d)), F.col("pool"), min(inputs_, pool), "deg", seed)  # one row


def shuffle_inputs(wiring: DataFrame, dims: int, seed: int) -> DataFrame:
    """Keeps each cell's number of inputs and redraws which dims they are; weights go to the new inputs in order of rank."""
    n = wiring.groupBy("cell").agg(F.count("*").alias("n"))
    grid = n.withColumn("dim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint"))))
    order = Window.partitionBy("cell").orderBy(rng.digest("shuf", seed, "dim", "cell"), "dim")
    new = grid.withColumn("r", F.row_number().over(order)).filter("r <= n").select("cell", "dim", "r")
    old = wiring.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("dim"))).select("cell", "r", "w")
    return new.join(old, ["cell", "r"]).select("dim", "cell", F.col("w").cast("bigint").alias("w"))


def even_split(spark, total: int, n: int, seed: int) -> DataFrame:
    """``total`` split evenly over n parts; the remainder goes to parts in order of digest."""
    one = spark.range(1).select(F.lit(total).cast("bigint").alias("total"))
    return even_splits(one, n, [], seed)


def even_splits(totals: DataFrame, n: int, by: list[str], seed: int) -> DataFrame:
    """(*by, part, share): every row's ``total`` split evenly over n parts, the remainder to parts in one order of digests. The
    parts of a row are made in the row."""
    order = F.array_sort(F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")), lambda p: F.struct(rng.digest("even", seed, p).alias("h"), p.alias("p"))))
    parts = totals.select(*by, "total", F.posexplode(order).alias("place", "x"))
    share = F.floor(F.col("total") / n).cast("bigint") + F.when(F.col("place") < F.col("total") % n, 1).otherwise(0)
    return parts.select(*by, F.col("x.p").alias("part"), share.cast("bigint").alias("share"))
