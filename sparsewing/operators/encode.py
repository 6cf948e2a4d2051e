"""Encoders: drives (item x wiring), winners under explicit tie rules, and the codes built from them.

A code is the long table (item_id, cell, rnk, y): winners of an item in order. The wiring does not grow with the items; below
a checked size it is sent to every task and encoding is a map over the items, above it the drive is a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparsewing.functions import rng, vectors

BROADCAST_ROWS = 200_000


def one_row(wiring: DataFrame, seed: int = 1) -> DataFrame:
    """The wiring as one row: an array of (cell, rank of its priority, inputs), to be sent to every task."""
    w = wiring.groupBy("cell").agg(F.collect_list(F.struct(F.col("dim").cast("int").alias("dim"), F.col("w").cast("bigint").alias("w"))).alias("inputs"))
    order = F.array_sort(F.collect_list(F.struct(priority(seed).alias("p"), "cell", "inputs")))
    ranked = w.agg(order.alias("c")).select(F.transform("c", lambda x, i: F.struct(x["cell"].alias("cell"), i.alias("prio"), x["inputs"].alias("inputs"))).alias("cells"))
    return F.broadcast(ranked)


def _sums(col: str):
    """Array of (cell, prio, y) of a row that holds ``col`` and the wiring's cells."""
    return F.transform("cells", lambda c: F.struct(c["cell"].alias("cell"), c["prio"].alias("prio"), F.aggregate(c["inputs"], F.lit(0).cast("bigint"), lambda a, i: a + F.coalesce(F.get(F.col(col), i["dim"]), F.lit(0).cast("bigint")) * i["w"]).alias("y")))


def drive(items: DataFrame, wiring: DataFrame, wiring_rows: int, col: str = "q") -> DataFrame:
    """(item_id, cell, y): sums of the item's values over each cell's inputs, as whole numbers. A wiring of up to
    BROADCAST_ROWS entries goes to every task as a matrix and the drives are products of it with a batch of items, without a
    shuffle; a larger one is joined on the dimension. Missing values count 0."""
    if wiring_rows <= BROADCAST_ROWS:
        from sparsewing.operators import blocks

        return blocks.drives(items, blocks.stack(wiring), col)
    x = items.select("item_id", F.posexplode(col).alias("dim", "v")).withColumn("dim", F.col("dim").cast("bigint"))
    return x.join(wiring.select("dim", "cell", "w"), "dim").groupBy("item_id", "cell").agg(F.sum(F.col("v") * F.col("w")).alias("y"))


def encode(items: DataFrame, wiring: DataFrame, wiring_rows: int, k: int, seed: int = 1, col: str = "q") -> DataFrame:
    """(item_id, cell, rnk, y): drives and their ``k`` winners (ties by priority) in one pass over the items: a map, so a
    code costs no shuffle at any number of items."""
    if wiring_rows > BROADCAST_ROWS:
        return winners(drive(items, wiring, wiring_rows, col), k, "random", seed).select("item_id", "cell", "rnk", "y")
    from sparsewing.operators import blocks

    return blocks.codes(items, blocks.stack(wiring, seed=seed), k, col)


def priority(seed: int) -> Column:
    return rng.digest("prio", seed, "cell")


def winners(y: DataFrame, k: int, tie: str = "random", seed: int = 1, within: list[str] | None = None) -> DataFrame:
    """The ``k`` largest drives of each item. Ties: ``random`` (by digest, lowest first), ``reverse`` (highest digest first),
    ``index`` (lowest cell first), ``include`` (all cells at or above the k-th value)."""
    part = ["item_id", *(within or [])]
    order = {"random": [F.col("y").desc(), priority(seed), F.col("cell")], "reverse": [F.col("y").desc(), priority(seed).desc(), F.col("cell")], "index": [F.col("y").desc(), F.col("cell")], "include": [F.col("y").desc()]}[tie]
    rank = F.rank() if tie == "include" else F.row_number()
    return y.withColumn("rnk", rank.over(Window.partitionBy(*part).orderBy(*order)).cast("bigint")).filter(F.col("rnk") <= k)


def as_sets(code: DataFrame) -> DataFrame:
    return code.groupBy("item_id").agg(F.array_sort(F.collect_list("cell")).alias("cells"))


def rank_values(code: DataFrame, k: int) -> DataFrame:
    return code.withColumn("val", (F.lit(k + 1) - F.col("rnk")).cast("bigint"))


def signs(y: DataFrame) -> DataFrame:
    """Dense sign code: one bit a cell."""
    return y.withColumn("bit", (F.col("y") >= 0).cast("bigint"))


def cell_stats(y: DataFrame, train: DataFrame) -> DataFrame:
    """Mean and population deviation of each cell over the training items."""
    t = y.join(train.select("item_id"), "item_id", "left_semi")
    return t.groupBy("cell").agg(F.avg("y").alias("mean"), F.stddev_pop("y").alias("sd"))


def standardise(y: DataFrame, stats: DataFrame) -> DataFrame:
    """(y - mean) / sd in thousandths, 0 where the deviation is 0."""
    z = F.when(F.col("sd") > 0, F.floor((F.col("y") - F.col("mean")) / F.col("sd") * 1000 + 0.5)).otherwise(0)
    return y.join(stats, "cell").select("item_id", "cell", z.cast("bigint").alias("y"))


def calibrate(y: DataFrame, train: DataFrame) -> DataFrame:
    """Share of training drives of the cell at or below the drive, as a count. One sort per cell over the training items."""
    t = y.join(train.select("item_id", F.lit(1).alias("t")), "item_id", "left")
    n = F.sum(F.coalesce("t", F.lit(0))).over(Window.partitionBy("cell").orderBy("y").rangeBetween(Window.unboundedPreceding, 0))
    return t.select("item_id", "cell", n.cast("bigint").alias("y"))


def row_z(y: DataFrame) -> DataFrame:
    """Drives standardised within each item, in thousandths."""
    w = Window.partitionBy("item_id")
    sd = F.stddev_pop("y").over(w)
    return y.select("item_id", "cell", F.when(sd > 0, F.floor((F.col("y") - F.avg("y").over(w)) / sd * 1000 + 0.5)).otherwise(0).cast("bigint").alias("y"))


def adaptive(y: DataFrame, train: DataFrame, m: int, k: int) -> DataFrame:
    """Variable-length code: cells above the training quantile at 1 - k/m."""
    t = y.join(train.select("item_id"), "item_id", "left_semi").agg(F.expr(f"percentile(y, {1 - k / m!r})").alias("cut"))
    return y.crossJoin(F.broadcast(t)).filter("y > cut").select("item_id", "cell", "y")  # one row


def scale_tag(items: DataFrame, train: DataFrame, col: str = "q") -> DataFrame:
    """Eight bits for the logarithm of the norm between the training 1st and 99th percentile."""
    v = items.select("item_id", F.log1p(F.sqrt(vectors.norm2(F.col(col)).cast("double")) / 1000).alias("l"))
    lim = v.join(train.select("item_id"), "item_id", "left_semi").agg(F.expr("percentile(l, array(0.01, 0.99))").alias("p")).select(F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    share = F.when(F.col("hi") > F.col("lo"), (F.least(F.greatest("l", "lo"), "hi") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return v.crossJoin(F.broadcast(lim)).select("item_id", F.bround(share * 255).cast("bigint").alias("tag"))  # one row


def value_tags(code: DataFrame, bits: int) -> DataFrame:
    """Winners with a level of ``bits`` bits on the range of all winners' drives, and the middle of the level; on an empty
    range the level is 0 and the value itself is kept."""
    lim = code.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    r = code.crossJoin(F.broadcast(lim))  # one row
    step = (F.col("hi") - F.col("lo")).cast("double") / (1 << bits)
    lev = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("y") - F.col("lo")) / step), F.lit((1 << bits) - 1))).otherwise(0)
    r = r.withColumn("lev", lev.cast("bigint"))
    return r.withColumn("rec", F.when(F.col("hi") > F.col("lo"), F.col("lo") + (F.col("lev") + 0.5) * step).otherwise(F.col("lo").cast("double"))).select("item_id", "cell", "rnk", "y", "lev", "rec")


def random_cells(cells: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` of the cells of a table (cell), in order of their digests."""
    return rng.pick(cells.select("cell").distinct(), k, "rand", seed, "cell")


def probe_bins(y: DataFrame, m: int, blocks: int) -> DataFrame:
    """Pseudo-hash of each item: the signs of ``blocks`` sums over stretches of cells, as a number."""
    s = y.groupBy("item_id", F.floor(F.col("cell") * blocks / m).alias("block")).agg(F.sum("y").alias("s"))
    return s.groupBy("item_id").agg(F.sum(F.when(F.col("s") >= 0, F.pow(F.lit(2.0), F.col("block"))).otherwise(0)).cast("bigint").alias("bin"))
