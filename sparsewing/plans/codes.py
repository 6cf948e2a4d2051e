"""Queries over codes: drives, winners under each tie rule, and the encoder family."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsewing.catalog import query
from sparsewing.functions import numbers, rng, vectors
from sparsewing.operators import encode as e, wiring as w
from sparsewing.plans.sql import K, M, S, sql
from sparsewing.sources import tables


def centred(spark, d):
    return tables.items(spark, d).withColumn("q", vectors.centre(F.col("q")))


def driven(spark, d, cells: int = M, seed: int = 7, only=None):
    """Drives of all items, or of those in ``only``."""
    x = centred(spark, d)
    return e.drive(x if only is None else x.join(F.broadcast(only), "item_id", "left_semi"), w.uniform(spark, 64, cells, S, seed), cells * S)


def coded(spark, d, only=None):
    """Codes of all items, or of those in ``only``."""
    x = centred(spark, d)
    return e.encode(x if only is None else x.join(F.broadcast(only), "item_id", "left_semi"), w.uniform(spark, 64, M, S, 7), M * S, K)


def train(spark, d):
    return rng.pick(tables.items(spark, d), 200, "train", 4, "item_id").select("item_id")


def cells(code):
    return e.as_sets(code).select("item_id", F.array_join("cells", ",").alias("cells"))


_CELLS = "SELECT item_id, string_agg(cell, ',' ORDER BY cell) AS cells FROM ({}) GROUP BY item_id"


@query(sql("drive", "SELECT item_id, cell, y FROM drive"))
def drive(spark, d):
    return driven(spark, d)


@query(sql("code", "SELECT item_id, cell, rnk, y FROM code"))
def wta_priority(spark, d):
    return coded(spark, d).select("item_id", "cell", "rnk", "y")


@query(sql("drive", f"SELECT item_id, cell, rnk, y FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY y DESC, md5('prio:1:' || cell) DESC, cell) AS rnk FROM drive) WHERE rnk <= {K}"))
def wta_reverse_priority(spark, d):
    return e.winners(driven(spark, d), K, "reverse").select("item_id", "cell", "rnk", "y")


def coarse(y):
    """Drives in steps of 10**7, so that ties abound."""
    return y.withColumn("y", F.floor(F.col("y") / 10_000_000).cast("bigint"))


_COARSE = "(SELECT item_id, cell, CAST(floor(y / 10000000.0) AS BIGINT) AS y FROM drive)"


@query(sql("drive", f"SELECT item_id, cell, rnk, y FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY y DESC, cell) AS rnk FROM {_COARSE}) WHERE rnk <= {K}"))
def wta_index(spark, d):
    return e.winners(coarse(driven(spark, d)), K, "index").select("item_id", "cell", "rnk", "y")


@query(sql("drive", f"SELECT item_id, cell, rnk, y FROM (SELECT *, rank() OVER (PARTITION BY item_id ORDER BY y DESC) AS rnk FROM {_COARSE}) WHERE rnk <= {K}"))
def wta_include(spark, d):
    return e.winners(coarse(driven(spark, d)), K, "include").select("item_id", "cell", "rnk", "y")


@query(sql("code", f"SELECT k, item_id, count(*) AS n, CAST(sum(cell) AS BIGINT) AS cells FROM code, (VALUES (4), (8), ({K})) v(k) WHERE rnk <= k GROUP BY ALL"))
def wta_multi_k(spark, d):
    """Winner sets are nested in k: ranked once, cut for each k."""
    x = coded(spark, d).withColumn("k", F.explode(F.array(F.lit(4), F.lit(8), F.lit(K)))).filter("rnk <= k")
    return x.groupBy("k", "item_id").agg(F.count("*").alias("n"), F.sum("cell").alias("cells"))


@query(sql("code", _CELLS.format("SELECT * FROM code")))
def winner_sets(spark, d):
    return cells(coded(spark, d))


_GAUSS = "(SELECT bit, dim, CAST(sum(CAST('0x' || substr(md5('g:2:' || dim || ':' || bit || ':' || (i // 4)), 1 + 4 * (i % 4), 4) AS BIGINT)) - 393210 AS BIGINT) AS w FROM range(64) a(bit), range(64) b(dim), range(12) c(i) GROUP BY bit, dim)"


def gaussian_wiring(spark, bits: int, dims: int = 64):
    """Dense whole-number projections, close to normal."""
    g = spark.range(bits).withColumnRenamed("id", "cell").withColumn("dim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint"))))
    return g.withColumn("w", rng.gaussian("g", 2, "dim", "cell"))


@query(sql("cent", f"SELECT item_id, bit, CASE WHEN sum(v * w) > 0 THEN 1 ELSE 0 END AS b FROM cent JOIN {_GAUSS} USING (dim) GROUP BY ALL"))
def sign_code(spark, d):
    y = e.drive(centred(spark, d), gaussian_wiring(spark, 64), 64 * 64)
    return y.select("item_id", F.col("cell").alias("bit"), F.when(F.col("y") > 0, 1).otherwise(0).alias("b"))


@query(sql("cent", f"SELECT item_id, string_agg(bit, ',' ORDER BY bit) AS cells FROM (SELECT item_id, bit, row_number() OVER (PARTITION BY item_id ORDER BY y DESC, md5('prio:1:' || bit), bit) AS r FROM (SELECT item_id, bit, sum(v * w) AS y FROM cent JOIN {_GAUSS} USING (dim) GROUP BY ALL)) WHERE r <= 8 GROUP BY item_id"))
def gaussian_wta(spark, d):
    y = e.drive(centred(spark, d), gaussian_wiring(spark, 64), 64 * 64)
    return cells(e.winners(y, 8))


@query(sql("cent", f"SELECT item_id, bit AS cell, CAST(sum(v * w) AS BIGINT) AS y FROM cent JOIN {_GAUSS} USING (dim) WHERE bit < 16 GROUP BY ALL"))
def gaussian_real(spark, d):
    return e.drive(centred(spark, d), gaussian_wiring(spark, 16), 16 * 64).select("item_id", "cell", "y")


@query(sql("drive", "SELECT item_id, cell, CASE WHEN y >= 0 THEN CAST(1 AS BIGINT) ELSE 0 END AS bit FROM drive"))
def densefly(spark, d):
    return e.signs(driven(spark, d)).select("item_id", "cell", "bit")


@query(sql("code", f"SELECT item_id, cell, CAST({K} + 1 - rnk AS BIGINT) AS val FROM code"))
def rank_code(spark, d):
    return e.rank_values(coded(spark, d), K).select("item_id", "cell", "val")


_Z = "(SELECT item_id, cell, CAST(CASE WHEN sd > 0 THEN floor((y - mean) / sd * 1000 + 0.5) ELSE 0 END AS BIGINT) AS y FROM drive JOIN (SELECT cell, avg(y) AS mean, stddev_pop(y) AS sd FROM drive JOIN train USING (item_id) GROUP BY cell) USING (cell))"


@query(sql("drive train", f"SELECT cell, round(avg(y), 3) AS mean, round(stddev_pop(y), 3) AS sd FROM drive JOIN train USING (item_id) GROUP BY cell"))
def cell_stats(spark, d):
    return e.cell_stats(driven(spark, d), train(spark, d)).select("cell", F.round("mean", 3).alias("mean"), F.round("sd", 3).alias("sd"))


@query(sql("drive train", f"SELECT item_id, cell, rnk FROM (SELECT item_id, cell, row_number() OVER (PARTITION BY item_id ORDER BY y DESC, md5('prio:1:' || cell), cell) AS rnk FROM {_Z}) WHERE rnk <= {K}"))
def zscore_code(spark, d):
    y = driven(spark, d)
    return e.winners(e.standardise(y, e.cell_stats(y, train(spark, d))), K).select("item_id", "cell", "rnk")


_CAL = "(SELECT item_id, cell, CAST(sum(CASE WHEN t THEN 1 ELSE 0 END) OVER (PARTITION BY cell ORDER BY y RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS y FROM (SELECT d.*, tr.item_id IS NOT NULL AS t FROM drive d LEFT JOIN train tr ON tr.item_id = d.item_id))"


@query(sql("drive train", f"SELECT item_id, cell, rnk, y FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY y DESC, md5('prio:1:' || cell), cell) AS rnk FROM {_CAL}) WHERE rnk <= {K}"))
def calibrated_code(spark, d):
    return e.winners(e.calibrate(driven(spark, d), train(spark, d)), K).select("item_id", "cell", "rnk", "y")


_ROWZ = "(SELECT item_id, cell, CAST(CASE WHEN stddev_pop(y) OVER w > 0 THEN floor((y - avg(y) OVER w) / stddev_pop(y) OVER w * 1000 + 0.5) ELSE 0 END AS BIGINT) AS y FROM drive WINDOW w AS (PARTITION BY item_id))"


def _adaptive_sql(src: str) -> str:
    return sql("drive train", f"SELECT item_id, count(*) AS n, CAST(sum(cell) AS BIGINT) AS cells FROM {src} z, (SELECT quantile_cont(CAST(y AS DOUBLE), {1 - K / M!r}) AS cut FROM {src} JOIN train USING (item_id)) WHERE y > cut GROUP BY item_id")


def _sizes(code):
    return code.groupBy("item_id").agg(F.count("*").alias("n"), F.sum("cell").alias("cells"))


@query(_adaptive_sql(_ROWZ))
def adaptive_relative(spark, d):
    return _sizes(e.adaptive(e.row_z(driven(spark, d)), train(spark, d), M, K))


@query(_adaptive_sql("(SELECT * FROM drive)"))
def adaptive_external(spark, d):
    return _sizes(e.adaptive(driven(spark, d), train(spark, d), M, K))


@query(
    sql(
        "items train",
        "SELECT item_id, CAST(round_even(CASE WHEN hi > lo THEN (least(greatest(l, lo), hi) - lo) / (hi - lo) ELSE 0 END * 255, 0) AS BIGINT) AS tag FROM (SELECT item_id, ln(1 + sqrt(CAST(list_sum(list_transform(list_transform(q, lambda v: v + 100000 * (item_id % 7)), lambda v: v * v)) AS DOUBLE)) / 1000) AS l FROM items), (SELECT quantile_cont(l, 0.01) AS lo, quantile_cont(l, 0.99) AS hi FROM (SELECT item_id, ln(1 + sqrt(CAST(list_sum(list_transform(list_transform(q, lambda v: v + 100000 * (item_id % 7)), lambda v: v * v)) AS DOUBLE)) / 1000) AS l FROM items) JOIN train USING (item_id))",
    )
)
def scale_tag(spark, d):
    """Norms of the table are all 1, so items are moved by id first."""
    x = tables.items(spark, d).withColumn("q", F.transform("q", lambda v: v + 100000 * (F.col("item_id") % 7)))
    return e.scale_tag(x, train(spark, d))


_TWO = f"(SELECT item_id, cell, y, cell % 2 AS t FROM drive)"


@query(sql("drive", _CELLS.format(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY y DESC, md5('prio:1:' || cell), cell) AS rnk FROM {_TWO}) WHERE rnk <= {K}")))
def two_global(spark, d):
    """Two half tables (even and odd cells), one competition."""
    return cells(e.winners(driven(spark, d), K))


@query(sql("drive", _CELLS.format(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, t ORDER BY y DESC, md5('prio:1:' || cell), cell) AS rnk FROM {_TWO}) WHERE rnk <= {K // 2}")))
def two_concat(spark, d):
    """Half of the winners from each table."""
    return cells(e.winners(driven(spark, d).withColumn("t", F.col("cell") % 2), K // 2, within=["t"]))


@query(sql("drive", f"SELECT item_id, CAST(sum(CASE WHEN s >= 0 THEN pow(2, block) ELSE 0 END) AS BIGINT) AS bin FROM (SELECT item_id, cell * 8 // {M} AS block, sum(y) AS s FROM drive GROUP BY ALL) GROUP BY item_id"))
def probe_bins(spark, d):
    return e.probe_bins(driven(spark, d), M, 8)


_VT = "SELECT item_id, cell, rnk, lev, CASE WHEN hi > lo THEN lo + (lev + 0.5) * ((hi - lo) / 16.0) ELSE lo END AS rec FROM (SELECT item_id, cell, rnk, lo, hi, CAST(CASE WHEN hi > lo THEN least(floor((y - lo) / ((hi - lo) / 16.0)), 15) ELSE 0 END AS BIGINT) AS lev FROM code, (SELECT min(y) AS lo, max(y) AS hi FROM code))"


@query(sql("code", f"SELECT item_id, cell, rnk, lev, round(rec, 3) AS rec FROM ({_VT})"))
def value_tag(spark, d):
    return e.value_tags(coded(spark, d), 4).select("item_id", "cell", "rnk", "lev", F.round("rec", 3).alias("rec"))


@query(sql("w50", f"SELECT cell FROM (SELECT DISTINCT cell FROM w50) ORDER BY md5('rand:12:' || cell), cell LIMIT {K}"))
def random_select(spark, d):
    """Cells of the measured wiring at random."""
    from sparsewing.plans.wirings import measured

    return e.random_cells(measured(spark, d), K, 12)


_BITS = f"CAST(ceil(list_sum(list_transform(range({K}), lambda i: log2((cells - i) / (i + 1)))) - 1e-9) AS BIGINT)"


@query(
    sql("w50", f"SELECT region, cells, entries, {_BITS} AS storage, {K} * CAST(ceil(log2(cells) - 1e-12) AS BIGINT) AS fixed, greatest(1, CAST(round_even(entries / (2 * dims), 0) AS BIGINT)) AS dense FROM (SELECT r_name AS region, count(DISTINCT cell) AS cells, count(*) AS entries, count(DISTINCT dim) AS dims FROM w50 JOIN nation ON n_nationkey = dim JOIN region ON n_regionkey = r_regionkey GROUP BY r_name) WHERE cells >= {K}")
)
def budgets(spark, d):
    """Bits of a code of the measured wiring of each region, all choices numbered or each cell by its own number, and the dense
    projections that cost as much as the wiring."""
    from sparsewing.plans.wirings import measured

    n, r = tables.table(spark, d, "nation"), tables.table(spark, d, "region")
    region = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("bigint").alias("dim"), F.col("r_name").alias("region"))
    g = measured(spark, d).join(F.broadcast(region), "dim").groupBy("region").agg(F.count_distinct("cell").alias("cells"), F.count("*").alias("entries"), F.count_distinct("dim").alias("dims")).filter(F.col("cells") >= K)
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(K - 1)), F.lit(0.0), lambda a, i: a + F.log2((F.col("cells") - i) / (i + 1)))
    fixed = K * F.ceil(F.log2("cells") - 1e-12)
    return g.select("region", "cells", "entries", F.ceil(steps - 1e-9).cast("bigint").alias("storage"), fixed.cast("bigint").alias("fixed"), F.greatest(F.lit(1), F.bround(F.col("entries") / (2 * F.col("dims")))).cast("bigint").alias("dense"))


@query()
def pca(spark, d):
    """Scores on four components fitted on the training items."""
    from sparsewing.operators import learn

    it = tables.items(spark, d)
    mean, comp, _ = learn.pca(it, train(spark, d), 64, 4)
    z = learn.project(it, mean, comp)
    return z.select("item_id", F.transform("z", lambda v: F.round(v / 1e6, 5)).alias("z"))


@query()
def pq_codes(spark, d):
    from sparsewing.operators import learn

    it = tables.items(spark, d)
    tr = it.join(train(spark, d), "item_id", "left_semi")
    return learn.pq_encode(it, learn.pq_fit(tr, numbers.pq_layout(32, 64, 4), 64, 1))


@query()
def biohash(spark, d):
    """Winners of units learned on the training items."""
    import numpy as np

    from sparsewing.operators import learn

    it = tables.items(spark, d)
    x = np.array([r.q for r in it.join(train(spark, d), "item_id", "left_semi").orderBy("item_id").limit(learn.SAMPLE).select("q").collect()], dtype=float) / 1e6
    unit = learn.Competition(8).fit(x, learn.random_units(128, 64, 1), 10, 0.05)
    wiring = spark.createDataFrame([(j, i, int(round(v * 1000))) for i, row in enumerate(unit) for j, v in enumerate(row.tolist())], "dim long, cell long, w long")
    return cells(e.winners(e.drive(it, wiring, 128 * 64), 8))

