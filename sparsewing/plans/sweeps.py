"""Composite analyses: sweeps of wirings, sizes and encoders, scored on the same queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsewing.catalog import query
from sparsewing.operators import blocks, generators, packed, wiring as w
from sparsewing.operators.graph import reliable, shared_folder
from sparsewing.plans import runs
from sparsewing.plans.codes import centred
from sparsewing.plans.retrieval import queries, truth
from sparsewing.plans.sql import K, QUERIES, S, TOP, sql
from sparsewing.plans.wirings import measured
from sparsewing.sources import tables


def _code_sql(m: int, k: int, s: int, seed: int) -> str:
    wir = f"SELECT dim, cell FROM (SELECT cell, dim, row_number() OVER (PARTITION BY cell ORDER BY md5('w:{seed}:' || dim || ':' || cell), dim) AS r FROM range({m}) a(cell), range(64) b(dim)) WHERE r <= {s}"
    dr = f"SELECT item_id, cell, sum(v) AS y FROM cent JOIN ({wir}) USING (dim) GROUP BY item_id, cell"
    return f"SELECT item_id, cell FROM (SELECT item_id, cell, row_number() OVER (PARTITION BY item_id ORDER BY y DESC, md5('prio:1:' || cell), cell) AS rnk FROM ({dr})) WHERE rnk <= {k}"


def _ap_sql(code: str, k: int) -> str:
    ham = f"SELECT query_id, i.item_id, {2 * k} - 2 * coalesce(b, 0) AS d FROM queries JOIN items i ON i.item_id <> query_id LEFT JOIN (SELECT query_id, c.item_id, count(*) AS b FROM queries JOIN ({code}) q ON q.item_id = query_id JOIN ({code}) c ON c.cell = q.cell AND c.item_id <> query_id GROUP BY ALL) s USING (query_id, item_id)"
    pred = f"SELECT * FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY d, md5('tie:5:' || query_id || ':' || item_id), item_id) AS rnk FROM ({ham})) WHERE rnk <= {TOP}"
    return f"SELECT round(sum(p) / {TOP * QUERIES}, 6) AS mean_ap FROM (SELECT CASE WHEN hit = 1 THEN sum(hit) OVER (PARTITION BY query_id ORDER BY rnk ROWS UNBOUNDED PRECEDING) / rnk ELSE 0.0 END AS p FROM (SELECT p.query_id, p.rnk, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS hit FROM ({pred}) p LEFT JOIN true t ON t.query_id = p.query_id AND t.item_id = p.item_id))"


_SEEDS, _SIZES = (21, 22), ((160, 8), (320, 16))


def _mean_aps(spark, d, codes):
    """Mean average precision of each of the named codes."""
    ranked = blocks.rankings(tables.items(spark, d), queries(spark, d), [blocks.Exact("truth"), *codes.values()], TOP)
    return blocks.scores(ranked, "truth", TOP).groupBy("arm").agg(F.round(F.sum("ap") / QUERIES, 6).alias("mean_ap"))


@query(sql("cent items queries true", " UNION ALL ".join(f"SELECT CAST({m} AS BIGINT) AS m, CAST({k} AS BIGINT) AS k, CAST({s} AS BIGINT) AS seed, mean_ap FROM ({_ap_sql(_code_sql(m, k, S, s), k)})" for m, k in _SIZES for s in _SEEDS)))
def architecture(spark, d):
    """Mean average precision for code sizes and wiring seeds; the queries, the truth and the ties are the same for all, and so is
    the one scan of the items."""
    codes = {f"{m}-{k}-{seed}": blocks.Coded(f"{m}-{k}-{seed}", blocks.stack(w.uniform(spark, 64, m, S, seed), 64), (k,)) for m, k in _SIZES for seed in _SEEDS}
    part = lambda i: F.split_part("arm", F.lit("-"), F.lit(i)).cast("bigint")
    return _mean_aps(spark, d, codes).select(part(1).alias("m"), part(2).alias("k"), part(3).alias("seed"), "mean_ap")


@query(sql("cent items queries true", " UNION ALL ".join(f"SELECT CAST({s} AS BIGINT) AS s, mean_ap FROM ({_ap_sql(_code_sql(320, K, s, 21), K)})" for s in (1, 6, 32))))
def fan_in_sweep(spark, d):
    """Inputs per cell from one to half of the dimensions."""
    codes = {str(s): blocks.Coded(str(s), blocks.stack(w.uniform(spark, 64, 320, s, 21), 64), (K,)) for s in (1, 6, 32)}
    return _mean_aps(spark, d, codes).select(F.col("arm").cast("bigint").alias("s"), "mean_ap")


_MARKS = [1, 2, 5, 10]


def _walk(spark, d):
    """The chains of the whole measured wiring, kept by what they are made from, so a later call reads them."""
    x = reliable(measured(spark, d).select("dim", "cell", "w"))
    key = runs.fingerprint(x, "chains 3", 3, _MARKS)
    return x, runs.kept(spark, f"{shared_folder(spark)}/chains", key, lambda: generators.chains(x, 3, _MARKS))


@query()
def convergence(spark, d):
    """Overlap of random wirings with the start after more and more sweeps of one chain each."""
    x, walk = _walk(spark, d)
    path = generators.path_rows(walk, 3, _MARKS)
    j = path.join(x.select("dim", "cell", F.lit(1).alias("same")), ["dim", "cell"], "left").groupBy("draw", "mark").agg(F.count("same").alias("kept"), F.count("*").alias("n"))
    return j.select(F.col("mark").cast("int").alias("sweeps"), "draw", F.round(F.col("kept") / (2 * F.col("n") - F.col("kept")), 9).alias("jaccard"))


@query(sql("w50", f"SELECT draw, CAST(m AS BIGINT) AS mark, side, id, n FROM (SELECT 'dim' AS side, dim AS id, count(*) AS n FROM w50 GROUP BY dim UNION ALL SELECT 'cell', cell, count(*) FROM w50 GROUP BY cell), range(3) t(draw), (SELECT unnest({_MARKS}) AS m)"))
def convergence_margins(spark, d):
    """No mark of a chain leaves the margins."""
    path = generators.path_rows(_walk(spark, d)[1], 3, _MARKS)
    side = lambda c: path.groupBy("draw", "mark", F.lit(c).alias("side"), F.col(c).alias("id")).agg(F.count("*").alias("n"))
    return side("dim").unionByName(side("cell"))


@query()
def convergence_pool(spark, d):
    """The co-occurrence statistic along the chains, against a pool of wirings mixed for longer: mean, deviation and z."""
    x, walk = _walk(spark, d)
    q = lambda t: t.groupBy("draw", "mark").agg(F.sum(F.col("n") * F.col("n")).alias("q"))
    pool = generators.path_overlaps(_pool(spark, x, 10), 10, [20])
    base = q(pool).agg(F.avg("q").alias("pool_mean"), F.stddev_samp("q").alias("pool_sd"))
    z = F.when(F.col("pool_sd") > 0, (F.col("q") - F.col("pool_mean")) / F.col("pool_sd"))
    path = q(generators.path_overlaps(walk, 3, _MARKS))
    return path.crossJoin(F.broadcast(base)).select("draw", "mark", "q", F.round("pool_mean", 6).alias("pool_mean"), F.round("pool_sd", 6).alias("pool_sd"), F.round(z, 6).alias("z"))  # one row


def _pool(spark, wiring, draws: int, sweeps: int = 20, seed: int = 1):
    """Random wirings with the margins of ``wiring`` as chains, kept by what they are made from."""
    x = wiring.select("dim", "cell", F.col("w").cast("long").alias("w"))
    key = runs.fingerprint(x, "chains 3", draws, sweeps, seed)
    return runs.kept(spark, f"{shared_folder(spark)}/nulls", key, lambda: generators.chains(x, draws, [sweeps], seed))


def pool_parts(spark, wiring, draws: int, dims: int, first: int, sweeps: int = 20, seed: int = 1):
    """A pool of random wirings with the margins of ``wiring`` in parts (``packed``), draw i as source ``first`` + i; their entries,
    which count 1, are never rows."""
    state = _pool(spark, wiring, draws, sweeps, seed)
    return packed.packed_chains(state, draws, generators.dims_of(state), dims, first)


_D, _M, _K = 64, 256, 8


def _suite(spark, d, methods):
    from sparsewing.operators import suite
    from sparsewing.plans.codes import train

    it = tables.items(spark, d)
    code = suite.codes(centred(spark, d), it, train(spark, d), methods, _D, _M, S, _K)
    return suite.mean_scores(suite.rank_all(code, it, queries(spark, d), TOP, _M // 2, methods), truth(spark, d), QUERIES, TOP)


def _resources_sql() -> str:
    ops, bits = 1536, 64
    even = ["fly", "balanced", "diverse", "calibrated", "zscore", "balanced_calibrated", "diverse_calibrated", "rank", "two_global", "two_concat", "two_or"]
    rows = [(m, ops, bits, False) for m in even] + [("scale_tag", ops, 72, False), ("adaptive_relative", ops, 256, True), ("adaptive_external", ops, 256, True), ("densefly", ops, 256, False), ("densefly_probe", ops, 272, False), ("sparse_bio", 3072, 64, False), ("sparse_untrained", 3072, 64, False), ("biohash", 32768, 64, False), ("biohash_untrained", 32768, 64, False), ("gaussian_real", 1024, 256, False), ("gaussian_sign", 1024, 8, False), ("gaussian_ops", 1536, 384, False), ("gaussian_storage", 8192, 64, False)]
    return "SELECT t.*, bits * n AS table_bits FROM (SELECT count(*) AS n FROM embeddings), (VALUES " + ", ".join(f"('{m}', CAST({o} AS BIGINT), CAST({b} AS BIGINT), {str(v).lower()})" for m, o, b, v in rows) + ") t(method, operations, bits, variable)"


@query(_resources_sql())
def suite_resources(spark, d):
    """Projection operations and code bits of every method at 64 dimensions, 256 cells, 6 inputs and 8 winners, and the bits that
    the codes of all items take."""
    from sparsewing.operators import suite

    rows = [tuple(suite.resources(m, _D, _M, S, _K).values()) for m in suite.METHODS]
    n = tables.items(spark, d).agg(F.count("*").alias("n"))
    cost = spark.createDataFrame(rows, "method string, operations long, bits long, variable boolean")
    return cost.crossJoin(F.broadcast(n)).select(*cost.columns, (F.col("bits") * F.col("n")).alias("table_bits"))  # one row


@query(sql("cent items queries true", f"SELECT 'fly' AS method, mean_ap FROM ({_ap_sql(_code_sql(_M, _K, S, 7), _K)})".replace("md5('tie:5:' || query_id || ':' || item_id)", "md5('tie:5:' || item_id)")))
def suite_fly(spark, d):
    """The plain method of the suite, restated in SQL."""
    return _suite(spark, d, ["fly"]).select("method", "mean_ap")


@query()
def encoder_suite(spark, d):
    """Mean average precision and recall of all methods of the encoder family on the same queries, in one scan."""
    from sparsewing.operators import suite

    return _suite(spark, d, list(suite.METHODS))


#: Which method shows what a change to which other one does.
ABLATIONS = (
    ("balanced", "fly"), ("diverse", "balanced"), ("calibrated", "fly"), ("zscore", "fly"), ("balanced_calibrated", "balanced"),
    ("diverse_calibrated", "diverse"), ("rank", "balanced"), ("adaptive_relative", "balanced"), ("adaptive_external", "balanced"),
    ("scale_tag", "balanced"), ("two_concat", "two_global"), ("two_or", "two_concat"), ("densefly", "fly"), ("densefly_probe", "densefly"),
    ("biohash", "biohash_untrained"), ("sparse_bio", "sparse_untrained"),
)


@query()
def encoder_ablations(spark, d):
    """What each method gains over the one that it changes: mean difference of average precision over the queries, with the
    interval of the paired t at 95 per cent."""
    from sparsewing.operators import inference, suite
    from sparsewing.plans.codes import train

    it = tables.items(spark, d)
    names = sorted({m for pair in ABLATIONS for m in pair})
    code = suite.codes(centred(spark, d), it, train(spark, d), names, _D, _M, S, _K)
    per = suite.query_scores(suite.rank_all(code, it, queries(spark, d), TOP, _M // 2, names), truth(spark, d), TOP)
    pairs = spark.createDataFrame(list(ABLATIONS), "treatment string, control string")
    a = per.select(F.col("method").alias("treatment"), "query_id", F.col("ap").alias("a"))
    b = per.select(F.col("method").alias("control"), "query_id", F.col("ap").alias("b"))
    diffs = a.join(F.broadcast(pairs), "treatment").join(b, ["control", "query_id"]).select("treatment", "control", (F.col("a") - F.col("b")).alias("d"))
    return inference.paired_t(diffs, ["treatment", "control"], 2.009575)  # 49 degrees of freedom
