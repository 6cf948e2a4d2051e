"""Composite comparisons on the same queries, each in one scan of the items.

``replication``: the published comparison of expansion codes with random projections at equal code lengths, over several trials
and against two truths. ``robustness``: the measured wiring against random ones under one changed condition at a time.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsewing.catalog import query
from sparsewing.functions import rng
from sparsewing.operators import blocks, collision, packed, verdicts, wiring as w
from sparsewing.operators.graph import reliable
from sparsewing.plans import sweeps
from sparsewing.plans.primary import DIMS, cut_items, shuffled_arms
from sparsewing.plans.retrieval import queries
from sparsewing.plans.sql import QUERIES, TOP, sql
from sparsewing.plans.wirings import measured
from sparsewing.sources import tables

D, LENGTHS, TRIALS, SAMPLED = 64, (4, 16), 2, 6
OPS = round(10 * D * SAMPLED / (2 * D))  # dense projections that cost as much as the widest expansion
DENSE, WIDE = 1_000_000_000, 1000  # steps of dense and of sparse drives


def gaussian(spark, cells: int, seed: int):
    g = spark.range(cells).withColumnRenamed("id", "cell").withColumn("dim", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(D - 1).cast("bigint"))))
    return g.withColumn("w", rng.gaussian("g", seed, "dim", "cell"))


def protocol_arms(spark) -> list:
    """The truths, and for each trial and length k: dense projections (real and signs), an expansion to 20 k cells (winners, and k
    cells at random), one to 10 d cells, and dense projections for the operations of the last."""
    arms = [blocks.Exact("raw"), blocks.Exact("centred", centre=True)]
    for t in range(TRIALS):
        g = gaussian(spark, OPS, 300 + t)
        wide = blocks.stack(w.uniform(spark, D, 10 * D, SAMPLED, 400 + t), D)
        arms.append(blocks.Projected(f"{t}-lsh_ops-{OPS}", wiring=blocks.stack(g, D), unit=DENSE))
        for k in LENGTHS:
            dense = blocks.stack(g.filter(F.col("cell") < k), D)
            narrow = w.uniform(spark, D, 20 * k, SAMPLED, 500 + 100 * t + k)
            some = rng.pick(spark.range(20 * k).withColumnRenamed("id", "cell"), k, "rand", 500 + 100 * t + k, "cell")
            arms += [
                blocks.Projected(f"{t}-lsh-{k}", wiring=dense, unit=DENSE), blocks.Signed(f"{t}-lsh_sign-{k}", dense),
                blocks.Coded(f"{t}-fly_20k-{k}", blocks.stack(narrow, D), (k,)),
                blocks.Projected(f"{t}-random_20k-{k}", wiring=blocks.stack(narrow.join(F.broadcast(some), "cell", "left_semi"), D), unit=WIDE),
                blocks.Coded(f"{t}-fly_10d-{k}", wide, (k,)),
            ]
    return arms


def _uniform_sql(cells: int, seed: str) -> str:
    return f"SELECT t, dim, cell FROM (SELECT t, cell, dim, row_number() OVER (PARTITION BY t, cell ORDER BY md5('w:' || ({seed}) || ':' || dim || ':' || cell), dim) AS r FROM range({TRIALS}) z(t), range({cells}) a(cell), range({D}) b(dim)) WHERE r <= {SAMPLED}"


def _code_sql(arm: str, drives: str, k: int, every: str = "items") -> str:
    code = f"SELECT t, item_id, cell FROM (SELECT t, item_id, cell, row_number() OVER (PARTITION BY t, item_id ORDER BY y DESC, md5('prio:1:' || cell), cell) AS r FROM {drives}) WHERE r <= {k}"
    shared = f"SELECT a.t, query_id, b.item_id, count(*) AS n FROM queries JOIN ({code}) a ON a.item_id = query_id JOIN ({code}) b ON b.t = a.t AND b.cell = a.cell AND b.item_id <> query_id GROUP BY ALL"
    return f"SELECT t || '-{arm}-{k}' AS arm, query_id, i.item_id, 2 * {k} - 2 * coalesce(n, 0) AS d, true AS mixed FROM range({TRIALS}) z(t) CROSS JOIN queries JOIN {every} i ON i.item_id <> query_id LEFT JOIN ({shared}) s USING (t, query_id, item_id)"


def _dense_sql(arm: str, drives: str, k: int, value: str, mixed: bool) -> str:
    return f"SELECT a.t || '-{arm}-{k}' AS arm, query_id, b.item_id, sum(({value.format('a')} - {value.format('b')}) * ({value.format('a')} - {value.format('b')})) AS d, {str(mixed).lower()} AS mixed FROM queries JOIN {drives} a ON a.item_id = query_id JOIN {drives} b ON b.t = a.t AND b.cell = a.cell AND b.item_id <> query_id GROUP BY a.t, query_id, b.item_id"


def _step(unit: int) -> str:
    return f"CAST(floor({{0}}.y / {float(unit)!r}) AS BIGINT)"


def _protocol_sql() -> str:
    ctes, parts = [], []
    ctes.append(f"gw AS (SELECT t, cell, dim, CAST(sum(CAST('0x' || substr(md5('g:' || (300 + t) || ':' || dim || ':' || cell || ':' || (i // 4)), 1 + 4 * (i % 4), 4) AS BIGINT)) - 393210 AS BIGINT) AS w FROM range({TRIALS}) z(t), range({OPS}) a(cell), range({D}) b(dim), range(12) c(i) GROUP BY ALL)")
    ctes.append("gy AS (SELECT t, item_id, cell, sum(v * w) AS y FROM cent JOIN gw USING (dim) GROUP BY ALL)")
    ctes.append(f"dy AS (SELECT t, item_id, cell, sum(v) AS y FROM cent JOIN ({_uniform_sql(10 * D, '400 + t')}) USING (dim) GROUP BY ALL)")
    parts.append(_dense_sql("lsh_ops", "gy", OPS, _step(DENSE), False))
    for k in LENGTHS:
        seed = f"500 + 100 * t + {k}"
        ctes.append(f"g{k} AS (SELECT * FROM gy WHERE cell < {k})")
        ctes.append(f"y{k} AS (SELECT t, item_id, cell, sum(v) AS y FROM cent JOIN ({_uniform_sql(20 * k, seed)}) USING (dim) GROUP BY ALL)")
        ctes.append(f"r{k} AS (SELECT y.* FROM y{k} y JOIN (SELECT t, cell FROM (SELECT t, cell, row_number() OVER (PARTITION BY t ORDER BY md5('rand:' || ({seed}) || ':' || cell), cell) AS r FROM range({TRIALS}) z(t), range({20 * k}) a(cell)) WHERE r <= {k}) USING (t, cell))")
        parts += [_dense_sql("lsh", f"g{k}", k, _step(DENSE), False), _dense_sql("lsh_sign", f"g{k}", k, "CAST({0}.y > 0 AS BIGINT)", True), _code_sql("fly_20k", f"y{k}", k), _dense_sql("random_20k", f"r{k}", k, _step(WIDE), False), _code_sql("fly_10d", "dy", k)]
    body = f""", {", ".join(ctes)}, far AS MATERIALIZED ({" UNION ALL ".join(parts)}),
ranked AS (SELECT arm, query_id, item_id, row_number() OVER (PARTITION BY arm, query_id ORDER BY d, CASE WHEN mixed THEN md5('tie:5:' || query_id || ':' || item_id) ELSE '' END, item_id) AS rnk FROM far QUALIFY rnk <= {TOP}),
tr AS (SELECT 'raw' AS truth, query_id, item_id FROM "true" UNION ALL SELECT 'centred', query_id, item_id FROM (SELECT query_id, b.item_id, row_number() OVER (PARTITION BY query_id ORDER BY sum((a.v - b.v) * (a.v - b.v)), b.item_id) AS r FROM queries JOIN cent a ON a.item_id = query_id JOIN cent b ON b.dim = a.dim AND b.item_id <> query_id GROUP BY query_id, b.item_id) WHERE r <= {TOP}),
ht AS (SELECT z.truth, r.arm, r.query_id, rnk, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS hit FROM ranked r CROSS JOIN (VALUES ('raw'), ('centred')) z(truth) LEFT JOIN tr t ON t.truth = z.truth AND t.query_id = r.query_id AND t.item_id = r.item_id),
av AS (SELECT truth, arm, query_id, round(sum(p) / {TOP}, 9) AS ap, round(sum(hit) / {TOP}, 9) AS recall FROM (SELECT *, CASE WHEN hit = 1 THEN sum(hit) OVER (PARTITION BY truth, arm, query_id ORDER BY rnk ROWS UNBOUNDED PRECEDING) / rnk ELSE 0.0 END AS p FROM ht) GROUP BY ALL),
mn AS (SELECT truth, arm, sum(ap) / {QUERIES} AS ap, sum(recall) / {QUERIES} AS recall FROM av GROUP BY ALL)
SELECT truth, string_split(arm, '-')[2] AS method, CAST(string_split(arm, '-')[3] AS BIGINT) AS k, count(*) AS trials, round(avg(ap), 6) AS mean_ap, round(stddev_samp(ap), 6) AS sd_ap, round(avg(recall), 6) AS mean_recall FROM mn GROUP BY ALL"""
    return sql("cent items queries true", "SELECT 1 FROM cent, items, queries, true").replace(' SELECT 1 FROM cent, items, queries, "true"', body).replace(" SELECT 1 FROM cent, items, queries, true", body)


@query(_protocol_sql())
def replication(spark, d):
    """Average precision and recall of every method and code length, mean and deviation over trials, against neighbours of the raw
    and of the centred values."""
    ranked = blocks.rankings(tables.items(spark, d), queries(spark, d), protocol_arms(spark), TOP)
    part = lambda i: F.split_part("arm", F.lit("-"), F.lit(i))
    per = blocks.scores(ranked, ("raw", "centred"), TOP).groupBy("truth", "arm").agg((F.sum("ap") / QUERIES).alias("ap"), (F.sum("recall") / QUERIES).alias("recall"))
    per = per.select("truth", part(2).alias("method"), part(3).cast("long").alias("k"), "ap", "recall")
    return per.groupBy("truth", "method", "k").agg(F.count("*").alias("trials"), F.round(F.avg("ap"), 6).alias("mean_ap"), F.round(F.stddev_samp("ap"), 6).alias("sd_ap"), F.round(F.avg("recall"), 6).alias("mean_recall"))


# ---------------------------------------------------------------- robustness
_K, _B = 16, 2
#: name: threshold, weighted, seed of the cells' priorities, region
CONDITIONS = {"baseline": (50, False, 1, None), "threshold_25": (25, False, 1, None), "threshold_100": (100, False, 1, None), "weighted": (50, True, 1, None), "tie_seed_2": (50, False, 2, None), "region": (25, False, 1, "EUROPE")}


def _robust_sql() -> str:
    cond = ", ".join(f"('{n}', {t}, {str(wt).lower()}, {p}, {repr(r) if r else 'NULL'})" for n, (t, wt, p, r) in CONDITIONS.items())
    body = f""", cond(name, threshold, weighted, prio, region) AS (VALUES {cond}),
mw AS (SELECT name, dim, cell, w FROM wall JOIN cond ON w >= threshold AND (region IS NULL OR dim IN (SELECT n_nationkey FROM nation JOIN region r ON n_regionkey = r_regionkey WHERE r_name = cond.region))),
sh AS (SELECT name, draw, cell, dim, row_number() OVER (PARTITION BY name, draw, cell ORDER BY md5('shuf:' || (100 + draw) || ':' || dim || ':' || cell), dim) AS r FROM (SELECT DISTINCT name, cell FROM mw), range({DIMS}) b(dim), range({_B}) t(draw)),
wi AS (SELECT name, -1 AS draw, dim, cell, w FROM mw UNION ALL SELECT s.name, draw, s.dim, s.cell, o.w FROM sh s JOIN (SELECT name, cell, w, row_number() OVER (PARTITION BY name, cell ORDER BY dim) AS r FROM mw) o ON o.name = s.name AND o.cell = s.cell AND o.r = s.r),
it AS (SELECT item_id, list_slice(q, 1, {DIMS}) AS q FROM items),
lg AS (SELECT item_id, unnest(range({DIMS})) AS dim, unnest(q) AS v FROM it),
ct AS (SELECT item_id, dim, {DIMS} * v - sum(v) OVER (PARTITION BY item_id) AS v FROM lg),
dr AS (SELECT name, draw, item_id, cell, sum(v * CASE WHEN weighted THEN w ELSE 1 END) AS y, any_value(prio) AS prio FROM ct JOIN wi USING (dim) JOIN cond USING (name) GROUP BY name, draw, item_id, cell),
cd AS (SELECT name, draw, item_id, cell FROM (SELECT name, draw, item_id, cell, row_number() OVER (PARTITION BY name, draw, item_id ORDER BY y DESC, md5('prio:' || prio || ':' || cell), cell) AS r FROM dr) WHERE r <= {_K}),
so AS (SELECT a.name, a.draw, query_id, b.item_id, count(*) AS n FROM queries JOIN cd a ON a.item_id = query_id JOIN cd b ON b.name = a.name AND b.draw = a.draw AND b.cell = a.cell AND b.item_id <> query_id GROUP BY ALL),
ev AS (SELECT name, draw, query_id, i.item_id FROM (SELECT DISTINCT name, draw FROM cd), queries, items i WHERE i.item_id <> query_id),
pr AS (SELECT name, draw, query_id, item_id, row_number() OVER (PARTITION BY name, draw, query_id ORDER BY -coalesce(n, 0), md5('tie:5:' || query_id || ':' || item_id), item_id) AS rnk FROM ev LEFT JOIN so USING (name, draw, query_id, item_id) QUALIFY rnk <= {TOP}),
tr AS (SELECT query_id, b.item_id FROM queries JOIN it a ON a.item_id = query_id JOIN it b ON b.item_id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY list_sum(list_transform(list_zip(a.q, b.q), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), b.item_id) <= {TOP}),
ht AS (SELECT p.*, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS hit FROM pr p LEFT JOIN tr t ON t.query_id = p.query_id AND t.item_id = p.item_id),
av AS (SELECT name, draw, query_id, round(sum(p) / {TOP}, 9) AS v FROM (SELECT *, CASE WHEN hit = 1 THEN sum(hit) OVER (PARTITION BY name, draw, query_id ORDER BY rnk ROWS UNBOUNDED PRECEDING) / rnk ELSE 0.0 END AS p FROM ht) GROUP BY ALL),
mn AS (SELECT name, draw, sum(v) / {QUERIES} AS v FROM av GROUP BY ALL)
SELECT name AS condition, count(*) FILTER (draw >= 0) AS nulls, round(max(v) FILTER (draw = -1), 6) AS real, round(avg(v) FILTER (draw >= 0), 6) AS null_mean, round(max(v) FILTER (draw = -1) / avg(v) FILTER (draw >= 0) - 1, 6) AS rel FROM mn GROUP BY name"""
    return sql("wall items queries", "SELECT 1 FROM wall, items, queries").replace(" SELECT 1 FROM wall, items, queries", body)


@query(_robust_sql())
def robustness(spark, d):
    """The measured wiring against wirings with its cells' inputs redrawn, under each condition."""
    kinds, arms = [], []
    for name, (threshold, weighted, prio, region) in CONDITIONS.items():
        on = None if region is None else tuple(sorted(r.dim for r in tables.dims(spark, d, region).select("dim").distinct().collect()))  # of a circuit
        kind = packed.Source(threshold, on, weighted)
        kinds += [] if kind in kinds else [kind]
        arms += shuffled_arms(_B, kinds.index(kind), f"{name}/", prio, weighted)
    x = measured(spark, d, min(k.least for k in kinds))  # built once; each condition takes its entries of it
    items, arms = packed.coded(cut_items(spark, d), reliable(packed.packed(x, DIMS, kinds)), arms, DIMS, (_K,))
    got = blocks.scores(blocks.rankings(items, queries(spark, d), [blocks.Front(blocks.Exact("truth"), DIMS), *arms], TOP), "truth", TOP)
    part = lambda i: F.split_part("arm", F.lit("/"), F.lit(i))
    per = got.groupBy(part(1).alias("condition"), part(2).cast("long").alias("draw")).agg((F.sum("ap") / QUERIES).alias("v"))
    real, null = F.max(F.when(F.col("draw") == -1, F.col("v"))), F.avg(F.when(F.col("draw") >= 0, F.col("v")))
    return per.groupBy("condition").agg(F.count_if(F.col("draw") >= 0).alias("nulls"), F.round(real, 6).alias("real"), F.round(null, 6).alias("null_mean"), F.round(real / null - 1, 6).alias("rel"))


# ---------------------------------------------------------------- verdicts
_INPUTS, _CELLS, _WINNERS = (1, 2, 4, 8, 16, 32), 320, (8, 16)


def _fan_in_sql() -> str:
    gauss = f"SELECT cell, dim, CAST(sum(CAST('0x' || substr(md5('g:2:' || dim || ':' || cell || ':' || (i // 4)), 1 + 4 * (i % 4), 4) AS BIGINT)) - 393210 AS BIGINT) AS w FROM range({_CELLS}) a(cell), range({D}) b(dim), range(12) c(i) GROUP BY cell, dim"
    dense = f"SELECT item_id, cell FROM (SELECT item_id, cell, row_number() OVER (PARTITION BY item_id ORDER BY y DESC, md5('prio:1:' || cell), cell) AS rnk FROM gy) WHERE rnk <= {{0}}"
    parts = [f"SELECT CAST({k} AS BIGINT) AS k, CAST({s} AS BIGINT) AS s, mean_ap FROM ({sweeps._ap_sql(sweeps._code_sql(_CELLS, k, s, 21), k)})" for k in _WINNERS for s in _INPUTS]
    base = [f"SELECT CAST({k} AS BIGINT) AS k, mean_ap FROM ({sweeps._ap_sql(dense.format(k), k)})" for k in _WINNERS]
    part = "SELECT tr * tr / sq AS d_eff FROM (SELECT sum(c) FILTER (i = j) AS tr, sum(c * c * CASE WHEN i = j THEN 1 ELSE 2 END) AS sq FROM (SELECT a.dim AS i, b.dim AS j, covar_samp(CAST(a.v AS DOUBLE), CAST(b.v AS DOUBLE)) AS c FROM long a JOIN long b ON a.item_id = b.item_id AND a.dim <= b.dim GROUP BY ALL))"
    body = f""", gw AS ({gauss}), gy AS (SELECT item_id, cell, sum(v * w) AS y FROM cent JOIN gw USING (dim) GROUP BY item_id, cell),
fl AS ({" UNION ALL ".join(parts)}), ba AS ({" UNION ALL ".join(base)}), de AS ({part}),
rw AS (SELECT fl.k, s, round(1 - fl.mean_ap / ba.mean_ap, 6) AS deficit, d_eff FROM fl JOIN ba USING (k), de),
rk AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY s) + (count(*) OVER (PARTITION BY k, s) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY k ORDER BY deficit) + (count(*) OVER (PARTITION BY k, deficit) - 1) / 2.0 AS rd FROM rw),
gr AS (SELECT k, round(corr(rs, rd), 9) AS spearman, bool_and(deficit > 0.1) FILTER (s <= 5) AS low, bool_and(deficit < 0.05) FILTER (s >= d_eff) AS high, count(*) FILTER (s <= 5 AND s >= d_eff) AS contradictory FROM rk GROUP BY k)
SELECT k, spearman, coalesce(spearman <= -0.9, false) AS falls, coalesce(low, false) AS low, coalesce(high, false) AS high, contradictory, coalesce(spearman <= -0.9, false) AND coalesce(low, false) AND coalesce(high, false) AS passed FROM gr"""
    return sql("cent items queries true long", "SELECT 1 FROM cent, items, queries, long, true").replace(" SELECT 1 FROM cent, items, queries, long, true", body).replace("JOIN true t", 'JOIN "true" t')


@query(_fan_in_sql())
def fan_in_verdict(spark, d):
    """Whether the deficit of sparse wirings against dense ones falls with the inputs of a cell, by the stated rule."""
    it = tables.items(spark, d)
    dense = blocks.stack(gaussian(spark, _CELLS, 2), D)
    arms = [blocks.Exact("truth"), blocks.Coded("dense", dense, _WINNERS)]
    arms += [blocks.Coded(f"s{s}", blocks.stack(w.uniform(spark, D, _CELLS, s, 21), D), _WINNERS) for s in _INPUTS]
    part = lambda i: F.split_part("arm", F.lit(":"), F.lit(i))
    per = blocks.scores(blocks.rankings(it, queries(spark, d), arms, TOP), "truth", TOP).groupBy("arm").agg(F.round(F.sum("ap") / QUERIES, 6).alias("ap"))
    per = per.select(part(1).alias("kind"), part(2).cast("long").alias("k"), "ap")
    base = per.filter("kind = 'dense'").select("k", F.col("ap").alias("base"))
    d_eff = collision.participation(it).first().participation
    rows = per.filter("kind <> 'dense'").join(base, "k").select("k", F.substring("kind", 2, 9).cast("long").alias("s"), F.round(1 - F.col("ap") / F.col("base"), 6).alias("deficit"), F.lit(d_eff).cast("double").alias("d_eff"))
    return verdicts.fan_in(rows, ["k"])
