"""The primary analysis: does a measured wiring retrieve better or worse than random wirings with some of its properties?

The items are encoded under the measured wiring and all random ones where those are drawn (``packed``), and B rankings cost one scan. For each number of
winners: the mean average precision against the random ones' mean and deviation, randomization p values, Holm's correction among
the numbers other than the primary one, an interval from a two-stage bootstrap (queries, and a subset of the random wirings),
and whether that interval lies within a margin of equivalence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewing.catalog import query
from sparsewing.functions import rng
from sparsewing.operators import blocks, inference, packed
from sparsewing.operators.graph import reliable
from sparsewing.plans import sweeps
from sparsewing.plans.retrieval import queries
from sparsewing.plans.sql import QUERIES, TOP, sql
from sparsewing.plans.wirings import measured
from sparsewing.sources import tables

DIMS, SIZES, PRIMARY, MARGIN = 25, (8, 16, 32), 16, 0.05


def scored(items: DataFrame, queries_: DataFrame, parts: DataFrame, arms: list[packed.Arm], sizes, n: int, dims: int) -> DataFrame:
    """(k, draw, trial, value): average precision of every query under the measured wiring (draw -1) and the random ones, the names of
    the ``arms`` of ``parts``."""
    # names end in the number of winners, also where there is only one
    items, arms = packed.coded(items, parts, arms, dims, tuple(sizes))
    got = blocks.scores(blocks.rankings(items, queries_, [blocks.Front(blocks.Exact("truth"), dims), *arms], n), "truth", n)
    k = F.lit(sizes[0]) if len(sizes) == 1 else F.split_part("arm", F.lit(":"), F.lit(2))
    return got.select(k.cast("long").alias("k"), F.split_part("arm", F.lit(":"), F.lit(1)).cast("long").alias("draw"), F.col("query_id").alias("trial"), F.col("ap").alias("value"))


def analysis(scores: DataFrame, queries_: DataFrame, primary: int, reps: int, subset: int, margin: float = MARGIN, seed: int = 77) -> DataFrame:
    """A row for each k of ``scores`` (k, draw, trial, value)."""
    n = queries_.count()
    mean = scores.groupBy("k", "draw").agg((F.sum("value") / n).alias("value"))
    test = inference.randomization(mean.filter("draw = -1").select("k", "value"), mean.filter("draw >= 0").select("k", "value"), ["k"])
    real = mean.filter("draw = -1").select("k", F.round("value", 9).alias("real"))
    holm = inference.holm(test.filter(F.col("k") != primary).select(F.lit("secondary").alias("family"), "k", F.col("p_two").alias("p")), ["family"], "k").select("k", F.col("adjusted").alias("p_holm"))
    trials = numbered(queries_)
    span = inference.two_stage_by(scores, trials, reps, subset, ["k"], seed)
    out = real.join(test, "k").join(holm, "k", "left").join(span, "k")
    return out.select(
        "k", (F.col("k") == primary).alias("designated"), "real", "null_mean", "null_sd", "z", "rel", "p_upper", "p_lower", "p_two", "p_holm", "rel_low", "rel_high",
        ((F.col("rel_low") > -margin) & (F.col("rel_high") < margin)).alias("equivalent"),
    )


def cut_items(spark, d) -> DataFrame:
    """Items on the dims of the measured wiring."""
    return tables.items(spark, d).select("item_id", F.slice("q", 1, DIMS).alias("q"))


def parts(spark, d) -> DataFrame:
    """The measured wiring, kept in parts."""
    return reliable(packed.packed(measured(spark, d), DIMS, [packed.Source()]))


#: Random wirings, replicates, random wirings of a replicate, numbers of winners.
_B, _REPS, _SUBSET, _KS = 40, 200, 20, (8, 16, 32, 64)


def shuffled_arms(draws: int, source: int = 0, name: str = "", prio: int = 1, weighted: bool = False) -> list[packed.Arm]:
    """A source (draw -1) and wirings that keep each cell's number of inputs and their weights only."""
    return [packed.Arm(f"{name}{b}", source, prio, None if b < 0 else 100 + b, weighted) for b in range(-1, draws)]


def _primary_sql(_B: int, _KS: tuple, _REPS: int = 0, _SUBSET: int = 0) -> str:
    shuf = f"""
SELECT s.draw, n.dim, n.cell, o.w FROM (SELECT draw, cell, dim, row_number() OVER (PARTITION BY draw, cell ORDER BY md5('shuf:' || (100 + draw) || ':' || dim || ':' || cell), dim) AS r FROM (SELECT DISTINCT cell FROM w50), range({DIMS}) b(dim), range({_B}) t(draw)) n
JOIN (SELECT cell, w, row_number() OVER (PARTITION BY cell ORDER BY dim) AS r FROM w50) o ON o.cell = n.cell AND o.r = n.r JOIN range({_B}) s(draw) ON s.draw = n.draw
"""
    return f"""
, wirs AS (SELECT -1 AS draw, dim, cell, w FROM w50 UNION ALL {shuf}),
it AS (SELECT item_id, list_slice(q, 1, {DIMS}) AS q FROM items),
lg AS (SELECT item_id, unnest(range({DIMS})) AS dim, unnest(q) AS v FROM it),
ct AS (SELECT item_id, dim, {DIMS} * v - sum(v) OVER (PARTITION BY item_id) AS v FROM lg),
dr AS (SELECT draw, item_id, cell, sum(v) AS y FROM ct JOIN wirs USING (dim) GROUP BY ALL),
cd AS (SELECT draw, k, item_id, cell FROM (SELECT draw, item_id, cell, row_number() OVER (PARTITION BY draw, item_id ORDER BY y DESC, md5('prio:1:' || cell), cell) AS r FROM dr), (SELECT unnest({list(_KS)}) AS k) WHERE r <= k),
sh AS (SELECT a.draw, a.k, query_id, b.item_id, count(*) AS n FROM queries JOIN cd a ON a.item_id = query_id JOIN cd b ON b.draw = a.draw AND b.k = a.k AND b.cell = a.cell AND b.item_id <> query_id GROUP BY ALL),
ev AS (SELECT draw, k, query_id, i.item_id FROM (SELECT DISTINCT draw, k FROM cd), queries, items i WHERE i.item_id <> query_id),
pr AS (SELECT draw, k, query_id, item_id, row_number() OVER (PARTITION BY draw, k, query_id ORDER BY 2 * k - 2 * coalesce(n, 0), md5('tie:5:' || query_id || ':' || item_id), item_id) AS rnk FROM ev LEFT JOIN sh USING (draw, k, query_id, item_id)),
tr AS (SELECT query_id, item_id FROM (SELECT query_id, b.item_id, row_number() OVER (PARTITION BY query_id ORDER BY list_sum(list_transform(list_zip(a.q, b.q), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), b.item_id) AS r FROM queries JOIN it a ON a.item_id = query_id JOIN it b ON b.item_id <> query_id) WHERE r <= {TOP}),
ht AS (SELECT p.*, CASE WHEN t.item_id IS NULL THEN 0 ELSE 1 END AS hit FROM pr p LEFT JOIN tr t ON t.query_id = p.query_id AND t.item_id = p.item_id WHERE rnk <= {TOP}),
av AS (SELECT draw, k, query_id, round(sum(p) / {TOP}, 9) AS v FROM (SELECT *, CASE WHEN hit = 1 THEN sum(hit) OVER (PARTITION BY draw, k, query_id ORDER BY rnk ROWS UNBOUNDED PRECEDING) / rnk ELSE 0.0 END AS p FROM ht) GROUP BY draw, k, query_id),
mn AS (SELECT draw, k, sum(v) / {QUERIES} AS v FROM av GROUP BY draw, k),
rl AS (SELECT k, v AS real FROM mn WHERE draw = -1),
nl AS (SELECT k, any_value(real) AS real, count(*) AS n, count(*) FILTER (v >= real) AS ge, count(*) FILTER (v <= real) AS le, avg(v) AS m, stddev_samp(v) AS sd FROM mn JOIN rl USING (k) WHERE draw >= 0 GROUP BY k),
ps AS (SELECT *, (1 + ge) / (1 + n) AS up, (1 + le) / (1 + n) AS lo FROM nl),
pt AS (SELECT *, least(1.0, 2 * least(up, lo)) AS two FROM ps),
po AS (SELECT query_id, row_number() OVER (ORDER BY md5('q:3:' || query_id), query_id) - 1 AS pos FROM queries),
bs AS (SELECT rep, CAST('0x' || substr(md5('boot:77:' || rep || ':' || slot), 1, 8) AS BIGINT) % {QUERIES} AS pos FROM range({_REPS}) a(rep), range({QUERIES}) b(slot)),
tt AS (SELECT rep, draw, k, sum(v) AS v FROM bs JOIN po USING (pos) JOIN av USING (query_id) GROUP BY ALL),
pk AS (SELECT rep, draw FROM (SELECT rep, draw, row_number() OVER (PARTITION BY rep ORDER BY md5('sub:77:' || draw || ':' || rep), draw) AS r FROM range({_REPS}) a(rep), range({_B}) t(draw)) WHERE r <= {_SUBSET}),
re AS (SELECT k, rep, x.v / b.v - 1 AS rel FROM (SELECT * FROM tt WHERE draw = -1) x JOIN (SELECT rep, k, avg(v) AS v FROM tt JOIN pk USING (rep, draw) GROUP BY rep, k) b USING (rep, k)),
ci AS (SELECT k, round(quantile_cont(rel, 0.05), 9) AS rel_low, round(quantile_cont(rel, 0.95), 9) AS rel_high FROM re GROUP BY k)
SELECT CAST(k AS BIGINT) AS k, k = {PRIMARY} AS designated, round(real, 9) AS real, round(m, 9) AS null_mean, round(sd, 9) AS null_sd, round(CASE WHEN sd > 0 THEN (real - m) / sd END, 6) AS z, round(CASE WHEN m <> 0 THEN real / m - 1 END, 9) AS rel,
  round(up, 9) AS p_upper, round(lo, 9) AS p_lower, round(two, 9) AS p_two, CASE WHEN k <> {PRIMARY} THEN round(two, 9) END AS p_holm, rel_low, rel_high, rel_low > {-MARGIN} AND rel_high < {MARGIN} AS equivalent
FROM pt JOIN ci USING (k)
"""


def _many_sql(sql_: str, ks: tuple) -> str:
    """The same statement without a row for every drive and pair: drives are sums over lists, and the first of them are kept by
    aggregation, in the same orders. Several numbers besides the primary one are corrected among themselves."""
    most = max(ks)
    codes = f"""ca AS (SELECT draw, cell, list(dim + 1) AS dims FROM wirs GROUP BY draw, cell),
cp AS (SELECT cell, count(*) OVER () AS m, row_number() OVER (ORDER BY md5('prio:1:' || cell), cell) AS p FROM (SELECT DISTINCT cell FROM w50)),
cl AS MATERIALIZED (SELECT draw, cell, dims, m, p FROM ca JOIN cp USING (cell)),
ct AS MATERIALIZED (SELECT item_id, list_transform(q, lambda v: {DIMS} * v - list_sum(q)) AS c FROM it),
tp AS (SELECT draw, item_id, arg_max(cell, CAST(list_sum(list_transform(dims, lambda d: c[d])) AS BIGINT) * m - p, {most}) AS top FROM cl, ct GROUP BY draw, item_id),
cd AS (SELECT draw, k, item_id, cell FROM (SELECT draw, item_id, unnest(top) AS cell, unnest(range(1, len(top) + 1)) AS r FROM tp), (SELECT unnest({list(ks)}) AS k) WHERE r <= k),
"""
    ranks = f"""ev AS MATERIALIZED (SELECT query_id, i.item_id, count(*) OVER () AS m, row_number() OVER (PARTITION BY query_id ORDER BY md5('tie:5:' || query_id || ':' || i.item_id), i.item_id) AS p FROM queries, items i WHERE i.item_id <> query_id),
pt0 AS (SELECT draw, k, query_id, arg_max(item_id, coalesce(n, 0) * m - p, {TOP}) AS top FROM (SELECT DISTINCT draw, k FROM cd) CROSS JOIN ev LEFT JOIN sh USING (draw, k, query_id, item_id) GROUP BY draw, k, query_id),
pr AS (SELECT draw, k, query_id, unnest(top) AS item_id, unnest(range(1, len(top) + 1)) AS rnk FROM pt0),
"""
    cut = lambda name: sql_.index(f"\n{name} AS (") + 1
    holm = f"""hp AS (SELECT k, p, count(*) OVER () AS c, row_number() OVER (ORDER BY p, k) AS r FROM (SELECT k, round(two, 9) AS p FROM pt WHERE k <> {PRIMARY})),
hm AS (SELECT k, round(least(1.0, max((c - r + 1) * p) OVER (ORDER BY r)), 9) AS p_holm FROM hp),
"""
    out = sql_[: cut("lg")] + codes + sql_[cut("sh") : cut("ev")] + ranks + sql_[cut("tr") : cut("po")] + holm + sql_[cut("po") :]
    return out.replace(f"CASE WHEN k <> {PRIMARY} THEN round(two, 9) END AS p_holm", "p_holm").replace("FROM pt JOIN ci USING (k)", "FROM pt JOIN ci USING (k) LEFT JOIN hm USING (k)")


@query(sql("w50 items queries", "SELECT 1 FROM w50, items, queries").replace(" SELECT 1 FROM w50, items, queries", _many_sql(_primary_sql(_B, _KS, _REPS, _SUBSET), _KS)))
def primary_shuffled(spark, d):
    """Against wirings that keep each cell's inputs and weights, which SQL can draw too."""
    q = queries(spark, d)
    return analysis(scored(cut_items(spark, d), q, parts(spark, d), shuffled_arms(_B), _KS, TOP, DIMS), q, PRIMARY, _REPS, _SUBSET)


@query()
def primary_analysis(spark, d):
    """Against a pool of wirings with both margins of the measured one, mixed by trades."""
    x, q = reliable(measured(spark, d).select("dim", "cell", "w")), queries(spark, d)
    own, drawn = reliable(packed.packed(x, DIMS, [packed.Source()])), sweeps.pool_parts(spark, x, 20, DIMS, 1)
    arms = [packed.Arm(f"{b}", b + 1) for b in range(-1, 20)]
    return analysis(scored(cut_items(spark, d), q, own.unionByName(drawn), arms, SIZES, TOP, DIMS), q, PRIMARY, 100, 10)


_SETS, _SREPS, _SDRAWS, _SSUBSET, _SKS = 12, 20, 5, 3, (8, 16)
_SCORES = _primary_sql(_SDRAWS, _SKS)
_SCORES = _SCORES[: _SCORES.index("\nmn AS (")]
_COVERAGE = f"""
, pv AS (SELECT draw, pos, v FROM av JOIN po USING (query_id) WHERE k = {PRIMARY}),
dt AS (SELECT dataset, slot, CAST('0x' || substr(md5('data:5:' || dataset || ':' || slot), 1, 8) AS BIGINT) % {QUERIES} AS pos FROM range({_SETS}) a(dataset), range({QUERIES}) b(slot)),
rp AS (SELECT dataset, rep, CAST('0x' || substr(md5('boot:5:' || dataset || ':' || rep || ':' || s), 1, 8) AS BIGINT) % {QUERIES} AS slot FROM range({_SETS}) a(dataset), range({_SREPS}) c(rep), range({QUERIES}) b(s)),
sb AS (SELECT dataset, rep, draw FROM (SELECT dataset, rep, draw, row_number() OVER (PARTITION BY dataset, rep ORDER BY md5('sub:5:' || draw || ':' || dataset || ':' || rep), draw) AS r FROM range({_SETS}) a(dataset), range({_SREPS}) c(rep), range({_SDRAWS}) t(draw)) WHERE r <= {_SSUBSET} UNION ALL SELECT dataset, rep, -1 FROM range({_SETS}) a(dataset), range({_SREPS}) c(rep)),
tv AS (SELECT dataset, rep, draw, sum(v) AS t FROM rp JOIN dt USING (dataset, slot) JOIN sb USING (dataset, rep) JOIN pv USING (pos, draw) GROUP BY ALL),
rv AS (SELECT dataset, rep, max(t) FILTER (draw = -1) / avg(t) FILTER (draw >= 0) - 1 AS rel FROM tv GROUP BY ALL),
sp AS (SELECT dataset, quantile_cont(rel, 0.05) AS lo, quantile_cont(rel, 0.95) AS hi FROM rv GROUP BY dataset),
th AS (SELECT max(t) FILTER (draw = -1) / avg(t) FILTER (draw >= 0) - 1 AS truth FROM (SELECT draw, sum(v) AS t FROM pv GROUP BY draw)),
cv AS (SELECT count(*) AS n, count(*) FILTER (lo <= truth AND truth <= hi) AS k, any_value(truth) AS truth, quantile_cont(hi - lo, 0.5) AS width FROM sp, th),
wl AS (SELECT *, k / n AS p, 1.959964 AS z FROM cv)
SELECT n, k, round(p, 9) AS share, round((p + z * z / (2 * n)) / (1 + z * z / n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 9) AS low,
  round((p + z * z / (2 * n)) / (1 + z * z / n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n), 9) AS high, round(truth, 9) AS truth, round(width, 9) AS median_width FROM wl
"""


def numbered(queries_) -> DataFrame:
    """(trial, pos): the stated queries in the order of their digests."""
    from pyspark.sql import Window

    return queries_.select(F.col("item_id").alias("trial")).withColumn("pos", F.row_number().over(Window.orderBy(rng.digest("q", 3, "trial"), "trial")).cast("long") - 1)


@query(sql("w50 items queries", "SELECT 1 FROM w50, items, queries").replace(" SELECT 1 FROM w50, items, queries", _SCORES.rstrip().rstrip(",") + ", po AS (SELECT query_id, row_number() OVER (ORDER BY md5('q:3:' || query_id), query_id) - 1 AS pos FROM queries)" + _COVERAGE))
def coverage_study(spark, d):
    """Does the two-stage interval cover? Data sets are drawn from the queries' scores at the primary number of winners."""
    q = queries(spark, d)
    got = scored(cut_items(spark, d), q, parts(spark, d), shuffled_arms(_SDRAWS), _SKS, TOP, DIMS).filter(F.col("k") == PRIMARY)
    return inference.coverage_study(got, numbered(q), _SETS, _SREPS, _SSUBSET, 5)
