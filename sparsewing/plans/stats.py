"""Queries of inference over tidy score tables.

Scores are real ones: revenue shares and order totals stand in for trials, so that every statistic can be restated in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsewing.catalog import query
from sparsewing.functions import numbers
from sparsewing.operators import inference as i
from sparsewing.sources import tables


def _null(spark, d):
    """(seg, draw, value): 40 draws per market segment, the mean order total of the customers with custkey % 40 = draw."""
    c, o = tables.table(spark, d, "customer"), tables.table(spark, d, "orders")
    x = o.join(c, o.o_custkey == c.c_custkey)
    return x.groupBy(F.col("c_mktsegment").alias("seg"), (F.col("c_custkey") % 40).alias("draw")).agg(F.round(F.avg("o_totalprice"), 2).alias("value"))


_NULL = "SELECT c_mktsegment AS seg, c_custkey % 40 AS draw, round(avg(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"


def _real(spark, d):
    c, o = tables.table(spark, d, "customer"), tables.table(spark, d, "orders")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("seg")).agg(F.round(F.avg("o_totalprice"), 2).alias("value"))


_REAL = "SELECT c_mktsegment AS seg, round(avg(o_totalprice), 2) AS real FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"
_RAND = f"SELECT seg, (1 + ge) / (1 + n) AS up, (1 + le) / (1 + n) AS lo, m, sd, real FROM (SELECT seg, any_value(real) AS real, CAST(count(*) AS DOUBLE) AS n, count(*) FILTER (value >= real) AS ge, count(*) FILTER (value <= real) AS le, avg(value) AS m, stddev_samp(value) AS sd FROM ({_NULL}) JOIN ({_REAL}) USING (seg) GROUP BY seg)"


@query(f"SELECT seg, round(up, 9) AS p_upper, round(lo, 9) AS p_lower, round(least(1.0, 2 * least(up, lo)), 9) AS p_two, round(m, 9) AS null_mean, round(sd, 9) AS null_sd, round(CASE WHEN sd > 0 THEN (real - m) / sd END, 6) AS z, round(CASE WHEN m <> 0 THEN real / m - 1 END, 9) AS rel FROM ({_RAND})")
def randomization(spark, d):
    return i.randomization(_real(spark, d), _null(spark, d), ["seg"])


_P = "SELECT r_name AS family, n_name AS key, round(avg(CASE WHEN c_acctbal > 4500 THEN 1.0 ELSE 0.0 END) / 10, 6) AS p FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"


def _p(spark, d):
    c, n, r = (tables.table(spark, d, t) for t in ("customer", "nation", "region"))
    x = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))  # 25 and 5 rows
    return x.groupBy(F.col("r_name").alias("family"), F.col("n_name").alias("key")).agg(F.round(F.avg(F.when(F.col("c_acctbal") > 4500, 1.0).otherwise(0.0)) / 10, 6).alias("p"))


@query(f"SELECT family, key, p, round(least(1.0, max((m - r + 1) * p) OVER (PARTITION BY family ORDER BY p, key ROWS UNBOUNDED PRECEDING)), 9) AS adjusted FROM (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, key) AS r FROM ({_P}))")
def holm(spark, d):
    return i.holm(_p(spark, d), ["family"], "key")


_SHIFTS = (-0.1, -0.05, 0.05, 0.1)
_POWER = f"SELECT seg, shift, round(avg(CASE WHEN least(1.0, 2 * least((1 + ge) / n, (1 + le) / n)) <= 0.05 THEN 1.0 ELSE 0.0 END), 9) AS power FROM (SELECT a.seg, shift, a.draw, CAST(count(*) + 1 AS DOUBLE) AS n, count(*) FILTER (round(b.value, 12) >= round(a.value * (1 + shift), 12)) AS ge, count(*) FILTER (round(b.value, 12) <= round(a.value * (1 + shift), 12)) AS le FROM nul a JOIN nul b ON a.seg = b.seg AND a.draw <> b.draw, (VALUES {', '.join(f'(CAST({s} AS DOUBLE))' for s in _SHIFTS)}) v(shift) GROUP BY ALL) GROUP BY seg, shift"


@query(f"WITH nul AS ({_NULL}) {_POWER}")
def shift_power(spark, d):
    return i.shift_power(_null(spark, d), ["seg"], list(_SHIFTS))


@query(f"WITH nul AS ({_NULL}) SELECT seg, min(shift) FILTER (shift > 0) AS up, max(shift) FILTER (shift < 0) AS down, arg_min(shift, abs(shift) * 1000 + shift) AS smallest FROM ({_POWER}) WHERE power >= 0.1 GROUP BY seg")
def smallest_shift(spark, d):
    return i.smallest_shift(i.shift_power(_null(spark, d), ["seg"], list(_SHIFTS)), ["seg"], 0.1)


def _arm(spark, d, seg):
    return _null(spark, d).filter(F.col("seg") == seg).select(F.col("draw").alias("trial"), "value")


_BOOT = "SELECT draw, CAST('0x' || substr(md5('boot:3:' || draw || ':' || slot), 1, 8) AS BIGINT) % 40 AS pos FROM range(200) a(draw), range(40) b(slot)"


@query(f"WITH nul AS ({_NULL}), p AS (SELECT a.draw AS trial, a.value AS a, b.value AS b FROM nul a JOIN nul b ON a.draw = b.draw WHERE a.seg = 'BUILDING' AND b.seg = 'MACHINERY'), r AS (SELECT t.draw, 100 * (avg(a) / avg(b) - 1) AS gap FROM ({_BOOT}) t JOIN p ON pos = trial GROUP BY t.draw) SELECT round((SELECT 100 * (avg(a) / avg(b) - 1) FROM p), 6) AS gap, round(quantile_cont(gap, 0.025), 6) AS low, round(quantile_cont(gap, 0.975), 6) AS high FROM r")
def contrast_bootstrap(spark, d):
    return i.contrast_bootstrap(_arm(spark, d, "BUILDING"), _arm(spark, d, "MACHINERY"), 200, 40, 3)


@query(f"WITH nul AS ({_NULL}), arms AS (SELECT CASE WHEN seg = 'BUILDING' THEN '' ELSE seg END AS arm, draw AS trial, value FROM nul), r AS (SELECT draw, max(m) FILTER (arm = '') / max(m) FILTER (arm <> '') AS ratio FROM (SELECT t.draw, arm, avg(value) AS m FROM ({_BOOT}) t JOIN arms ON pos = trial GROUP BY ALL) GROUP BY draw) SELECT round((SELECT max(m) FILTER (arm = '') / max(m) FILTER (arm <> '') FROM (SELECT arm, avg(value) AS m FROM arms GROUP BY arm)), 9) AS ratio, round(quantile_cont(ratio, 0.025), 9) AS low, round(quantile_cont(ratio, 0.975), 9) AS high FROM r")
def ratio_best(spark, d):
    n = _null(spark, d).select(F.col("seg").alias("arm"), F.col("draw").alias("trial"), "value")
    return i.ratio_to_best(n.filter("arm = 'BUILDING'").select("trial", "value"), n.filter("arm <> 'BUILDING'"), 200, 40, 3)


_INT = "SELECT n_name AS key, round(avg(c_acctbal) / 4500 - 1 - 0.03, 6) AS low, round(avg(c_acctbal) / 4500 - 1 + 0.03, 6) AS high FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"


@query(f"SELECT key, low, high, low > -0.1 AND high < 0.1 AS equivalent FROM ({_INT})")
def equivalence(spark, d):
    c, n = tables.table(spark, d, "customer"), tables.table(spark, d, "nation")
    m = F.avg("c_acctbal") / 4500 - 1
    x = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("key")).agg(F.round(m - 0.03, 6).alias("low"), F.round(m + 0.03, 6).alias("high"))  # 25 rows by the schema
    return i.equivalence(x, 0.1)


_Z95 = numbers.upper_normal(0.025)
_WIL = f"k / n::DOUBLE AS p, n, 1 + {_Z95!r} * {_Z95!r} / n AS d"


@query(f"SELECT flag, k, n, round((p + {_Z95!r} * {_Z95!r} / (2 * n)) / d - h, 9) AS low, round((p + {_Z95!r} * {_Z95!r} / (2 * n)) / d + h, 9) AS high FROM (SELECT *, {_Z95!r} * sqrt(p * (1 - p) / n + {_Z95!r} * {_Z95!r} / (4 * n * n)) / d AS h FROM (SELECT flag, k, {_WIL} FROM (SELECT l_returnflag AS flag, count(*) FILTER (l_quantity > 40) AS k, count(*) AS n FROM lineitem GROUP BY 1)))")
def wilson(spark, d):
    x = tables.table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_if(F.col("l_quantity") > 40).alias("k"), F.count("*").alias("n"))
    return i.wilson(x, _Z95)


_METHODS = "SELECT p_brand || '/' || p_size AS method, min(p_size) AS ops, CAST(count(*) AS BIGINT) AS bits, round(avg(p_retailprice), 4) AS quality FROM part WHERE p_size <= 20 GROUP BY p_brand, p_size"


def _methods(spark, d, top=20):
    p = tables.table(spark, d, "part")
    x = (p.filter(F.col("p_size") <= top) if top else p).groupBy("p_brand", "p_size").agg(F.min("p_size").alias("ops"), F.count("*").alias("bits"), F.round(F.avg("p_retailprice"), 4).alias("quality"))
    return x.select(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("method"), "ops", "bits", "quality")


@query(f"WITH m AS ({_METHODS}) SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.ops <= a.ops AND b.bits <= a.bits AND b.quality >= a.quality AND (b.ops < a.ops OR b.bits < a.bits OR b.quality > a.quality))")
def pareto(spark, d):
    return i.pareto(_methods(spark, d), ["ops", "bits"], "quality")


_EVERY = _METHODS.replace(" WHERE p_size <= 20", "")


@query(f"WITH m AS ({_EVERY}) SELECT * FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.ops <= a.ops AND b.bits <= a.bits AND b.quality >= a.quality AND (b.ops < a.ops OR b.bits < a.bits OR b.quality > a.quality))")
def pareto_all(spark, d):
    """As ``pareto``, over the methods of every size."""
    return i.pareto(_methods(spark, d, None), ["ops", "bits"], "quality")


_T39 = numbers.t_quantile(0.975, 39)


@query(f"WITH nul AS ({_NULL}) SELECT seg, n, round(m, 9) AS mean, round(m - {_T39!r} * sd / sqrt(n), 9) AS low, round(m + {_T39!r} * sd / sqrt(n), 9) AS high FROM (SELECT a.seg, count(*) AS n, avg(a.value - b.value) AS m, stddev_samp(a.value - b.value) AS sd FROM nul a JOIN nul b ON a.draw = b.draw AND b.seg = 'BUILDING' WHERE a.seg <> 'BUILDING' GROUP BY a.seg)")
def paired_ablation(spark, d):
    """Treatment against control on the same trials."""
    n = _null(spark, d)
    c = n.filter("seg = 'BUILDING'").select("draw", F.col("value").alias("c"))
    return i.paired_t(n.filter("seg <> 'BUILDING'").join(c, "draw").withColumn("d", F.col("value") - F.col("c")), ["seg"], _T39)


@query("SELECT round(corr(rx, ry), 9) AS rho FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM (SELECT c_nationkey, count(*) AS x, round(avg(c_acctbal)) AS y FROM customer GROUP BY 1))")
def spearman(spark, d):
    x = tables.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("x"), F.round(F.avg("c_acctbal")).alias("y"))
    return i.spearman(x, "x", "y")


@query("SELECT month, value, bool_and(value >= 0.02) OVER (ORDER BY month ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS holds FROM (SELECT month(o_orderdate) AS month, round(count(*) / (SELECT count(*) FROM orders)::DOUBLE, 9) AS value FROM orders GROUP BY 1)")
def plateau(spark, d):
    """From which point on all later values stay above a level."""
    from pyspark.sql import Window

    o = tables.table(spark, d, "orders")
    n = o.agg(F.count("*").alias("n"))
    x = o.groupBy(F.month("o_orderdate").cast("bigint").alias("month")).agg(F.count("*").alias("c")).crossJoin(n).select("month", F.round(F.col("c") / F.col("n"), 9).alias("value"))
    return x.withColumn("holds", F.min(F.col("value") >= 0.02).over(Window.orderBy("month").rowsBetween(0, Window.unboundedFollowing)))


@query("SELECT seg, arg_min(alpha, (-score) * 1000 + abs(alpha)) AS alpha FROM (SELECT c_mktsegment AS seg, (c_custkey % 5) / 2.0 AS alpha, round(avg(c_acctbal), 0) AS score FROM customer GROUP BY ALL) GROUP BY seg")
def validation_choice(spark, d):
    """The best mean wins; equal ones go to the smallest exponent."""
    x = tables.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("seg"), ((F.col("c_custkey") % 5) / 2).alias("alpha")).agg(F.round(F.avg("c_acctbal"), 0).alias("score"))
    return x.groupBy("seg").agg(F.min_by("alpha", F.struct(-F.col("score"), F.abs("alpha"))).alias("alpha"))


def _boot_sql(n: int, seed: int, draws: int = 200) -> str:
    return f"SELECT draw, slot, CAST('0x' || substr(md5('boot:{seed}:' || draw || ':' || slot), 1, 8) AS BIGINT) % {n} AS pos FROM range({draws}) a(draw), range({n}) b(slot)"


_A = (1 - 0.9) / 2


@query(f"SELECT round(quantile_cont(rel, {_A!r}), 9) AS low, round(quantile_cont(rel, {1 - _A!r}), 9) AS high FROM (SELECT t.draw, sum(r) / sum(b) - 1 AS rel FROM ({_boot_sql(25, 8)}) t JOIN (SELECT c_nationkey AS cluster, sum(c_acctbal + 5000) AS r, sum(CAST(c_custkey % 1000 + 5000 AS DOUBLE)) AS b FROM customer GROUP BY 1) ON pos = cluster GROUP BY t.draw)")
def cluster_bootstrap(spark, d):
    c = tables.table(spark, d, "customer")
    rows = c.select(F.col("c_nationkey").alias("cluster"), (F.col("c_acctbal") + 5000).alias("real"), (F.col("c_custkey") % 1000 + 5000).cast("double").alias("base"))
    return i.cluster_bootstrap(rows, 200, 25, 8)


@query(f"WITH nul AS ({_NULL}), a AS (SELECT t.draw, avg(value) AS real FROM ({_boot_sql(40, 5)}) t JOIN nul ON pos = nul.draw WHERE seg = 'BUILDING' GROUP BY t.draw), b AS (SELECT t.draw, avg(value) AS base FROM ({_boot_sql(40, 6)}) t JOIN nul ON pos = nul.draw WHERE seg = 'MACHINERY' AND slot < 10 GROUP BY t.draw) SELECT round(quantile_cont(real / base - 1, {_A!r}), 9) AS rel_low, round(quantile_cont(real / base - 1, {1 - _A!r}), 9) AS rel_high, round(quantile_cont(real - base, {_A!r}), 4) AS low, round(quantile_cont(real - base, {1 - _A!r}), 4) AS high FROM a JOIN b USING (draw)")
def two_stage_bootstrap(spark, d):
    null = _null(spark, d).filter("seg = 'MACHINERY'").select("draw", "value")
    return i.two_stage(_arm(spark, d, "BUILDING"), null, 200, 40, 40, 10, 5)


@query(f"SELECT k, n, round((p + {_Z95!r} * {_Z95!r} / (2 * n)) / d - h, 9) AS low, round((p + {_Z95!r} * {_Z95!r} / (2 * n)) / d + h, 9) AS high FROM (SELECT *, {_Z95!r} * sqrt(p * (1 - p) / n + {_Z95!r} * {_Z95!r} / (4 * n * n)) / d AS h FROM (SELECT k, {_WIL} FROM (SELECT count(*) FILTER (low <= 0 AND high >= 0) AS k, count(*) AS n FROM ({_INT}))))")
def coverage(spark, d):
    """How many of the intervals hold the truth."""
    return i.coverage(equivalence(spark, d).select("low", "high"), 0.0, _Z95)
