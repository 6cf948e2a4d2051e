"""Queries over weighted wirings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparsewing.catalog import query
from sparsewing.operators import generators, wiring as w
from sparsewing.plans.sql import M, S, sql
from sparsewing.sources import tables


def measured(spark, d, threshold=50, flag=None, region=None):
    e = tables.edges(spark, d)
    return w.build(e.filter(F.col("flag") == flag) if flag else e, tables.dims(spark, d, region), threshold, rows=tables.table(spark, d, "lineitem").count())


@query(sql("w50", "SELECT dim, cell, w, partners FROM w50"))
def wiring_build(spark, d):
    return measured(spark, d)


@query(sql("w50", "SELECT dim, cell, w, partners FROM w50 WHERE dim IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')"))
def wiring_align(spark, d):
    return w.align(measured(spark, d), tables.dims(spark, d, "EUROPE"))


@query(sql("wall", "SELECT t AS threshold, count(*) AS nnz, count(DISTINCT cell) AS cells, CAST(sum(w) AS BIGINT) AS weight FROM wall, (VALUES (1), (50), (100), (150)) v(t) WHERE w >= t GROUP BY t"))
def wiring_threshold(spark, d):
    x = measured(spark, d, 1).select("cell", "w", F.explode(F.array(*[F.lit(t) for t in (1, 50, 100, 150)])).alias("threshold")).filter("w >= threshold")
    return x.groupBy("threshold").agg(F.count("*").alias("nnz"), F.countDistinct("cell").alias("cells"), F.sum("w").alias("weight"))


@query(sql("w50", "SELECT 'cell' AS side, cell AS id, count(*) AS degree, CAST(sum(w) AS BIGINT) AS weight FROM w50 GROUP BY cell UNION ALL SELECT 'dim', dim, count(*), CAST(sum(w) AS BIGINT) FROM w50 GROUP BY dim"))
def wiring_degrees(spark, d):
    x = measured(spark, d)
    a = w.inputs(x).select(F.lit("cell").alias("side"), F.col("cell").alias("id"), F.col("inputs").alias("degree"), "weight")
    return a.unionByName(w.fan_out(x).select(F.lit("dim").alias("side"), F.col("dim").alias("id"), F.col("fan_out").alias("degree"), "weight"))


@query(
    sql(
        "w50",
        "SELECT count(*) AS cells, CAST(sum(n) AS BIGINT) AS nnz, round(avg(n), 9) AS mean_inputs, quantile_cont(CAST(n AS DOUBLE), 0.5) AS median_inputs, max(n) AS max_inputs, count(*) FILTER (n = 1) AS single_input, any_value(dims) AS dims, any_value(cv) AS fan_out_cv, any_value(mx) AS max_fan_out, any_value(top) AS top_dim FROM (SELECT cell, count(*) AS n FROM w50 GROUP BY cell), (SELECT count(*) AS dims, round(stddev_pop(f) / avg(f), 9) AS cv, max(f) AS mx, arg_max(dim, f * 1000 - dim) AS top FROM (SELECT dim, count(*) AS f FROM w50 GROUP BY dim))",
    )
)
def wiring_summary(spark, d):
    return w.summary(measured(spark, d)).withColumns({"mean_inputs": F.round("mean_inputs", 9), "fan_out_cv": F.round("fan_out_cv", 9)})


@query(sql("w50", "SELECT n AS inputs, count(*) AS cells FROM (SELECT cell, count(*) AS n FROM w50 GROUP BY cell) GROUP BY n"))
def wiring_histogram(spark, d):
    return w.histogram(measured(spark, d))


_OVER = "SELECT a.dim AS a, b.dim AS b, count(*) AS shared FROM w50 a JOIN w50 b ON a.cell = b.cell AND a.dim < b.dim GROUP BY ALL"


@query(sql("w50", _OVER))
def wiring_overlaps(spark, d):
    return w.overlaps(measured(spark, d))


@query(sql("w50", f"SELECT CAST(sum(shared * shared) AS BIGINT) AS q, CAST(sum(shared * (shared - 1) / 2) AS BIGINT) AS four_cycles FROM ({_OVER})"))
def wiring_q(spark, d):
    return w.co_occurrence(measured(spark, d))


@query("SELECT count(*) AS either, count(*) FILTER (WHERE x AND y) AS both_ FROM (SELECT dim, cell, bool_or(f = 'A') AS x, bool_or(f = 'R') AS y FROM (SELECT s_nationkey AS dim, l_partkey AS cell, l_returnflag AS f, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag IN ('A', 'R') GROUP BY ALL) WHERE w >= 50 GROUP BY dim, cell)")
def wiring_jaccard(spark, d):
    """Edges of two sides (return flags A and R) and those on both."""
    return w.jaccard(measured(spark, d, flag="A"), measured(spark, d, flag="R")).withColumnRenamed("both", "both_")


@query(sql("wall", "SELECT count(*) AS entries, count(*) FILTER (w >= 50) AS kept, CAST(sum(w) AS BIGINT) AS weight, CAST(sum(w) FILTER (w >= 50) AS BIGINT) AS kept_weight FROM wall"))
def wiring_retained(spark, d):
    return w.retained(measured(spark, d, 1), 50)


@query(sql("w50", "SELECT cell, row_number() OVER (ORDER BY cell) - 1 AS idx FROM (SELECT DISTINCT cell FROM w50)"))
def dense_index(spark, d):
    return w.dense_index(measured(spark, d).select("cell").distinct(), "cell", "idx")


@query("SELECT s_suppkey, s_name, n_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE regexp_matches(n_name, '^(?:[A-M].*)') AND n_regionkey IN (1, 3)")
def selector(spark, d):
    s, n = tables.table(spark, d, "supplier"), tables.table(spark, d, "nation")
    x = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)  # 25 rows by the schema
    return w.select_nodes(x, n_name_regex="[A-M].*", n_regionkey=[1, 3]).select("s_suppkey", "s_name", "n_name", "s_acctbal")


@query("SELECT s_suppkey, s_name FROM supplier ORDER BY md5('sel:11:' || s_suppkey), s_suppkey LIMIT 20")
def selector_sample(spark, d):
    return w.select_nodes(tables.table(spark, d, "supplier").select("s_suppkey", "s_name"), seed=11, max_n=20)


@query("SELECT c_custkey AS id, coalesce(p, 'unclear') AS kind FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def nt_left_join(spark, d):
    """Left join with the first of several right rows (by key) and a default for misses."""
    c, o = tables.table(spark, d, "customer"), tables.table(spark, d, "orders")
    first = o.groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("p"))
    return c.join(first, c.c_custkey == first.o_custkey, "left").select(F.col("c_custkey").alias("id"), F.coalesce("p", F.lit("unclear")).alias("kind"))


@query("SELECT l_suppkey AS pre, l_partkey AS post, CAST(l_quantity AS BIGINT) AS weight FROM lineitem WHERE l_suppkey <> l_partkey AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def edge_semi_join(spark, d):
    pre = tables.table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("pre"))
    post = tables.table(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("post"))
    return w.no_loops(w.select_edges(tables.edges(spark, d), pre, post)).select("pre", "post", "weight")


@query("SELECT s_suppkey AS pre, n_name AS name, CAST(s_nationkey AS BIGINT) AS dim FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def dim_lookup(spark, d):
    return tables.dims(spark, d, "ASIA").select("pre", "name", "dim")


@query("SELECT count(*) AS edges, CAST(sum(w) AS BIGINT) AS weight, count(DISTINCT pre) AS sources, count(DISTINCT post) AS targets, max(w) AS heaviest FROM (SELECT l_suppkey AS pre, l_partkey AS post, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS w FROM lineitem GROUP BY ALL)")
def graph_stats(spark, d):
    g = tables.edges(spark, d).groupBy("pre", "post").agg(F.sum("weight").alias("w"))
    return g.agg(F.count("*").alias("edges"), F.sum("w").alias("weight"), F.countDistinct("pre").alias("sources"), F.countDistinct("post").alias("targets"), F.max("w").alias("heaviest"))


@query(
    sql("wall", "SELECT node, min(root) AS component FROM r GROUP BY node").replace(
        "WITH ", "WITH RECURSIVE ", 1
    ).replace(" SELECT node, min", ", e AS (SELECT dim AS a, 1000 + cell AS b FROM wall WHERE w >= 150), n AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e), r(node, root) AS (SELECT u, u FROM n UNION SELECT v, root FROM r JOIN n ON node = u) SELECT node, min")
)
def wcc(spark, d):
    """Weakly connected components: labels fall to the smallest neighbour's label, and to their label's label."""
    from sparsewing.operators.graph import components

    x = measured(spark, d, 150)
    return components(x.select(F.col("dim").alias("u"), (F.col("cell") + 1000).alias("v")))


@query()
def wcc_all(spark, d):
    """Weakly connected components of the whole graph: every entry counts, whatever its weight. Nodes as in ``wcc``."""
    from sparsewing.operators.graph import components

    x = measured(spark, d, 1)
    return components(x.select(F.col("dim").alias("u"), (F.col("cell") + 1000).alias("v")))


# ---------------------------------------------------------------- generators
def parts(spark, d):
    """A cell for every part."""
    return tables.table(spark, d, "part").select(F.col("p_partkey").alias("cell"))


def _drawn_sql(tag: str, dims: str, n: int) -> str:
    return f"SELECT dim, cell, CAST(1 AS BIGINT) AS w FROM (SELECT cell, dim, row_number() OVER (PARTITION BY cell ORDER BY md5('{tag}:' || dim || ':' || cell), dim) AS r FROM (SELECT DISTINCT p_partkey AS cell FROM part), {dims}) WHERE r <= {n}"


@query(_drawn_sql("w:7", "range(64) b(dim)", 6))
def fly_wiring(spark, d):
    return w.fly(spark, 64, parts(spark, d), 7)


@query(_drawn_sql("w:8", "range(25) b(dim)", S))
def uniform_inputs(spark, d):
    return w.uniform(spark, 25, parts(spark, d), S, 8)


@query(
    sql(
        "w50",
        "SELECT n.dim, n.cell, o.w FROM (SELECT cell, dim, row_number() OVER (PARTITION BY cell ORDER BY md5('shuf:5:' || dim || ':' || cell), dim) AS r FROM (SELECT DISTINCT cell FROM w50), range(25) b(dim)) n JOIN (SELECT cell, w, row_number() OVER (PARTITION BY cell ORDER BY dim) AS r FROM w50) o ON o.cell = n.cell AND o.r = n.r",
    )
)
def shuffle_inputs(spark, d):
    return w.shuffle_inputs(measured(spark, d), 25, 5)


@query(
    "WITH wf AS (SELECT DISTINCT l_returnflag AS flag, s_nationkey, l_partkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey), t AS (SELECT flag, count(*) AS total FROM wf GROUP BY flag)"
    " SELECT flag, part, CAST(total // 64 + CASE WHEN row_number() OVER (PARTITION BY flag ORDER BY md5('even:3:' || part), part) <= total % 64 THEN 1 ELSE 0 END AS BIGINT) AS share FROM t, range(64) p(part)"
)
def even_split(spark, d):
    """The entries of each flag's wiring over 64 parts."""
    return w.even_splits(by_flag(spark, d).groupBy("flag").agg(F.count("*").alias("total")), 64, ["flag"], 3)


@query(_drawn_sql("deg:6", "(SELECT dim FROM range(64) b(dim) ORDER BY md5('pool:6:' || dim), dim LIMIT 4)", 4))
def degenerate(spark, d):
    return w.degenerate(spark, 64, parts(spark, d), 6, 4, 6)


def _small(spark, d):
    """The heaviest part of the measured wiring, as the SQL of these queries has it; those named ``_all`` take the whole."""
    return measured(spark, d, 100)


_MARGINS = "SELECT draw, 'dim' AS side, dim AS id, count(*) AS n FROM wall, range(3) t(draw) WHERE w >= 100 GROUP BY ALL UNION ALL SELECT draw, 'cell', cell, count(*) FROM wall, range(3) t(draw) WHERE w >= 100 GROUP BY ALL"


@query(sql("wall", _MARGINS))
def curveball_margins(spark, d):
    return generators.margins(generators.curveball(_small(spark, d), 3))


@query(sql("wall", _MARGINS))
def margin_control_margins(spark, d):
    return generators.margins(generators.margin_control(_small(spark, d), 3, False, False))


@query(sql("wall", _MARGINS))
def diversify_margins(spark, d):
    return generators.margins(generators.diversify(_small(spark, d), 3))


@query(sql("wall", "SELECT draw, min(n) AS least, max(n) AS most, CAST(sum(n) AS BIGINT) AS nnz FROM (SELECT draw, r, n // k + CASE WHEN r <= n % k THEN 1 ELSE 0 END AS n FROM (SELECT count(*) AS n, count(DISTINCT dim) AS k FROM wall WHERE w >= 100), range(1, 1000) s(r), range(3) t(draw) WHERE r <= k) GROUP BY draw"))
def balanced_margins(spark, d):
    """Even fan-outs: within one of each other, the same number of entries."""
    x = generators.margins(generators.margin_control(_small(spark, d), 3, False, True)).filter("side = 'dim'")
    return x.groupBy("draw").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("nnz"))


@query(sql("wall", "SELECT draw, cell, CAST(sum(w) AS BIGINT) AS weight FROM wall, range(3) t(draw) WHERE w >= 100 GROUP BY ALL"))
def curveball_weights(spark, d):
    """Weights stay with their cell."""
    return generators.curveball(_small(spark, d), 3).groupBy("draw", "cell").agg(F.sum("w").alias("weight"))


_W50_MARGINS = "SELECT draw, 'dim' AS side, dim AS id, count(*) AS n FROM w50, range(3) t(draw) GROUP BY ALL UNION ALL SELECT draw, 'cell', cell, count(*) FROM w50, range(3) t(draw) GROUP BY ALL"


@query(sql("w50", _W50_MARGINS))
def curveball_margins_all(spark, d):
    """As ``curveball_margins``, over the whole measured wiring."""
    return generators.margins(generators.curveball(measured(spark, d), 3))


@query(sql("w50", _W50_MARGINS))
def margin_control_margins_all(spark, d):
    return generators.margins(generators.margin_control(measured(spark, d), 3, False, False))


@query(sql("w50", _W50_MARGINS))
def diversify_margins_all(spark, d):
    return generators.margins(generators.diversify(measured(spark, d), 3))


@query(sql("w50", "SELECT draw, min(n) AS least, max(n) AS most, CAST(sum(n) AS BIGINT) AS nnz FROM (SELECT draw, r, n // k + CASE WHEN r <= n % k THEN 1 ELSE 0 END AS n FROM (SELECT count(*) AS n, count(DISTINCT dim) AS k FROM w50), range(1, 1000) s(r), range(3) t(draw) WHERE r <= k) GROUP BY draw"))
def balanced_margins_all(spark, d):
    x = generators.margins(generators.margin_control(measured(spark, d), 3, False, True)).filter("side = 'dim'")
    return x.groupBy("draw").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum("n").alias("nnz"))


@query(sql("w50", "SELECT draw, cell, CAST(sum(w) AS BIGINT) AS weight FROM w50, range(3) t(draw) GROUP BY ALL"))
def curveball_weights_all(spark, d):
    return generators.curveball(measured(spark, d), 3).groupBy("draw", "cell").agg(F.sum("w").alias("weight"))


@query()
def curveball_q(spark, d):
    """The co-occurrence statistic of the measured wiring (draw -1) and of random wirings with its margins."""
    w50 = measured(spark, d)
    x = w50.select(F.lit(-1).cast("bigint").alias("draw"), "dim", "cell").unionByName(generators.curveball(w50, 5).select("draw", "dim", "cell"))
    a, b = x.select("draw", "cell", F.col("dim").alias("a")), x.select("draw", "cell", F.col("dim").alias("b"))
    o = a.join(b, ["draw", "cell"]).filter("a < b").groupBy("draw", "a", "b").count()
    return o.groupBy("draw").agg(F.sum(F.col("count") * F.col("count")).alias("q"))


@query()
def power_allocation(spark, d):
    """Fan-outs by a power of each dimension's variance, for several powers, as one row per power and dimension."""
    import numpy as np

    x = tables.long(tables.items(spark, d)).groupBy("dim").agg(F.var_pop(F.col("v").cast("double")).alias("var")).orderBy("dim").collect()  # a row per dimension
    lam = np.array([r["var"] for r in x])
    rows = [(float(a), i, int(f)) for a in (0.0, 0.5, 1.0, 2.0, float("inf")) for i, f in enumerate(generators.power_allocation(lam, a, np.full(M, S)))]
    return spark.createDataFrame(rows, "alpha double, dim long, fan_out long")


# ---------------------------------------------------------------- margins of one wiring per return flag
_BY_FLAG = "wf AS (SELECT l_returnflag AS flag, CAST(s_nationkey AS BIGINT) AS dim, l_partkey AS cell, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"


def by_flag(spark, d):
    return w.build(tables.edges(spark, d), tables.dims(spark, d), by=["flag"], rows=tables.table(spark, d, "lineitem").count())


def _margins_of(x):
    """(flag, side, id, n) of the wirings (flag, dim, cell)."""
    side = lambda c: x.groupBy("flag", F.lit(c).alias("side"), F.col(c).alias("id")).agg(F.count("*").alias("n"))
    return side("dim").unionByName(side("cell"))


def _realised(spark, d):
    """Two wirings of the margins of each flag's; a line gives one entry of each at most."""
    x = generators.realise(_margins_of(by_flag(spark, d)), 2, sweeps=2, by=["flag"])
    return w.dealt(x, 2 * tables.table(spark, d, "lineitem").count())


@query(f"WITH {_BY_FLAG} SELECT flag, draw, side, id, count(*) AS n FROM (SELECT flag, 'dim' AS side, dim AS id FROM wf UNION ALL SELECT flag, 'cell', cell FROM wf), range(2) t(draw) GROUP BY ALL")
def realised_margins(spark, d):
    """Random wirings made from the margins of each flag's wiring alone have those margins."""
    x = _realised(spark, d)
    side = lambda c: x.groupBy("flag", "draw", F.lit(c).alias("side"), F.col(c).alias("id")).agg(F.count("*").alias("n"))
    return side("dim").unionByName(side("cell"))


@query(f"WITH {_BY_FLAG} SELECT flag, draw, count(*) AS entries, count(*) AS distinct_entries FROM wf, range(2) t(draw) GROUP BY ALL")
def realised_entries(spark, d):
    """... and no entry twice."""
    x = _realised(spark, d)
    return x.groupBy("flag", "draw").agg(F.count("*").alias("entries"), F.count_distinct("dim", "cell").alias("distinct_entries"))


_FOLDED = f"""
WITH {_BY_FLAG},
f0 AS (SELECT flag, dim, count(*) AS n FROM wf GROUP BY ALL),
f1 AS (SELECT flag, n, row_number() OVER (PARTITION BY flag ORDER BY n DESC, dim) AS r, count(*) OVER (PARTITION BY flag) AS k FROM f0),
f AS (SELECT flag, 'as_is' AS form, n FROM f0 UNION ALL SELECT a.flag, 'folded', CASE WHEN 2 * a.r > a.k + 1 THEN 0 WHEN 2 * a.r = a.k + 1 THEN a.n ELSE a.n + b.n END FROM f1 a JOIN f1 b ON a.flag = b.flag AND b.r = a.k + 1 - a.r),
p AS (SELECT flag, form, row_number() OVER o AS r, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS pre FROM f WINDOW o AS (PARTITION BY flag, form ORDER BY n DESC)),
c AS (SELECT flag, n, count(*) AS many FROM (SELECT flag, cell, count(*) AS n FROM wf GROUP BY ALL) GROUP BY ALL),
b AS (SELECT p.flag, form, r, pre, sum(least(n, r) * many) AS bound FROM p JOIN c USING (flag) GROUP BY ALL)
SELECT flag, form, CAST(max(pre) AS BIGINT) AS entries, CAST(max(pre - bound) AS BIGINT) AS excess, bool_and(pre <= bound) AS feasible FROM b GROUP BY ALL
"""


@query(_FOLDED)
def gale_ryser(spark, d):
    """Whether a wiring exists with the fan-outs of a flag's wiring, and with those folded onto the larger half of its dims."""
    x = by_flag(spark, d)
    fan = x.groupBy("flag", "dim").agg(F.count("*").alias("n"))
    o = Window.partitionBy("flag")
    ranked = fan.withColumns({"r": F.row_number().over(o.orderBy(F.col("n").desc(), "dim")), "k": F.count("*").over(o)})
    other = ranked.select("flag", (F.col("k") + 1 - F.col("r")).alias("r"), F.col("n").alias("m"))
    place = 2 * F.col("r") - F.col("k") - 1
    folded = ranked.join(other, ["flag", "r"]).select("flag", F.lit("folded").alias("form"), F.when(place > 0, 0).when(place == 0, F.col("n")).otherwise(F.col("n") + F.col("m")).alias("n"))
    return w.feasible(fan.select("flag", F.lit("as_is").alias("form"), "n").unionByName(folded), x.groupBy("flag", "cell").agg(F.count("*").alias("n")), ["flag"], ["flag", "form"])


_ALPHAS = (-0.5, 0.0, 0.5, 1.0, 2.0)
_LAM = f"{_BY_FLAG}, lam AS (SELECT flag, dim, var_pop(CAST(w AS DOUBLE)) AS lam FROM wf GROUP BY ALL)"


def _allocated(spark, d, alphas):
    x = by_flag(spark, d)
    lam = x.groupBy("flag", "dim").agg(F.var_pop(F.col("w").cast("double")).alias("lam"))
    return generators.allocations(lam, x.groupBy("flag", "cell").agg(F.count("*").alias("n")), list(alphas), ["flag"], part=1.0), x


@query(
    f"""
WITH {_LAM},
o AS (SELECT flag, alpha, dim, row_number() OVER p AS k, pow(greatest(lam, 1e-300), alpha) AS wt FROM lam, (SELECT unnest([{", ".join(f"{a!r}::DOUBLE" for a in _ALPHAS)}]) AS alpha) WINDOW p AS (PARTITION BY flag, alpha ORDER BY CASE WHEN alpha > 0 THEN -lam WHEN alpha < 0 THEN lam END, dim)),
c AS (SELECT flag, n, count(*) AS many FROM (SELECT flag, cell, count(*) AS n FROM wf GROUP BY ALL) GROUP BY ALL),
z AS (SELECT flag, sum(n * many) AS total, sum(many) AS cells FROM c GROUP BY flag),
m AS (SELECT c.flag, k, least(sum(least(n, k) * many), k * any_value(cells), any_value(total)) AS most FROM c JOIN z USING (flag), range(1, 26) t(k) GROUP BY c.flag, k UNION ALL SELECT flag, 0, 0 FROM z),
s AS (SELECT flag, alpha, dim, k, wt, sum(wt) OVER (PARTITION BY flag, alpha ORDER BY k) AS upto FROM o),
pt AS (SELECT s.flag, alpha, m.k, upto, most FROM s JOIN m ON m.flag = s.flag AND m.k = s.k UNION ALL SELECT DISTINCT flag, alpha, 0, 0.0, 0 FROM s),
sl AS (SELECT a.flag, a.alpha, a.k AS a, b.k AS b, (b.most - a.most) / (b.upto - a.upto) AS slope FROM pt a JOIN pt b ON a.flag = b.flag AND a.alpha = b.alpha AND a.k < b.k),
lo AS (SELECT flag, alpha, a, b AS k, min(slope) OVER (PARTITION BY flag, alpha, a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least FROM sl),
hi AS (SELECT flag, alpha, k, max(least) AS slope FROM (SELECT flag, alpha, g.k, max(least) AS least FROM lo l JOIN (SELECT unnest(range(1, 26)) AS k) g ON l.a < g.k AND l.k = g.k GROUP BY ALL) GROUP BY ALL)
SELECT s.flag, s.alpha, s.dim, round(wt * slope, 4) AS share FROM s JOIN hi USING (flag, alpha, k)
"""
)
def allocation_shares(spark, d):
    """Fan-outs in proportion to a power of each dim's variance, as far as the cells of a flag's wiring allow. In SQL: the slope of
    the greatest convex line at a dim is the largest, over starts before it, of the smallest slope to an end after it."""
    return _allocated(spark, d, _ALPHAS)[0].select("flag", "alpha", "dim", F.round("share", 4).alias("share"))


@query(f"WITH {_LAM}, a AS (SELECT unnest([{', '.join(f'{a!r}::DOUBLE' for a in _ALPHAS)}, 'infinity'::DOUBLE]) AS alpha) SELECT flag, alpha, CAST(count(*) AS BIGINT) AS entries, true AS within_cells, true AS feasible, true AS in_order, true AS near_share FROM wf, a GROUP BY ALL")
def allocation_checks(spark, d):
    """Whole fan-outs hold all entries, at most every cell once a dim, in the order of the spectrum, and a wiring with them exists."""
    got, x = _allocated(spark, d, (*_ALPHAS, float("inf")))
    cells = x.groupBy("flag", "cell").agg(F.count("*").alias("n"))
    ok = w.feasible(got.select("flag", "alpha", F.col("fan_out").alias("n")), cells, ["flag"], ["flag", "alpha"])
    lam = x.groupBy("flag", "dim").agg(F.var_pop(F.col("w").cast("double")).alias("lam"))
    heavy = F.col("lam") * F.signum("alpha")
    before = F.min("fan_out").over(Window.partitionBy("flag", "alpha").orderBy(heavy.desc(), F.col("fan_out").desc()).rowsBetween(Window.unboundedPreceding, -1))
    rows = got.join(lam, ["flag", "dim"]).join(cells.groupBy("flag").agg(F.count("*").alias("m")), "flag").withColumn("before", before)
    each = rows.groupBy("flag", "alpha").agg(
        F.every(F.col("fan_out") <= F.col("m")).alias("within_cells"), F.every(F.coalesce(F.col("fan_out") <= F.col("before"), F.lit(True))).alias("in_order"), F.every(F.abs(F.col("fan_out") - F.col("share")) < 2).alias("near_share"),
    )
    return each.join(ok, ["flag", "alpha"]).select("flag", "alpha", "entries", "within_cells", "feasible", "in_order", "near_share")
