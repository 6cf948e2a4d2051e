"""Queries of the collision law: pairs, angles, overlaps, and where a curve falls to one half."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from sparsewing.catalog import query
from sparsewing.operators import collision as c, encode as e, generators, pairmodel
from sparsewing.operators.graph import reliable
from sparsewing.plans.codes import coded
from sparsewing.plans.retrieval import truth
from sparsewing.plans.wirings import by_flag
from sparsewing.plans.sql import K, sql
from sparsewing.sources import tables

_PAIRS = 'SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT query_id AS a, item_id AS b FROM true UNION ALL SELECT d.item_id, p.item_id FROM (SELECT item_id, CAST(\'0x\' || substr(md5(\'pair:6:\' || item_id || \':\' || draw), 1, 8) AS BIGINT) % (SELECT count(*) FROM items) AS pos FROM items, range(4) t(draw)) d JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM items) p USING (pos)) WHERE a <> b'
_COS = "CAST(list_sum(list_transform(list_zip(x.q, y.q), lambda t: t[1] * t[2])) AS DOUBLE) / (sqrt(CAST(list_sum(list_transform(x.q, lambda v: v * v)) AS DOUBLE)) * sqrt(CAST(list_sum(list_transform(y.q, lambda v: v * v)) AS DOUBLE)))"
_ANGLES = f"SELECT a, b, round(degrees(2 * asin(least(1.0, sqrt(greatest(0.0, 2.0 - 2.0 * {_COS})) / 2))), 6) AS angle FROM ({_PAIRS}) p JOIN items x ON x.item_id = a JOIN items y ON y.item_id = b"
_OVER = f"SELECT a, b, round(count(v.cell) / {K}.0, 9) AS overlap FROM ({_PAIRS}) p JOIN code u ON u.item_id = a LEFT JOIN code v ON v.item_id = b AND v.cell = u.cell GROUP BY a, b"
_CURVE = f"SELECT CAST(floor(angle / 5.0) * 5.0 AS DOUBLE) AS lower, round(avg(angle), 6) AS mean_angle, round(avg(overlap), 9) AS mean_value, count(*) AS pairs FROM ({_ANGLES}) s JOIN ({_OVER}) o USING (a, b) GROUP BY 1"


def pairs(spark, d):
    return c.distinct_pairs(truth(spark, d).select("query_id", "item_id"), tables.items(spark, d).select("item_id"), 4, 6)


def _angles(spark, d):
    return c.angles(pairs(spark, d), tables.items(spark, d))


def _overlaps(spark, d):
    return c.pair_overlap(pairs(spark, d), e.as_sets(coded(spark, d)))


def _bins(spark, d):
    x = _angles(spark, d).join(_overlaps(spark, d), ["a", "b"])
    return c.curve(x.select("angle", F.col("overlap").alias("value")), 5.0)


@query(sql("true items", _PAIRS))
def pairs_distinct(spark, d):
    return pairs(spark, d)


@query(sql("true items", _ANGLES))
def angles(spark, d):
    return _angles(spark, d)


@query(sql("true items code", _OVER))
def pair_overlap(spark, d):
    return _overlaps(spark, d)


@query(sql("true items code", _CURVE))
def bin_curve(spark, d):
    return _bins(spark, d)


_HALF = "SELECT CASE WHEN arg_min(mean_value, mean_angle) >= 0.04 THEN round(arg_min(x, mean_angle) FILTER (down), 6) END AS theta, count(*) FILTER (down) AS crossings, CASE WHEN count(*) = 0 THEN 'no_bins' WHEN arg_min(mean_value, mean_angle) < 0.04 THEN 'below_range' WHEN count(*) FILTER (down) > 0 THEN 'ok' ELSE 'above_range' END AS status FROM (SELECT *, mean_value >= 0.04 AND nv < 0.04 AS down, mean_angle + (mean_value - 0.04) / (mean_value - nv) * (na - mean_angle) AS x FROM (SELECT *, lead(mean_angle) OVER (ORDER BY mean_angle) AS na, lead(mean_value) OVER (ORDER BY mean_angle) AS nv FROM ({}) WHERE pairs >= 5))"


@query(sql("true items code", _HALF.format(_CURVE)))
def theta_half(spark, d):
    """Where the curve falls through a level (0.04 here: items of the table are nearly orthogonal)."""
    return c.theta_half(_bins(spark, d), 5, 0.04)


@query(sql("true items code", f"SELECT round(sum(mean_angle / lower) / sum(1 / (lower * lower)), 9) AS c FROM ({_CURVE}) WHERE lower > 0"))
def fit_c(spark, d):
    return c.fit_c(_bins(spark, d).filter("lower > 0").select(F.col("mean_angle").alias("theta"), F.col("lower").alias("t")))


@query(sql("long", "SELECT round(tr * tr / sq, 6) AS participation FROM (SELECT sum(c) FILTER (i = j) AS tr, sum(c * c * CASE WHEN i = j THEN 1 ELSE 2 END) AS sq FROM (SELECT a.dim AS i, b.dim AS j, covar_samp(CAST(a.v AS DOUBLE), CAST(b.v AS DOUBLE)) AS c FROM long a JOIN long b ON a.item_id = b.item_id AND a.dim <= b.dim GROUP BY ALL))"))
def participation_ratio(spark, d):
    return c.participation(tables.items(spark, d))


@query(sql("true items", f"SELECT round(quantile_cont(angle, 0.5), 4) AS median_angle FROM (SELECT round(degrees(2 * asin(least(1.0, sqrt(greatest(0.0, 2.0 - 2.0 * {_COS})) / 2))), 6) AS angle FROM true t JOIN items x ON x.item_id = t.query_id JOIN items y ON y.item_id = t.item_id)"))
def median_nn_angle(spark, d):
    return c.median_angle(truth(spark, d), tables.items(spark, d))


@query()
def overlap_slope(spark, d):
    """Slope of overlap against angle by least squares, for several numbers of winners."""
    from sparsewing.operators import encode

    rows = None
    for k in (4, 8, K):
        o = c.pair_overlap(pairs(spark, d), encode.as_sets(coded(spark, d).filter(F.col("rnk") <= k)))
        x = _angles(spark, d).join(o, ["a", "b"]).agg(F.round(F.regr_slope("overlap", "angle"), 9).alias("slope"), F.count("*").alias("pairs")).withColumn("k", F.lit(k))
        rows = x if rows is None else rows.unionByName(x)
    return rows


# ---------------------------------------------------------------- the pair model
_THETAS, _MODEL_KS = [20.0, 40.0], [4, 16]


def _spectra(x):
    """(flag, dim, lam): the variance of the weights of each dim of a flag's wiring."""
    return x.groupBy("flag", "dim").agg(F.var_pop(F.col("w").cast("double")).alias("lam"))


_MODEL = """
, wf AS (SELECT l_returnflag AS flag, CAST(s_nationkey AS BIGINT) AS dim, l_partkey AS cell, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
lam AS (SELECT flag, dim, var_pop(CAST(w AS DOUBLE)) AS lam FROM wf GROUP BY ALL),
rho AS (SELECT flag, dim, lam, d, lam / (lam + d) AS r FROM lam, (SELECT unnest([50.0::DOUBLE, 500.0::DOUBLE]) AS d) WHERE lam > 0)
SELECT flag, d, cell, round(sum(lam), 4) AS v, round(sum(lam * (1 - r + r * r)), 4) AS w, round(sum(lam * r), 4) AS u FROM (SELECT DISTINCT flag, dim, cell FROM wf) JOIN rho USING (flag, dim) GROUP BY flag, d, cell
"""


@query("WITH " + _MODEL.strip().removeprefix(", "))
def pair_moments(spark, d):
    """Variances of every cell's drive for an item and its neighbour, and their covariance, at two distances."""
    x = by_flag(spark, d)
    lam = _spectra(x).withColumn("d", F.explode(F.array(F.lit(50.0), F.lit(500.0))))
    m = pairmodel.cell_moments(x, lam, ["flag"])
    return m.select("flag", "d", "cell", *[F.round(c, 4).alias(c) for c in ("v", "w", "u")])


@query()
def meanfield_slope(spark, d):
    """Expected overlap of the codes of neighbours at two angles under each flag's wiring, and its fall with the distance."""
    x = by_flag(spark, d)
    at = pairmodel.distances(_spectra(x), ["flag"], _THETAS)
    return pairmodel.expected(pairmodel.cell_moments(x, at.select("flag", "dim", "lam", "d"), ["flag"]), ["flag"], _MODEL_KS).select("flag", F.round("d", 6).alias("d"), "k", F.round("overlap", 6).alias("overlap"), F.round("fall", 9).alias("fall"))


@query()
def best_fan_out(spark, d):
    """For each flag's spectrum and inputs per cell, the power of the variances whose fan-outs tell neighbours at 30 degrees apart
    best: fan-outs for every power, two wirings of each, and the mean fall of the expected overlap."""
    x = by_flag(spark, d)
    lam = _spectra(x)
    cells = x.groupBy("flag", "cell").agg(F.count("*").alias("n"))
    alphas = [-1.0, -0.5, 0.0, 0.5, 1.0, 2.0]
    fan = generators.allocations(lam, cells, alphas, ["flag"], part=1.0)
    every = cells.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in alphas])))
    margins = fan.select("flag", "alpha", F.lit("dim").alias("side"), F.col("dim").alias("id"), F.col("fan_out").alias("n")).unionByName(every.select("flag", "alpha", F.lit("cell").alias("side"), F.col("cell").alias("id"), "n"))
    made = generators.realised_bits(margins, 2, sweeps=2, by=["flag", "alpha"])
    if made is None:
        return spark.createDataFrame([], "flag string, k long, alpha double, fall double")
    bits, dims, names = made
    at: dict = {}
    for r in pairmodel.distances(lam, ["flag"], [30.0]).collect():  # a row per dim of a circuit
        at.setdefault(r.flag, {})[r.dim] = (r.lam, r.d)
    flags = {r.g: r.flag for r in names.collect()}
    spectra = [(np.array([at[flags[g]][x][0] for x in own.tolist()]), next(iter(at[flags[g]].values()))[1]) for g, own in enumerate(dims)]
    slopes = pairmodel.expected_of_bits(reliable(bits), 2, spectra, _MODEL_KS).join(F.broadcast(names), "g")  # a row per circuit
    return pairmodel.best_power(slopes, ["flag"]).select("flag", "k", "alpha", F.round("fall", 9).alias("fall"))
