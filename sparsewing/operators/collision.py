"""Collision curves: how the overlap of two codes falls with the angle of their items."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparsewing.functions import rng, vectors
from sparsewing.operators import learn, order


def distinct_pairs(near: DataFrame, items: DataFrame, draws: int, seed: int) -> DataFrame:
    """Unordered pairs (a, b): neighbours (query_id, item_id) and, for every item, ``draws`` items drawn by position."""
    n = items.count()
    pos = order.place(items.select("item_id"), ["item_id"], "pos").withColumn("pos", F.col("pos") - 1)
    d = items.select("item_id", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")).withColumn("pos", rng.integer(n, "pair", seed, "item_id", "draw"))
    r = d.join(pos.withColumnRenamed("item_id", "b"), "pos").select(F.col("item_id").alias("a"), "b")
    p = near.select(F.col("query_id").alias("a"), F.col("item_id").alias("b")).union(r).filter("a <> b")
    return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def with_vectors(pairs: DataFrame, items: DataFrame, col: str = "q") -> DataFrame:
    return pairs.join(items.select(F.col("item_id").alias("a"), F.col(col).alias("x")), "a").join(items.select(F.col("item_id").alias("b"), F.col(col).alias("y")), "b")


def angles(pairs: DataFrame, items: DataFrame) -> DataFrame:
    return with_vectors(pairs, items).select("a", "b", F.round(vectors.angle(F.col("x"), F.col("y")), 6).alias("angle"))


def pair_overlap(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Share of a's winners that b has. sets: (item_id, cells)."""
    p = pairs.join(sets.select(F.col("item_id").alias("a"), F.col("cells").alias("ca")), "a").join(sets.select(F.col("item_id").alias("b"), F.col("cells").alias("cb")), "b")
    return p.select("a", "b", F.round(F.size(F.array_intersect("ca", "cb")) / F.size("ca"), 9).alias("overlap"))


def curve(valued: DataFrame, width: float) -> DataFrame:
    """(angle, value) to non-empty bins: lower edge, mean angle, mean value, count."""
    return valued.groupBy((F.floor(F.col("angle") / width) * width).cast("double").alias("lower")).agg(F.round(F.avg("angle"), 6).alias("mean_angle"), F.round(F.avg("value"), 9).alias("mean_value"), F.count("*").alias("pairs"))


def theta_half(bins: DataFrame, least: int = 1, level: float = 0.5) -> DataFrame:
    """First downward crossing of the level between neighbouring retained bins, by linear interpolation; how many crossings;
    and a status: ok, no_bins, below_range (the first bin is below already), above_range (never below)."""
    b = bins.filter(F.col("pairs") >= least)
    w = Window.orderBy("mean_angle")
    n = b.withColumns({"na": F.lead("mean_angle").over(w), "nv": F.lead("mean_value").over(w)})
    down = (F.col("mean_value") >= level) & (F.col("nv") < level)
    at = F.col("mean_angle") + (F.col("mean_value") - level) / (F.col("mean_value") - F.col("nv")) * (F.col("na") - F.col("mean_angle"))
    g = n.agg(F.count("*").alias("n"), F.count_if(down).alias("crossings"), F.min_by(F.when(down, at), F.when(down, F.col("mean_angle"))).alias("theta"), F.min_by("mean_value", "mean_angle").alias("first"))
    status = F.when(F.col("n") == 0, "no_bins").when(F.col("first") < level, "below_range").when(F.col("crossings") > 0, "ok").otherwise("above_range")
    return g.select(status.alias("status"), "crossings", "theta").withColumn("theta", F.when(F.col("status") == "ok", F.round("theta", 6)))


def fit_c(points: DataFrame) -> DataFrame:
    """Least relative squares of theta = c * t: (theta, t)."""
    return points.agg(F.round(F.sum(F.col("theta") / F.col("t")) / F.sum(1 / (F.col("t") * F.col("t"))), 9).alias("c"))


def participation(items: DataFrame, col: str = "q") -> DataFrame:
    """(tr C)^2 / tr(C^2) of the covariance, from a matrix of products per task, which the ratio does not need scaled."""
    spark = items.sparkSession
    head = items.select(F.size(col).alias("d")).first()
    if head is None:
        return spark.createDataFrame([(None,)], "participation double")
    _, _, c = learn.moments(items, head.d, col)
    sq = float((c * c).sum())
    return spark.createDataFrame([(round(float(np.trace(c)) ** 2 / sq, 6) if sq else None,)], "participation double")


def median_angle(truth: DataFrame, items: DataFrame) -> DataFrame:
    p = with_vectors(truth.select(F.col("query_id").alias("a"), F.col("item_id").alias("b")), items)
    return p.select(F.round(vectors.angle(F.col("x"), F.col("y")), 6).alias("angle")).agg(F.round(F.expr("percentile(angle, 0.5)"), 4).alias("median_angle"))
