"""Retrieval scores of ranked lists, and scores of codes as memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparsewing.operators import order


def hits(pred: DataFrame, true: DataFrame) -> DataFrame:
    """Predictions (query_id, rnk, item_id) with hit 0/1."""
    t = true.select("query_id", "item_id", F.lit(1).alias("h"))
    return pred.select("query_id", "rnk", "item_id").join(t, ["query_id", "item_id"], "left").withColumn("hit", F.coalesce("h", F.lit(0)).cast("bigint")).drop("h")


def scores(pred: DataFrame, true: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """Per query: average precision over n (misses count), over the hits only, and recall. A query without predictions is 0."""
    h = hits(pred.filter(F.col("rnk") <= n), true)
    run = F.sum("hit").over(Window.partitionBy("query_id").orderBy("rnk").rowsBetween(Window.unboundedPreceding, 0))
    s = h.withColumn("p", F.when(F.col("hit") == 1, run / F.col("rnk")).otherwise(0.0)).groupBy("query_id").agg(F.sum("p").alias("p"), F.sum("hit").alias("hits"))
    s = queries.select(F.col("item_id").alias("query_id")).join(s, "query_id", "left")
    p, k = F.coalesce("p", F.lit(0.0)), F.coalesce("hits", F.lit(0)).cast("bigint")
    return s.select("query_id", F.round(p / n, 9).alias("ap"), F.round(p / F.greatest(k, F.lit(1)), 9).alias("ap_retrieved"), F.round(k / n, 9).alias("recall"))


def list_overlap(pred: DataFrame, true: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """Mean over depths 1..n of the share of items that both lists have by that depth."""
    b = pred.filter(F.col("rnk") <= n).select("query_id", "item_id", F.col("rnk").alias("a")).join(true.filter(F.col("rnk") <= n).select("query_id", "item_id", F.col("rnk").alias("b")), ["query_id", "item_id"])
    b = b.withColumn("depth", F.greatest("a", "b"))
    # an item counts at every depth from ``depth`` on: the sum of 1/i there
    at = b.withColumn("i", F.explode(F.sequence(F.col("depth"), F.lit(n).cast("bigint")))).groupBy("query_id", "i").agg(F.count("*").alias("c"))
    s = at.groupBy("query_id").agg(F.sum(F.col("c") / F.col("i")).alias("s"))
    return queries.select(F.col("item_id").alias("query_id")).join(s, "query_id", "left").select("query_id", F.round(F.coalesce("s", F.lit(0.0)) / n, 9).alias("overlap"))


def mean_score(per_query: DataFrame, col: str = "ap", *by: str) -> DataFrame:
    return per_query.groupBy(*by).agg(F.round(F.avg(col), 9).alias(f"mean_{col}"))


def bloom(code: DataFrame, stored: DataFrame, probes: DataFrame) -> DataFrame:
    """Novelty of each probe: mean over its cells of one less the share of stored items that have the cell."""
    n = stored.agg(F.count("*").alias("n"))
    c = code.join(stored.select("item_id"), "item_id", "left_semi").groupBy("cell").agg(F.count("*").alias("c"))
    p = code.join(probes.select("item_id"), "item_id", "left_semi").join(c, "cell", "left").crossJoin(F.broadcast(n))  # one row
    return p.groupBy("item_id").agg(F.round(F.avg(1 - F.coalesce("c", F.lit(0)) / F.col("n")), 9).alias("novelty"))


def class_novelty(code: DataFrame, stored: DataFrame, probes: DataFrame) -> DataFrame:
    """The class whose stored items leave the probe least novel; ties to the smaller class. ``stored``: item_id, label."""
    size = stored.groupBy("label").agg(F.count("*").alias("n"))
    c = code.join(stored.select("item_id", "label"), "item_id").groupBy("label", "cell").agg(F.count("*").alias("c"))
    p = code.join(probes.select("item_id"), "item_id", "left_semi").select("item_id", "cell")
    got = p.join(c, "cell").groupBy("item_id", "label").agg(F.sum("c").alias("c"))
    every = probes.select("item_id").crossJoin(F.broadcast(size))  # a row per class
    s = every.join(got, ["item_id", "label"], "left").withColumn("nov", -(F.coalesce("c", F.lit(0)) / F.col("n")))
    return s.groupBy("item_id").agg(F.min_by("label", F.struct("nov", "label")).alias("pred"))


def auc(scored: DataFrame) -> DataFrame:
    """Area under the curve from ordinal ranks, equal scores counted for the novel side first: (item_id, s, novel)."""
    x = order.place(scored.select("item_id", "s", "novel"), [F.col("s"), F.col("novel").desc(), F.col("item_id")], "r").agg(F.sum(F.when(F.col("novel") == 1, F.col("r"))).alias("rs"), F.count_if(F.col("novel") == 1).alias("a"), F.count_if(F.col("novel") == 0).alias("b"))
    return x.select(F.round((F.col("rs") - F.col("a") * (F.col("a") + 1) / 2) / (F.col("a") * F.col("b")), 9).alias("auc"))
