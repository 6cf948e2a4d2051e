"""Nearest neighbours: exact ones by distance, and ranked ones by code overlap or scores, under explicit tie rules.

A stated, bounded set of queries meets all items: the queries are the broadcast side, items are never joined with themselves,
and ``row_number() <= n`` keeps n rows per query and task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparsewing.functions import rng, vectors
from sparsewing.operators.encode import BROADCAST_ROWS

MAX_QUERIES = 100_000


def pairs(items: DataFrame, queries: DataFrame, col: str = "q") -> DataFrame:
    """(query_id, item_id, x, y) for every query and every other item."""
    q = check_queries(queries).select("item_id").join(items.select("item_id", col), "item_id").select(F.col("item_id").alias("query_id"), F.col(col).alias("x"))
    return items.select("item_id", F.col(col).alias("y")).join(F.broadcast(q), F.col("item_id") != F.col("query_id"))


def first(scored: DataFrame, n: int, *order: Column) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order)
    return scored.withColumn("rnk", F.row_number().over(w).cast("bigint")).filter(F.col("rnk") <= n)


def truth(items: DataFrame, queries: DataFrame, n: int, metric: str = "euclidean", col: str = "q") -> DataFrame:
    """(query_id, rnk, item_id, d): ``euclidean`` and ``normalised`` (unit-mean vectors) use whole numbers, ``angular`` the
    cosine rounded to 12 digits; ties go to the smaller id."""
    if metric == "normalised":
        unit = F.transform(vectors.unit_mean(F.col(col)), lambda v: F.round(v * 1000).cast("bigint"))
        items = items.select("item_id", unit.alias(col))
    p = pairs(items, queries, col)
    d = F.round(-vectors.cosine(F.col("x"), F.col("y")), 12) if metric == "angular" else vectors.sqdist(F.col("x"), F.col("y"))
    return first(p.select("query_id", "item_id", d.alias("d")), n, F.col("d"), F.col("item_id")).select("query_id", "rnk", "item_id", "d")


def overlap(code: DataFrame, queries: DataFrame, query_code: DataFrame | None = None) -> DataFrame:
    """(query_id, item_id, both): shared winners through the inverted index on cells; pairs without any have no row.
    ``query_code``: the codes of the queries where they were made on their own, so that the items are encoded once."""
    own = code.join(queries.select("item_id"), "item_id", "left_semi") if query_code is None else query_code
    q = own.select(F.col("item_id").alias("query_id"), "cell")
    return code.select("item_id", "cell").join(q, "cell").filter("item_id <> query_id").groupBy("query_id", "item_id").agg(F.count("*").alias("both"))


def hamming(code: DataFrame, queries: DataFrame, items: DataFrame, n: int, seed: int = 5, shared_order: bool = False, size: int | None = None, query_code: DataFrame | None = None) -> DataFrame:
    """Ranking by the size of the symmetric difference; equal distances in the order of a digest of (query, item), or of the
    item alone. Items that share no winner with a query take part with their full distance. ``size`` says that all codes have
    so many winners, which saves counting them."""
    every = items.select("item_id").join(F.broadcast(check_queries(queries).select(F.col("item_id").alias("query_id"))), F.col("item_id") != F.col("query_id"))
    s = every.join(overlap(code, queries, query_code), ["query_id", "item_id"], "left")
    if size is None:
        k = code.groupBy("item_id").agg(F.count("*").alias("k"))
        s = s.join(k, "item_id", "left").join(k.select(F.col("item_id").alias("query_id"), F.col("k").alias("kq")), "query_id", "left")
    else:
        s = s.withColumns({"k": F.lit(size), "kq": F.lit(size)})
    d = F.coalesce("k", F.lit(0)) + F.coalesce("kq", F.lit(0)) - 2 * F.coalesce("both", F.lit(0))
    tie = rng.digest("tie", seed, "item_id") if shared_order else rng.digest("tie", seed, "query_id", "item_id")
    return first(s.select("query_id", "item_id", d.cast("bigint").alias("d")), n, F.col("d"), tie, F.col("item_id")).select("query_id", "rnk", "item_id", "d")


def by_score(scored: DataFrame, n: int, seed: int = 5) -> DataFrame:
    """Ranking by a score, largest first, equal scores by digest."""
    return first(scored, n, F.col("s").desc(), rng.digest("tie", seed, "query_id", "item_id"), F.col("item_id")).select("query_id", "rnk", "item_id", "s")


def asymmetric(code: DataFrame, y: DataFrame, queries: DataFrame, weight: Column | None = None) -> DataFrame:
    """(query_id, item_id, s): the query's drives summed over the item's winners, or weighted by ``weight`` of the code row. The
    drives of the queries, a stated set, go to every task, so an item's sums are complete where its code is made, and only
    they are shuffled."""
    q = y.join(queries.select("item_id"), "item_id", "left_semi").select(F.col("item_id").alias("query_id"), "cell", F.col("y").alias("u"))
    c = code.select("item_id", "cell", (F.lit(1) if weight is None else weight).alias("b"))
    return c.join(F.broadcast(q), "cell").filter("item_id <> query_id").groupBy("query_id", "item_id").agg(F.sum(F.col("u") * F.col("b")).alias("s"))  # queries x cells


def candidates(*predictions: DataFrame) -> DataFrame:
    out = predictions[0].select("query_id", "item_id")
    for p in predictions[1:]:
        out = out.union(p.select("query_id", "item_id"))
    return out.distinct()


def rerank(cand: DataFrame, items: DataFrame, n: int, col: str = "q") -> DataFrame:
    """Candidates in order of their exact distance."""
    c = cand.join(items.select("item_id", F.col(col).alias("y")), "item_id").join(items.select(F.col("item_id").alias("query_id"), F.col(col).alias("x")), "query_id")
    return first(c.select("query_id", "item_id", vectors.sqdist(F.col("x"), F.col("y")).alias("d")), n, F.col("d"), F.col("item_id")).select("query_id", "rnk", "item_id", "d")


def check_queries(queries: DataFrame) -> DataFrame:
    """A query set is stated and bounded; more than MAX_QUERIES are worked off in blocks by the caller."""
    n = queries.limit(MAX_QUERIES + 1).count()
    if n > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries in one block")
    return queries


__all__ = ["BROADCAST_ROWS", "asymmetric", "by_score", "candidates", "check_queries", "first", "hamming", "overlap", "pairs", "rerank", "truth"]
