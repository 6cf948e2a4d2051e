"""Codes and novelty over a stream of item vectors.

Encoding a batch needs no state: drives are summed inside the item's own row, so the stream is a map and each micro-batch writes
its codes once. Cell counts of the stored items are a running aggregate that ``foreachBatch`` folds into a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewing.functions import vectors
from sparsewing.operators.encode import _sums, one_row


def encode_rows(items: DataFrame, wiring: DataFrame, k: int, col: str = "q") -> DataFrame:
    """(item_id, cells): winners of every row of a stream or table of items, from centred values."""
    x = items.withColumn(col, vectors.centre(F.col(col))).crossJoin(one_row(wiring))
    best = F.slice(F.array_sort(F.transform(_sums(col), lambda s: F.struct((-s["y"]).alias("neg"), s["prio"].alias("prio"), s["cell"].alias("cell")))), 1, k)
    return x.select("item_id", F.array_sort(F.transform(best, lambda s: s["cell"])).alias("cells"))


def fold_counts(batch: DataFrame, counts: DataFrame | None) -> DataFrame:
    """Cell counts after one more batch of codes (item_id, cells)."""
    new = batch.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))
    return new if counts is None else counts.unionByName(new).groupBy("cell").agg(F.sum("n").alias("n"))
