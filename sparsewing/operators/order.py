"""Places and running totals over a whole table in a stated order, without sorting it in one task.

Rows are dealt into ranges of the order and sorted within them; a range's total goes to the ranges after it by way of one row
per range. The dealt rows are checkpointed, so that ranges are the same for the totals and for the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparsewing.operators.graph import reliable


def running(df: DataFrame, order: list, value: str, out: str) -> DataFrame:
    """``df`` with the total of ``value`` over the rows before each row in ``order``, which must tell all rows apart."""
    dealt = reliable(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    per = dealt.groupBy("_range").agg(F.sum(value).alias("_all"))
    before = F.coalesce(F.sum("_all").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.select("_range", before.alias("_before"))  # a row per range
    own = F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.join(F.broadcast(per), "_range").withColumn(out, own - F.col(value) + F.col("_before")).drop("_range", "_before")


def place(df: DataFrame, order: list, out: str) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 1 on."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out).withColumn(out, F.col(out) + 1).drop("_one")


def average_places(df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with the mean place of the rows that share a row's value of ``col``: equal values are counted first, and only their
    counts are put in order. Nulls come first."""
    count = running(df.groupBy(col).agg(F.count("*").alias("_n")), [F.col(col)], "_n", "_upto")
    mean = count.select(F.col(col).alias("_v"), (F.col("_upto") + (F.col("_n") + 1) / 2).alias(out))
    return df.join(mean, df[col].eqNullSafe(mean["_v"])).drop("_v")
