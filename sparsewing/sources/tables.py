"""Adapters from the warehouse tables to items, weighted edges and response matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsewing.functions import rng, vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, q array of whole numbers, label)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("item_id"), vectors.quantise(F.col("embedding")).alias("q"), F.col("label").cast("bigint").alias("label"))


def long(items_: DataFrame, col: str = "q", value: str = "v") -> DataFrame:
    """One row per item and dimension (from 0)."""
    return items_.select("item_id", F.posexplode(col).alias("dim", value)).withColumn("dim", F.col("dim").cast("bigint"))


def queries_of(items_: DataFrame, n: int = 50, seed: int = 3) -> DataFrame:
    return rng.pick(items_, n, "q", seed, "item_id").select("item_id")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pre, post, weight): suppliers to parts by quantity, one row per line."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_suppkey").alias("pre"), F.col("l_partkey").alias("post"), F.col("l_quantity").cast("bigint").alias("weight"), F.col("l_returnflag").alias("flag"))


def dims(spark: SparkSession, sf_dir: str, region: str | None = None) -> DataFrame:
    """(pre, dim, name): the type of each input node: supplier to nation."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    n = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # 25 and 5 rows by the schema of the benchmark
    if region:
        n = n.filter(F.col("r_name") == region)
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("pre"), F.col("s_nationkey").cast("bigint").alias("dim"), F.col("n_name").alias("name"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item, dim, v): mean value of a user in an event type and hour; what was not measured has no row."""
    e = table(spark, sf_dir, "events")
    dim = F.concat_ws(":", F.col("event_type"), F.hour("ts").cast("string"))
    return e.groupBy(F.col("user_id").alias("item"), dim.alias("dim")).agg(F.avg("value").alias("v"))
