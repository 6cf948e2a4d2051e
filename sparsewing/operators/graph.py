"""Weakly connected components of an edge table, by contraction.

Each node moves to the smallest of its neighbourhood (by a hash, so chains shrink fast), edges follow, loops and repeats go;
both tables of a round are checkpointed, and the rounds end when no edge is left.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the one the context checkpoints to. Only on one
    machine, and where neither is set, a temporary folder is made and set."""
    sc = spark.sparkContext
    at = sc._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not at.isDefined():
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: a cluster needs a folder that all machines share")
        named = named or tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return (named or sc._jsc.sc().getCheckpointDir().get()).rstrip("/")


def reliable(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) to (node, component): the smallest node that each node with an edge reaches."""
    tag = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    e = edges.filter("u is not null and v is not null and u <> v").select(tag("u").alias("u"), tag("v").alias("v"))
    e, at = reliable(e.distinct()), None
    while True:
        both = e.union(e.select("v", "u"))
        m = reliable(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("to")))
        at = m.select(F.col("u").alias("node"), F.col("to").alias("at")) if at is None else at.join(m, F.col("at") == F.col("u"), "left").select("node", F.coalesce("to", "at").alias("at"))
        moved = e.join(m.withColumnRenamed("to", "a"), "u").join(m.select(F.col("u").alias("v"), F.col("to").alias("b")), "v")
        e = reliable(moved.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        if e.isEmpty():
            break
    at = at.select(F.col("node.id").alias("node"), "at")
    return at.join(at.groupBy("at").agg(F.min("node").alias("component")), "at").select("node", "component")
