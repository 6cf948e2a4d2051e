"""Connected components by contraction, as DataFrame joins and aggregations only.

In each round every node moves to the smallest of itself and its neighbours, edges are carried over to the new ends, and
loops and repeats drop out. Nodes compare by a hash first, so on chains and trees of any numbering about half of them or
more vanish in a round, and the rounds grow with the logarithm of the size. Minima are combined before each shuffle, so
a node with a third of all edges costs no task more than its share; the edges of a round are cut off from their history by a reliable
checkpoint, and the moves of a round are made from them whenever they are needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewing.llm.common import checkpoint


def _pairs(e: DataFrame) -> DataFrame:
    e = e.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    return checkpoint(e.groupBy("u", "v").agg(F.lit(1).alias("one")).select("u", "v"))


def components(edges: DataFrame, u: str = "u", v: str = "v", hashed: bool = False) -> DataFrame:
    """``edges``: pairs of comparable ids; direction, repeats and loops do not matter, rows with a null end are left out.
    Returns (node, component): the smallest id that each node with an edge reaches. ``hashed`` says that the ids are
    hashes already. No edges: no rows."""
    tag = (lambda c: F.col(c)) if hashed else (lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id")))
    e = edges.filter(F.col(u).isNotNull() & F.col(v).isNotNull()).select(tag(u).alias("u"), tag(v).alias("v"))
    e, at = _pairs(e), None
    while True:
        ends = F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b"))))
        m = e.select(ends.alias("x")).groupBy("x.a").agg(F.min("x.b").alias("b")).select("a", F.least("a", "b").alias("b"))
        at = m.select(F.col("a").alias("node"), F.col("b").alias("at")) if at is None else at.join(m, F.col("at") == F.col("a"), "left").select("node", F.coalesce("b", "at").alias("at"))
        e = _pairs(e.join(m.select(F.col("a").alias("u"), F.col("b").alias("x")), "u").join(m.select(F.col("a").alias("v"), F.col("b").alias("y")), "v").select(F.col("x").alias("u"), F.col("y").alias("v")))
        if e.isEmpty():
            break
    if hashed:
        return at.select("node", F.col("at").alias("component"))
    at = checkpoint(at.select("node.id", "at"))
    least = at.groupBy("at").agg(F.min("id").alias("component"))
    return at.join(least, "at").select(F.col("id").alias("node"), "component")
