"""Made data from digests: exponential and gamma draws, distinct choices, Dirichlet mixtures, spectra that fall by a power.

Every draw is an expression over the md5 of its name, so it is the same for any partitioning and in any engine that has md5 and
a logarithm, and nothing is drawn on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparsewing.functions import rng
from sparsewing.operators import wiring

BILLION, MILLION = 1_000_000_000, 1_000_000


def exponential(tag: str, *parts) -> Column:
    """A draw with mean one, in billionths: -log of the first 32 bits of the digest, which count from 1 to 2**32."""
    h = F.conv(F.substring(rng.digest(tag, *parts), 1, 8), 16, 10).cast("bigint") + 1
    return F.floor(-F.log(h / F.lit(4294967296.0)) * BILLION).cast("bigint")


def gamma(shape: int, tag: str, *parts) -> Column:
    """A gamma draw of whole shape, in billionths: the sum of so many exponential ones."""
    if shape < 1:
        raise ValueError("a whole shape of at least 1 is needed")
    total = exponential(tag, *parts, 0)
    for i in range(1, shape):
        total = total + exponential(tag, *parts, i)
    return total


def chosen(n: Column, k: Column, most: int, tag: str, *parts) -> Column:
    """``k`` (at most ``most``) different positions in 0..n-1, every set alike: for each of the last k positions, a draw up to it, or
    the position itself where the draw was taken before (Floyd's sampling)."""
    got = F.array().cast("array<bigint>")
    for i in range(most):
        last = (n - k + i).cast("bigint")
        t = rng.integer(F.greatest(last + 1, F.lit(1)), tag, *parts, i)
        got = F.when(k > i, F.concat(got, F.array(F.when(F.array_contains(got, t), last).otherwise(t)))).otherwise(got)
    return got


def dirichlet(mixes: DataFrame, n: int, lo: int = 2, hi: int = 5, shape: int = 1, seed: int = 0) -> DataFrame:
    """(mix, pos, part, weight): for each mix, ``lo`` to ``hi`` different positions of n with Dirichlet weights in millionths, rounded
    down: gamma draws over their sum."""
    k = F.least(F.lit(lo) + rng.integer(hi - lo + 1, "mixk", seed, "mix"), F.lit(n))
    x = mixes.select("mix", k.cast("int").alias("k")).select("mix", F.posexplode(chosen(F.lit(n), F.col("k"), hi, "mixp", seed, "mix")).alias("pos", "part"))
    x = x.withColumn("g", gamma(shape, "mixg", seed, "mix", "pos"))
    from pyspark.sql import Window

    whole = F.sum("g").over(Window.partitionBy("mix"))  # at most ``hi`` rows
    return x.select("mix", "pos", "part", F.floor(F.col("g").cast("decimal(38,0)") * MILLION / whole).cast("bigint").alias("weight"))


def mixtures(items: DataFrame, n: int, lo: int = 2, hi: int = 5, shape: int = 1, seed: int = 0, col: str = "q") -> tuple[DataFrame, DataFrame]:
    """(mix, item_id, weight) and (mix, dim, v) of ``n`` mixtures of different items. Items are numbered by their ids; a mixture's
    values are sums over its few parts."""
    spark = items.sparkSession
    named = wiring.dense_index(items.select("item_id"), "item_id", "part")
    parts = dirichlet(spark.range(n).withColumnRenamed("id", "mix"), items.select("item_id").distinct().count(), lo, hi, shape, seed).join(named, "part").select("mix", "item_id", "weight")
    v = parts.join(items.select("item_id", F.posexplode(col).alias("dim", "x")), "item_id").groupBy("mix", F.col("dim").cast("bigint").alias("dim")).agg(F.sum(F.col("weight") * F.col("x")).alias("v"))
    return parts, v


def power_law(spark, n: int, dims: int, beta: float, seed: int = 0) -> DataFrame:
    """(item_id, q): independent values close to normal, whose deviation in dim j (from 0) falls as (j + 1) ** (-beta / 2)."""
    scaled = [F.round(rng.gaussian("law", seed, "item_id", j) * float((j + 1) ** (-beta / 2))).cast("bigint") for j in range(dims)]
    return spark.range(n).withColumnRenamed("id", "item_id").select("item_id", F.array(*scaled).alias("q"))
