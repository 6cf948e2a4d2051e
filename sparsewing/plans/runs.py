"""Resumable runs: a ledger of finished units, so that a sweep goes on where it stopped.

A unit is a row of the design; its key is a digest of the design's values and of a version, and finished units are rows of a
Parquet table in the run's folder. A run with another version has other keys and starts afresh.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def design(spark: SparkSession, version: str, **sweep: list) -> DataFrame:
    """All combinations of the sweep's values (as strings) with their key."""
    df = spark.range(1).select(F.lit(version).alias("version"))
    for name, values in sorted(sweep.items()):
        df = df.withColumn(name, F.explode(F.array(*[F.lit(str(v)) for v in values])))
    return df.withColumn("unit", F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256))


def pending(units: DataFrame, path: str) -> DataFrame:
    done = finished(units.sparkSession, path)
    return units if done is None else units.join(done.select("unit").distinct(), "unit", "left_anti")


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return spark.read.parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else None


def resume(units: DataFrame, path: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs ``work`` (units to rows with a column ``unit``) on what is left, appends the rows, and returns all of them. The
    writer commits a run's rows at once, so a broken run leaves nothing that would count as finished."""
    left = pending(units, path)
    if not left.isEmpty():
        work(left).write.mode("append").parquet(path)
    return units.select("unit").join(finished(units.sparkSession, path), "unit")


def fingerprint(df: DataFrame, *parts) -> str:
    """A digest of a table's rows, whatever their order and partitions, and of the given parts: how many rows there are, and
    the sums and differences of two independent hashes of each."""
    cols = [F.col(c) for c in sorted(df.columns)]
    wide = lambda h: h.cast("decimal(38,0)")
    a, b = F.xxhash64(*cols), F.xxhash64(F.lit("b"), *cols)
    r = df.agg(F.count("*").alias("n"), F.sum(wide(a)).alias("a"), F.sum(wide(b)).alias("b"), F.bit_xor(a).alias("x"), F.bit_xor(b).alias("y")).first()
    return hashlib.sha256("|".join(map(str, [sorted(df.columns), *r, *parts])).encode()).hexdigest()


def kept(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table kept under ``key`` in ``folder``; where there is none, ``make`` makes it. A table counts once its writer has
    committed, so one left half-written by a broken run is written anew."""
    path = f"{folder.rstrip('/')}/{key}"
    if finished(spark, path) is None:
        make().write.mode("overwrite").parquet(path)
    return finished(spark, path)


def report(rows: DataFrame, keys: list[str], value: str, most: int = 1000) -> str:
    """A Markdown table of means and deviations; at most ``most`` groups are rendered."""
    g = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n")).orderBy(*keys).limit(most).collect()
    head = "| " + " | ".join([*keys, "mean", "SD", "n"]) + " |\n|" + "---|" * (len(keys) + 3)
    line = lambda r: "| " + " | ".join([*(str(r[k]) for k in keys), f"{r['mean']:.4f}", "-" if r["sd"] is None else f"{r['sd']:.4f}", str(r["n"])]) + " |"
    return "\n".join([head, *map(line, g)])
