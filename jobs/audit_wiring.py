"""How a weighted wiring depends on the threshold of its entries, one data set (region) beside the other.

    python -m jobs.audit_wiring --edges PATH --nodes PATH --types PATH --sets PATH --output PATH [--config FILE]

Reads the edges (lineitem), the input nodes (supplier), their types (nation) and the sets that the types belong to (region),
sums the edges into wirings, one per set, and writes two tables under ``output``:

* ``wiring``, partitioned by set: (dim, cell, w, partners), every entry from weight 1;
* ``audit``, partitioned by set and threshold: what a threshold keeps of the entries and their weight, the cells and dims that
  are left, inputs per cell, cells with a single input, the spread of the fan-outs and the dim with the largest one,
  and the squares (Q) and four-cycles of shared cells; for Q, the mean, deviation, z and randomization p values against
  ``nulls`` random wirings in which every cell keeps its number of inputs and draws anew which dims they are.

Edges are read once; all thresholds, and all random wirings, are summed in one pass each over the written wiring. The writes replace the partitions that they
have rows for and leave others alone, so a run over some of the sets or thresholds (``regions``, ``thresholds`` in the
config) renews just those, and a rerun gives the same tables. A set without entries has no partition in either; a threshold that
keeps nothing of a set has none in ``audit``.

Input: edges with a null end or weight, and nodes without a type, count nowhere; repeated edges add up.
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sparsewing.operators import inference, wiring

log = logging.getLogger("jobs.audit_wiring")
CONFIG = Path(__file__).with_suffix(".json")
WIRING = "dim bigint, cell bigint, w bigint, partners bigint, region string"


def typed(nodes: DataFrame, types: DataFrame, sets: DataFrame, regions: list[str] | None) -> DataFrame:
    """(pre, dim, region). The types and sets are joined as they come; Spark broadcasts them while they are small."""
    t = types.select(F.col("n_nationkey").cast("bigint").alias("dim"), F.col("n_regionkey").alias("r"))
    s = sets.select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("region")).filter("region is not null")
    if regions is not None:
        s = s.filter(F.col("region").isin(regions))
    n = nodes.select(F.col("s_suppkey").alias("pre"), F.col("s_nationkey").cast("bigint").alias("dim"))
    return n.join(t.join(s, "r"), "dim").select("pre", "dim", "region")


def compared(audit: DataFrame, measured: DataFrame, config: dict) -> DataFrame:
    """The audit with Q against that of random wirings; where no cell has two inputs, every Q is 0."""
    key = ["region", "threshold"]
    drawn = wiring.shuffled_co_occurrence(measured, config["thresholds"], ["region"], config["nulls"], config["seed"])
    every = audit.select(*key).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(config["nulls"] - 1).cast("long"))))
    null = every.join(drawn, [*key, "draw"], "left").select(*key, F.coalesce("q", F.lit(0)).cast("double").alias("value"))
    test = inference.randomization(audit.select(*key, F.col("q").cast("double").alias("value")), null, key)
    q = test.select(*key, F.col("null_mean").alias("q_null_mean"), F.col("null_sd").alias("q_null_sd"), F.col("z").alias("q_z"), F.col("p_upper").alias("q_p_upper"), F.col("p_lower").alias("q_p_lower"))
    return audit.join(q, key).select(*[c for c in audit.columns if c not in key], *[c for c in q.columns if c not in key], *key)


def written(df: DataFrame, path: str, *by: str) -> int:
    """Replaces the partitions that ``df`` has rows for; returns the number of rows."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return seen.get["rows"]


def run(spark: SparkSession, edges: str, nodes: str, types: str, sets: str, output: str, config: dict) -> DataFrame:
    """Writes both tables and returns the audit as it stands."""
    lines = spark.read.parquet(edges).select(F.col("l_suppkey").alias("pre"), F.col("l_partkey").alias("post"), F.col("l_quantity").cast("bigint").alias("weight"))
    read = Observation()
    lines = lines.observe(read, F.count(F.lit(1)).alias("rows")).filter("pre is not null and post is not null and weight is not null")
    dims = typed(*(spark.read.parquet(p) for p in (nodes, types, sets)), config["regions"])
    at = output.rstrip("/")
    entries = written(wiring.build(lines, dims, by=["region"], rows=spark.read.parquet(edges).count()).repartition("region", "cell"), f"{at}/wiring", "region")
    log.info("read %d edges from %s; wrote %d entries to %s/wiring", read.get["rows"], edges, entries, at)
    measured = spark.read.schema(WIRING).parquet(f"{at}/wiring")
    if config["regions"] is not None:
        measured = measured.filter(F.col("region").isin(config["regions"]))
    rows = compared(wiring.audit(measured, config["thresholds"], ["region"]), measured, config)
    n = written(rows, f"{at}/audit", "region", "threshold")
    log.info("read %d entries from %s/wiring; wrote %d rows to %s/audit", entries, at, n, at)
    return spark.read.schema(rows.schema).parquet(f"{at}/audit")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Audits a wiring over thresholds.")
    for name in ("edges", "nodes", "types", "sets", "output"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("audit_wiring").getOrCreate()
    try:
        run(spark, a.edges, a.nodes, a.types, a.sets, a.output, json.loads(Path(a.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
