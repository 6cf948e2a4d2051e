"""Keeps an index of winner codes of a growing table of documents.

    python -m jobs.encode_documents --documents PATH --output PATH --checkpoint PATH [--config FILE]

A stream takes the Parquet files that its checkpoint has not seen, in batches, and ends when there are no more. A document
becomes a vector of word counts (the words' digests choose the dimension), the vector is centred and projected, and the cells
that win are its code. Codes go to ``output``, partitioned by source, through Spark's file sink, which together with the
checkpoint takes in each file once, also when a run is broken off and started anew. A run without new files adds nothing.
Encoding is a map over the documents: no shuffle, and no state but the list of files.

Input: files are added, not changed; one with a name that was taken in before is not read again. Texts without a word and null
texts have an empty code; a null or empty source is the partition of null; ids may be null or repeat; other columns are
left alone. Another config needs another output and checkpoint, as codes of two wirings cannot be compared; the config
stands in every row's ``version``, and the job refuses to go on with another one.
"""

from __future__ import annotations

import argparse
import hashlib
import json
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparsewing.functions import rng
from sparsewing.operators import wiring
from sparsewing.streaming.encode import encode_rows

log = logging.getLogger("jobs.encode_documents")
CONFIG = Path(__file__).with_suffix(".json")
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def version(config: dict) -> str:
    """What the codes depend on; how files are dealt into batches is not part of it."""
    return hashlib.sha256(json.dumps({k: v for k, v in config.items() if k != "max_files_per_batch"}, sort_keys=True).encode()).hexdigest()[:16]


def vectors(docs: DataFrame, dims: int) -> DataFrame:
    """Adds ``bins``, the dimension of every word, and ``q``, the words in each dimension."""
    words = F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(f"({WORD})"), 1)
    docs = docs.withColumn("bins", F.transform(words, lambda w: rng.integer(dims, "word", w).cast("int")))
    many = docs.withColumn("_many", counts(F.col("bins")))
    return many.withColumn("q", F.array(*[F.coalesce(F.try_element_at("_many", F.lit(b)), F.lit(0)).cast("bigint") for b in range(dims)])).drop("_many")


def counts(bins: Column) -> Column:
    """A map from each number of an array to how often it is there: the array is sorted once, and the ends of the runs of equal
    numbers tell their lengths, so the work does not grow with the number of dimensions."""
    once = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    last = lambda s: F.filter(F.transform(s, lambda x, i: F.struct(x.alias("x"), (i + 1).alias("end"))), lambda r: ~F.equal_null(F.get(s, r["end"]), r["x"]))
    length = lambda e: F.transform(e, lambda r, i: F.struct(r["x"], r["end"] - F.coalesce(F.get(e, i - 1)["end"], F.lit(0))))
    return F.map_from_entries(once(once(F.sort_array(bins), last), length))


def encoded(docs: DataFrame, w: DataFrame, config: dict) -> DataFrame:
    """(doc_id, n_words, cells, version, source) of a table or stream of documents."""
    rows = vectors(docs.select("doc_id", "text", "source"), config["dims"])
    own = F.struct("doc_id", F.size("bins").cast("bigint").alias("n_words"), "source")
    code = encode_rows(rows.select(own.alias("item_id"), "q"), w, config["winners"])
    cells = F.when(F.col("item_id.n_words") > 0, F.col("cells")).otherwise(F.array().cast("array<bigint>"))
    return code.select("item_id.doc_id", "item_id.n_words", cells.alias("cells"), F.lit(version(config)).alias("version"), F.when(F.col("item_id.source") != "", F.col("item_id.source")).alias("source"))


def read_back(spark: SparkSession, output: str) -> DataFrame | None:
    """The index, or None where there is none yet."""
    try:
        return spark.read.schema("doc_id bigint, n_words bigint, cells array<bigint>, version string, source string").parquet(output)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def files_of(path: str) -> str:
    """A pattern that only the path itself matches: of a pattern, a file stream reads single files as well as folders."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict) -> int:
    """Takes in the new files; returns the number of new documents."""
    held = read_back(spark, output)
    before = held.count() if held is not None else 0
    other = held.filter(F.col("version") != version(config)).select("version").first() if held is not None else None
    if other:
        raise ValueError(f"{output} holds codes of another config ({other.version}, not {version(config)})")
    w = wiring.uniform(spark, config["dims"], config["cells"], config["inputs"], config["wiring_seed"])
    schema = spark.read.parquet(documents).select("doc_id", "text", "source").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["max_files_per_batch"]).parquet(files_of(documents))
    sink = encoded(stream, w, config).writeStream.format("parquet").partitionBy("source").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    sink.start().awaitTermination()
    after = read_back(spark, output)
    new = (after.count() if after is not None else 0) - before
    log.info("read %d new documents from %s; %s held %d codes and now holds %d", new, documents, output, before, before + new)
    return new


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Takes the new documents into an index of winner codes.")
    for name in ("documents", "output", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("encode_documents").getOrCreate()
    try:
        run(spark, a.documents, a.output, a.checkpoint, json.loads(Path(a.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
