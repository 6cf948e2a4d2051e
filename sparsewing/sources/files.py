"""File formats that Spark has no reader for, and the common ones with fixed schemas.

Each whole file or record stream becomes rows on the executors; nothing passes through the driver.
"""

from __future__ import annotations

import io
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fvecs(frames, dims: int):
    for f in frames:
        for path, raw in zip(f.path, f.content, strict=True):
            x = np.frombuffer(raw, dtype="<f4").reshape(-1, dims + 1)
            if (x[:, 0].copy().view("<i4") != dims).any():
                raise ValueError(f"{path}: a record does not have {dims} dimensions")
            yield pd.DataFrame({"path": path, "row": np.arange(len(x)), "x": list(x[:, 1:].astype(np.float64))})


def fvecs(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(path, row, x): records of one length word and ``dims`` 32-bit floats."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(partial(_fvecs, dims=dims), "path string, row long, x array<double>")


def _npz(frames, names: list[str]):
    for f in frames:
        for path, raw in zip(f.path, f.content, strict=True):
            with np.load(io.BytesIO(raw), allow_pickle=False) as z:
                for name in names:
                    a = z[name]
                    a = a.reshape(len(a), -1)
                    yield pd.DataFrame({"path": path, "name": name, "row": np.arange(len(a)), "x": list(a.astype(np.float64))})


def npz(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(path, name, row, x): rows of the named arrays, flattened."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(partial(_npz, names=names), "path string, name string, row long, x array<double>")


def _arrow(frames, columns: list[str], schema: str):
    import pyarrow as pa

    for f in frames:
        for raw in f.content:
            with pa.ipc.open_file(pa.BufferReader(raw)) as r:
                for i in range(r.num_record_batches):  # batch by batch, columns pruned
                    yield pa.Table.from_batches([r.get_batch(i)]).select(columns).to_pandas()


def arrow_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Arrow IPC (feather) files with the columns of ``schema`` (DDL)."""
    names = [c.split()[0] for c in schema.split(",")]
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(partial(_arrow, columns=names, schema=schema), schema)


def word_vectors(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(word, x): text lines of a word and its components."""
    parts = F.split("value", " ")
    return spark.read.text(path).select(parts[0].alias("word"), F.transform(F.slice(parts, 2, dims), lambda v: v.cast("double")).alias("x"))


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Delimited text with a header and a stated schema; nothing is inferred."""
    return spark.read.schema(schema).csv(path, sep=sep, header=True)


def unpivot(wide: DataFrame, key: str, missing_ok: bool = True) -> DataFrame:
    """(key, name, v) from one column per measured unit; nulls and NaN are unmeasured and give no row."""
    cols = [c for c in wide.columns if c != key]
    rows = wide.unpivot([key], cols, "name", "v")
    return rows.filter(F.col("v").isNotNull() & ~F.isnan(F.col("v").cast("double"))) if missing_ok else rows


def receptors_to_dims(responses: DataFrame, mapping: DataFrame) -> DataFrame:
    """(key, dim, v): means over the receptors of a dimension; ambiguous targets are dropped."""
    key = responses.columns[0]
    m = mapping.filter(~F.col("dim").rlike(r"[?/+]") & F.col("dim").isNotNull())
    return responses.join(m, "name").groupBy(key, "dim").agg(F.avg("v").alias("v"))


def verified(spark: SparkSession, path: str, sums: DataFrame) -> DataFrame:
    """Files against a table (name, sha256): ok, changed, or missing."""
    f = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("got"))
    state = F.when(F.col("got").isNull(), "missing").when(F.col("got") == F.col("sha256"), "ok").otherwise("changed")
    return sums.join(f, "name", "left").select("name", state.alias("state"))
