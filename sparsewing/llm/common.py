"""Shared pieces of the training-data operators.

Text work runs on Arrow batches: the value buffer of a string column is viewed as a NumPy byte array, so that lower-casing,
tokenising and hashing are vector operations and no Python string is made for a word. Batches are cut into blocks of
about ``BLOCK`` bytes at document borders, which bounds the memory of a task whatever the number of rows in a batch.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, BATCH = 1 << 19, 8 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


# ---------------------------------------------------------------- session
def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``. Only where that is unset (tests, one
    machine) a folder of our own is made and set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        sc = spark.sparkContext
        got = sc._jsc.sc().getCheckpointDir()
        at = got.get() if got.isDefined() else None
        if not at:
            at = "file://" + tempfile.mkdtemp(prefix="shared-")
            sc.setCheckpointDir(at)
        return at.replace("file:/", "file:///", 1) if at.startswith("file:/") and not at.startswith("file://") else at
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back; the rows are made once, whoever reads them."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def bound_batches(spark: SparkSession) -> None:
    """Cuts what goes to a Python worker at a time to ``BATCH`` bytes (64 MB by default), where the session has not been
    given a size of its own; the JVM holds such a batch twice for each running task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(64 << 20):
        spark.conf.set(key, BATCH)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- hashing
def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 vectors."""
    x = np.asarray(x, dtype=U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


#: A random word for each byte value, and powers of the base and of its inverse modulo 2**64 (grown on demand).
BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
#: The same for each of the first 32 places in a word.
PLACED = mix64((np.arange(32, dtype=U64)[:, None] * U64(_BASE) + BYTE[None, :]).reshape(-1))
_pow = np.ones(1, dtype=U64)
_inv = np.ones(1, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 16)
        f = np.full(size, _BASE, dtype=U64)
        f[0] = 1
        _pow = np.cumprod(f, dtype=U64)
        f[1:] = _INV
        _inv = np.cumprod(f, dtype=U64)
    return _pow, _inv


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes that end a word: the blank and the controls from tab to carriage return.
BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes that are no part of a word of letters: all of ASCII but a-z, after lower-casing A-Z; digits are words too.
SIGN = np.zeros(256, dtype=bool)
SIGN[0x00:0x30] = True
SIGN[0x3A:0x61] = True
SIGN[0x7B:0x80] = True


# ---------------------------------------------------------------- blocks of text
def bytes_of(col) -> tuple[np.ndarray, np.ndarray]:
    """Value bytes and offsets (n + 1) of an Arrow string or binary array; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    v = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return v[o[0] : o[-1]], o - o[0]


def blocks(batches, limit: int = BLOCK):
    """Slices of Arrow batches whose first text column (``text``) holds about ``limit`` bytes at most; one long document
    makes a block of its own."""
    for b in batches:
        if not b.num_rows:
            continue
        _, o = bytes_of(b.column(b.schema.get_field_index("text")))
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(o, o[at] + limit, side="right")) - 1
            to = min(max(to, at + 1), b.num_rows)
            yield b.slice(at, to - at)
            at = to


class Words:
    """The words of a block: byte starts and ends, the document of each, and a 64-bit hash of its lower-cased bytes."""

    def __init__(self, v: np.ndarray, o: np.ndarray, stop: np.ndarray = BLANK, lower: bool = True):
        n, docs = len(v), len(o) - 1
        if lower:
            v = LOWER[v]
        inside = np.zeros(n + 1, dtype=np.int8)
        inside[:n] = ~stop[v] if n else 0
        first = inside[:n].copy()
        first[1:] &= 1 - inside[: n - 1] if n else 0
        edge = o[1:-1]
        edge = edge[edge < n]
        first[edge] = inside[edge]
        last = inside[:n] & (1 - inside[1:])
        cut = o[1:-1] - 1
        cut = cut[cut >= 0]
        last[cut] = inside[cut]
        self.bytes = v
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.count_upto = np.searchsorted(self.start, o)  # words before each document border
        self.n = np.diff(self.count_upto)
        self.doc = np.repeat(np.arange(docs), self.n)
        self._hash = None

    @property
    def hash(self) -> np.ndarray:
        """The sum of one mixed value for each byte at its place in the word, mixed again with the length. A polynomial modulo
        2**64 would not do: long words made by a substitution, such as the Thue-Morse word and its complement, collide under
        any base."""
        if self._hash is None:
            n = self.end - self.start
            upto = np.cumsum(n)
            first = upto - n
            inside = np.arange(int(upto[-1]) if len(n) else 0)
            place = inside - np.repeat(first, n)
            inside += np.repeat(self.start - first, n)
            x = PLACED[(place & 31) << 8 | self.bytes[inside]]
            far = np.flatnonzero(place > 31)
            x[far] = mix64(x[far] + (place[far] >> 5).astype(U64) * U64(_BASE))
            self._hash = mix64(np.add.reduceat(x, first) + n.astype(U64)) if len(n) else np.zeros(0, dtype=U64)
        return self._hash


def words_of(batch, stop: np.ndarray = BLANK) -> Words:
    v, o = bytes_of(batch.column(batch.schema.get_field_index("text")))
    return Words(v, o, stop)


def starts_of(sorted_keys: np.ndarray) -> np.ndarray:
    """Positions at which a new value begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    new = np.empty(len(sorted_keys), dtype=bool)
    new[0] = True
    np.not_equal(sorted_keys[1:], sorted_keys[:-1], out=new[1:])
    return np.flatnonzero(new)


def held_out(df: DataFrame, mod: int, rest: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % F.lit(mod) == F.lit(rest)


def nonnull_id(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col(name).isNotNull())
