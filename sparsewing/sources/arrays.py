"""Spark data sources for array files: Arrow batches, ``.fvecs`` records and ``.npz`` members, read in parts.

    arrays.register(spark)
    spark.read.format("arrow_batches").schema("pre long, post long, weight int").option("falling", "weight").load(path)
    spark.read.format("fvecs").load(path)
    spark.read.format("npz_rows").load(path)

A file is planned from its footer or header alone and read in partitions of batches or rows, so no task holds a file whole.
Comparisons with literals are pushed into the scan (``spark.sql.python.filterPushdown.enabled``, which ``register`` turns on): on
``row`` they cut the range that is read, on ``name`` they leave out members, and on the columns of an Arrow file they are
applied batch by batch before any other column is decoded. Where the values of a column fall from batch to batch (``falling``),
as in a file of edges in order of their weight, the batches that can hold a weight are found by halving.

Paths are local or of any file system that pyarrow opens by its URI; a path may be a folder, whose files are read in order of
their names. A file that is not what its source expects, or a ``falling`` column that rises where it is looked at, is an error.
"""

from __future__ import annotations

import struct
import zipfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs  # noqa: F401
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
LEAST = -(1 << 62)


def opened(path: str):
    fs, at = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
    return fs, at


def listed(path: str) -> list[str]:
    """The path, or the files of the folder that it names."""
    fs, at = opened(path)
    if fs.get_file_info(at).type != pa.fs.FileType.Directory:
        return [path]
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    files = fs.get_file_info(pa.fs.FileSelector(at, recursive=True))
    return sorted(prefix + f.path for f in files if f.is_file and f.base_name[0] not in "._")


@dataclass
class Part(InputPartition):
    path: str
    first: int
    last: int
    name: str = ""
    at: int = 0
    width: int = 0
    kind: str = ""
    order: str = "C"


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.schema, self.filters = dict(options), schema, []
        self.path, self.step = options["path"], int(options.get("rows_per_partition", self.STEP))

    STEP = 1 << 17
    TAKES = ("row",)

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in COMPARE and len(f.attribute) == 1 and f.attribute[0] in self.takes() and f.value is not None:
                self.filters.append((type(f), f.attribute[0], f.value))
            else:
                yield f

    def takes(self):
        return self.TAKES

    def rows(self, n: int) -> tuple[int, int]:
        """The rows of n that the filters on ``row`` leave, as a range."""
        first, last = 0, n
        for kind, name, v in self.filters:
            if name == "row":
                first = max(first, {EqualTo: v, GreaterThan: v + 1, GreaterThanOrEqual: v}.get(kind, first))
                last = min(last, {EqualTo: v + 1, LessThan: v, LessThanOrEqual: v + 1}.get(kind, last))
        return first, max(first, last)

    def batch(self, columns: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def _lists(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, dtype=np.float64).reshape(len(x), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


class FvecsReader(Reader):
    STEP = 1 << 15

    def partitions(self):
        out = []
        for path in listed(self.path):
            fs, at = opened(path)
            with fs.open_input_file(at) as f:
                size, head = f.size(), f.read_at(4, 0)
            if not size:
                continue
            dims = struct.unpack("<i", head)[0] if len(head) == 4 else 0
            if dims < 1 or size % (4 * dims + 4):
                raise ValueError(f"{path}: not records of one length")
            first, last = self.rows(size // (4 * dims + 4))
            out += [Part(path, a, min(a + self.step, last), width=dims) for a in range(first, last, self.step)]
        return out or [Part("", 0, 0)]

    def read(self, p):
        if p.first == p.last:
            return
        fs, at = opened(p.path)
        width = 4 * p.width + 4
        with fs.open_input_file(at) as f:
            raw = np.frombuffer(f.read_at(width * (p.last - p.first), width * p.first), dtype="<i4").reshape(-1, p.width + 1)
        if (raw[:, 0] != p.width).any():
            raise ValueError(f"{p.path}: a record does not have {p.width} dimensions")
        n = len(raw)
        yield self.batch({"path": pa.array([p.path] * n), "row": pa.array(np.arange(p.first, p.last)), "x": _lists(raw[:, 1:].view("<f4"))})


class Fvecs(DataSource):
    """(path, row, x): records of a length word and that many 32-bit floats."""

    @classmethod
    def name(cls):
        return "fvecs"

    def schema(self):
        return "path string, row long, x array<double>"

    def reader(self, schema):
        return FvecsReader(self.options, schema)


class NpzReader(Reader):
    TAKES = ("row", "name")

    def partitions(self):
        out = []
        for path in listed(self.path):
            fs, at = opened(path)
            with fs.open_input_file(at) as f, zipfile.ZipFile(f) as z:
                for info in sorted(z.infolist(), key=lambda i: i.filename):
                    name = info.filename.removesuffix(".npy")
                    if not info.filename.endswith(".npy") or any(not _holds(k, name, v) for k, c, v in self.filters if c == "name"):
                        continue
                    with z.open(info) as member:
                        shape, fortran, dtype = _header(member)
                        head = member.tell()
                    if dtype.hasobject:
                        raise ValueError(f"{path}: {name} holds objects")
                    shape = shape or (1,)
                    first, last = self.rows(shape[0])
                    width = int(np.prod(shape[1:], dtype=np.int64))
                    if info.compress_type == zipfile.ZIP_STORED and not fortran:
                        f.seek(info.header_offset)
                        fixed = f.read(30)
                        start = info.header_offset + 30 + sum(struct.unpack("<HH", fixed[26:30])) + head
                        out += [Part(path, a, min(a + self.step, last), name, start, width, dtype.str) for a in range(first, last, self.step)]
                    elif first < last:  # a packed member is read from its beginning, in one task
                        out.append(Part(path, first, last, name, -1, width, dtype.str))
        return out or [Part("", 0, 0)]

    def read(self, p):
        if p.first == p.last:
            return
        fs, at = opened(p.path)
        with fs.open_input_file(at) as f:
            if p.at >= 0:
                size = np.dtype(p.kind).itemsize * p.width
                x = np.frombuffer(f.read_at(size * (p.last - p.first), p.at + size * p.first), dtype=p.kind).reshape(p.last - p.first, p.width)
            else:
                with zipfile.ZipFile(f) as z, z.open(f"{p.name}.npy") as member:
                    x = np.lib.format.read_array(member, allow_pickle=False)
                x = x.reshape(len(x) if x.ndim else 1, -1)[p.first : p.last]
        for k in range(0, len(x), 8192):
            y = x[k : k + 8192]
            n = len(y)
            yield self.batch({"path": pa.array([p.path] * n), "name": pa.array([p.name] * n), "row": pa.array(np.arange(p.first + k, p.first + k + n)), "x": _lists(y)})


def _header(member):
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
    return read[np.lib.format.read_magic(member)](member)


def _holds(kind, a, b) -> bool:
    return {EqualTo: a == b, GreaterThan: a > b, GreaterThanOrEqual: a >= b, LessThan: a < b, LessThanOrEqual: a <= b}[kind]


class Npz(DataSource):
    """(path, name, row, x): rows of the arrays in ``.npz`` files, flattened. Members that are not packed are read in parts."""

    @classmethod
    def name(cls):
        return "npz_rows"

    def schema(self):
        return "path string, name string, row long, x array<double>"

    def reader(self, schema):
        return NpzReader(self.options, schema)


class ArrowReader(Reader):
    STEP = 8  # batches of a partition

    def takes(self):
        return [f.name for f in self.schema.fields]

    def partitions(self):
        out, falling = [], self.options.get("falling")
        for path in listed(self.path):
            fs, at = opened(path)
            with fs.open_input_file(at) as f, pa.ipc.open_file(f) as r:
                first, last = 0, r.num_record_batches
                for kind, name, v in self.filters:
                    if name == falling:
                        edge = lambda i, end: _edge(r, i, name, end)  # noqa: E731, B023
                        if kind in (EqualTo, GreaterThan, GreaterThanOrEqual):  # batches that begin below v, and all after them, are out
                            last = min(last, _count(r.num_record_batches, lambda i: _holds(GreaterThan if kind is GreaterThan else GreaterThanOrEqual, edge(i, 0), v)))  # noqa: B023
                        if kind in (EqualTo, LessThan, LessThanOrEqual):  # batches that end above v, and all before them
                            first = max(first, _count(r.num_record_batches, lambda i: not _holds(LessThan if kind is LessThan else LessThanOrEqual, edge(i, -1), v)))  # noqa: B023
            out += [Part(path, a, min(a + self.step, last)) for a in range(first, last, self.step)]
        return out or [Part("", 0, 0)]

    def read(self, p):
        if p.first == p.last:
            return
        fs, at = opened(p.path)
        falling = self.options.get("falling")
        names = [f.name for f in self.schema.fields]
        target = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in self.schema.fields])
        local = isinstance(fs, pa.fs.LocalFileSystem)
        with (pa.memory_map(at) if local else fs.open_input_file(at)) as f, pa.ipc.open_file(f) as r:
            for i in range(p.first, p.last):
                b = r.get_batch(i)
                if falling and b.num_rows > 1:
                    w = b.column(falling)
                    if pc.any(pc.greater(w[1:], w[:-1])).as_py():
                        raise ValueError(f"{p.path}: {falling} rises in batch {i}")
                keep = None
                for kind, name, v in self.filters:  # these columns first; a batch that has no row left is left at that
                    hit = COMPARE[kind](b.column(name), pa.scalar(v))
                    keep = hit if keep is None else pc.and_(keep, hit)
                if keep is not None:
                    if not pc.any(keep).as_py():
                        continue
                    b = b.select(names).filter(keep)
                yield pa.RecordBatch.from_arrays([b.column(n).cast(target.field(n).type) for n in names], schema=target)


def _edge(r, i: int, name: str, end: int):
    b = r.get_batch(i)
    if not b.num_rows:
        raise ValueError("an empty batch has no place in the order of a falling column")
    return b.column(name)[end if end >= 0 else b.num_rows - 1].as_py()


def _count(n: int, holds) -> int:
    """How many of 0..n-1 ``holds`` is true of, true ones first."""
    low, high = 0, n
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if holds(mid) else (low, mid)
    return low


def _arrow_type(t):
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t)


class ArrowBatches(DataSource):
    """Arrow IPC files with the columns of the stated schema."""

    @classmethod
    def name(cls):
        return "arrow_batches"

    def schema(self):
        raise ValueError("state the columns to read with .schema(...)")

    def reader(self, schema):
        return ArrowReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the three formats known to the session and lets it push filters into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (ArrowBatches, Fvecs, Npz):
        spark.dataSource.register(source)
