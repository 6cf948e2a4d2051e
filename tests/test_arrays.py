"""Array files as data sources: the same rows as a plain read, fewer of them read under a filter, refusals."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparsewing.sources import arrays

EDGES = "pre long, post long, weight int"


@pytest.fixture(autouse=True)
def formats(spark):
    arrays.register(spark)


def arrow_file(at, weights, rows=100):
    g = np.random.default_rng(1)
    n = len(weights)
    t = pa.table({"pre": g.integers(0, 50, n), "note": ["x"] * n, "post": np.arange(n), "weight": np.array(weights, dtype=np.int32)})
    with pa.OSFile(str(at), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t, max_chunksize=rows)
    return t.to_pandas()


def test_arrow_batches(spark, tmp_path):
    want = arrow_file(tmp_path / "e.arrow", sorted(np.random.default_rng(2).integers(1, 200, 3000), reverse=True))
    read = lambda **o: spark.read.format("arrow_batches").schema(EDGES).options(rows_per_partition=1, **o).load(str(tmp_path / "e.arrow"))
    every = read()
    assert every.rdd.getNumPartitions() == 30
    rows = lambda df: sorted(map(tuple, df.collect()))
    plain = lambda f: sorted(zip(f.pre, f.post, f.weight, strict=True))
    assert rows(every) == plain(want)
    for cond, mask in (("weight >= 150", want.weight >= 150), ("weight > 150", want.weight > 150), ("weight = 77", want.weight == 77), ("weight < 20", want.weight < 20), ("weight <= 20 and pre = 3", (want.weight <= 20) & (want.pre == 3)), ("weight > 500", want.weight > 500), ("weight >= 60 and weight < 80 and post > 5", (want.weight >= 60) & (want.weight < 80) & (want.post > 5))):
        for df in (read(), read(falling="weight")):
            assert rows(df.filter(cond)) == plain(want[mask]), cond
    parts = read(falling="weight").filter("weight >= 150").rdd.getNumPartitions()
    needed = -(-int((want.weight >= 150).sum()) // 100)
    assert needed <= parts <= needed + 1 < 30
    assert read(falling="weight").filter("weight >= 60 and weight < 80").rdd.getNumPartitions() <= 6
    assert rows(every.filter(F.col("pre") % 7 == 0)) == plain(want[want.pre % 7 == 0])  # left to Spark


def test_arrow_folder_and_refusals(spark, tmp_path):
    (tmp_path / "d").mkdir()
    a, b = (arrow_file(tmp_path / "d" / f"{n}.arrow", [5, 4, 4, 1], 2) for n in "ab")
    (tmp_path / "d" / "_SUCCESS").write_text("")
    df = spark.read.format("arrow_batches").schema("weight long").load(str(tmp_path / "d"))
    assert sorted(r.weight for r in df.collect()) == sorted([*a.weight, *b.weight])
    arrow_file(tmp_path / "up.arrow", [1, 2, 3, 4], 4)
    with pytest.raises(Exception, match="rises"):
        spark.read.format("arrow_batches").schema(EDGES).option("falling", "weight").load(str(tmp_path / "up.arrow")).collect()
    with pytest.raises(Exception, match="schema"):
        spark.read.format("arrow_batches").load(str(tmp_path / "up.arrow")).collect()


def fvecs_file(at, x):
    at.write_bytes(b"".join(np.int32(x.shape[1]).tobytes() + r.astype("<f4").tobytes() for r in x))


def test_fvecs(spark, tmp_path):
    x = np.random.default_rng(3).random((1000, 5)).astype("<f4")
    fvecs_file(tmp_path / "a.fvecs", x)
    (tmp_path / "none.fvecs").write_bytes(b"")
    df = spark.read.format("fvecs").option("rows_per_partition", 100).load(str(tmp_path / "a.fvecs"))
    assert df.rdd.getNumPartitions() == 10 and [r.x for r in df.orderBy("row").collect()] == x.astype(float).tolist()
    some = df.filter("row >= 250 and row < 260")
    assert some.rdd.getNumPartitions() == 1 and sorted(r.row for r in some.collect()) == list(range(250, 260))
    assert df.filter("row = 999").first().x == x[999].astype(float).tolist() and df.filter("row > 999").count() == 0
    assert spark.read.format("fvecs").load(str(tmp_path / "none.fvecs")).count() == 0
    (tmp_path / "bad.fvecs").write_bytes(b"\x02\x00\x00\x00" + bytes(9))
    with pytest.raises(Exception, match="one length"):
        spark.read.format("fvecs").load(str(tmp_path / "bad.fvecs")).collect()
    raw = bytearray((tmp_path / "a.fvecs").read_bytes())
    raw[24 * 500] = 7
    (tmp_path / "worse.fvecs").write_bytes(bytes(raw))
    with pytest.raises(Exception, match="does not have 5"):
        spark.read.format("fvecs").load(str(tmp_path / "worse.fvecs")).collect()


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_npz(spark, tmp_path, save):
    g = np.random.default_rng(4)
    held = {"imgs": g.integers(0, 255, (70, 3, 2)).astype(np.uint8), "labels": g.integers(0, 9, 70), "cols": np.asfortranarray(g.random((8, 4))), "one": np.array(5.0)}
    save(tmp_path / "a.npz", **held)
    df = spark.read.format("npz_rows").option("rows_per_partition", 32).load(str(tmp_path / "a.npz"))
    for name, x in held.items():
        got = df.filter(F.col("name") == name).orderBy("row").collect()
        assert [r.x for r in got] == x.reshape(x.shape[0] if x.ndim else 1, -1).astype(float).tolist()
    assert df.filter("name = 'imgs'").rdd.getNumPartitions() == (3 if save is np.savez else 1)
    cut = df.filter("name = 'imgs' and row >= 30 and row <= 40")
    assert sorted(r.row for r in cut.collect()) == list(range(30, 41)) and cut.rdd.getNumPartitions() == 1
    np.savez(tmp_path / "o.npz", a=np.array([None], dtype=object))
    with pytest.raises(Exception, match="objects"):
        spark.read.format("npz_rows").load(str(tmp_path / "o.npz")).collect()
