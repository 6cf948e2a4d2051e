import hashlib
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparsewing.plans import runs
from sparsewing.sources import files
from sparsewing.streaming import encode as stream


def test_binary_and_text_formats(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(3, 4)
    raw = b"".join(np.int32(4).tobytes() + r.tobytes() for r in x)
    (tmp_path / "a.fvecs").write_bytes(raw)
    got = files.fvecs(spark, str(tmp_path / "a.fvecs"), 4).orderBy("row").collect()
    assert [r.x for r in got] == x.tolist()
    buf = io.BytesIO()
    np.savez(buf, imgs=np.arange(8).reshape(2, 2, 2))
    (tmp_path / "b.npz").write_bytes(buf.getvalue())
    assert [r.x for r in files.npz(spark, str(tmp_path / "b.npz"), ["imgs"]).orderBy("row").collect()] == [[0, 1, 2, 3], [4, 5, 6, 7]]
    t = pa.table({"a": [1, 2], "b": ["x", "y"], "c": [0.5, 1.5]})
    with pa.OSFile(str(tmp_path / "c.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    assert [(r.c, r.a) for r in files.arrow_file(spark, str(tmp_path / "c.arrow"), "c double, a long").orderBy("a").collect()] == [(0.5, 1), (1.5, 2)]
    (tmp_path / "w.txt").write_text("cat 1 2 3\ndog 4 5 6\n")
    assert {r.word: r.x for r in files.word_vectors(spark, str(tmp_path / "w.txt"), 3).collect()} == {"cat": [1, 2, 3], "dog": [4, 5, 6]}


def test_response_matrix(spark, tmp_path):
    (tmp_path / "r.csv").write_text("odour;R1;R2;R3\na;1;;3\nb;2;5;\n")
    wide = files.delimited(spark, str(tmp_path / "r.csv"), "odour string, R1 double, R2 double, R3 double", ";")
    m = spark.createDataFrame([("R1", "D1"), ("R2", "D1"), ("R3", "D2?")], "name string, dim string")
    got = {(r.odour, r.dim): r.v for r in files.receptors_to_dims(files.unpivot(wide, "odour"), m).collect()}
    assert got == {("a", "D1"): 1.0, ("b", "D1"): 3.5}


def test_checksums(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"1")
    (tmp_path / "y.bin").write_bytes(b"2")
    sums = spark.createDataFrame([("x.bin", hashlib.sha256(b"1").hexdigest()), ("y.bin", "0"), ("z.bin", "0")], "name string, sha256 string")
    assert {r.name: r.state for r in files.verified(spark, f"{tmp_path}/*.bin", sums).collect()} == {"x.bin": "ok", "y.bin": "changed", "z.bin": "missing"}


def test_runs_go_on_where_they_stopped(spark, tmp_path):
    path, seen = str(tmp_path / "run"), []

    def work(units):
        seen.append(units.count())
        return units.select("unit", "k", F.col("k").cast("double").alias("value"))

    first = runs.design(spark, "v1", k=[1, 2])
    assert runs.resume(first, path, work).count() == 2
    more = runs.design(spark, "v1", k=[1, 2, 3])
    assert runs.resume(more, path, work).count() == 3 and runs.resume(more, path, work).count() == 3
    assert seen == [2, 1]
    assert runs.pending(runs.design(spark, "v2", k=[1]), path).count() == 1
    assert "| 1 | 1.0000 | - | 1 |" in runs.report(runs.finished(spark, path), ["k"], "value")


def test_codes_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    from sparsewing.operators import encode, wiring
    from sparsewing.sources import tables

    sf = "/root/testdata/sf0.001"
    items = tables.items(spark, sf).select("item_id", "q").limit(40)
    items.write.parquet(str(tmp_path / "in"))
    w = wiring.uniform(spark, 64, 80, 6, 7)
    live = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
    q = stream.encode_rows(live, w, 8).writeStream.format("memory").queryName("codes").start()
    q.processAllAvailable()
    q.stop()
    from sparsewing.functions import vectors

    batch = encode.as_sets(encode.winners(encode.drive(spark.read.parquet(str(tmp_path / "in")).withColumn("q", vectors.centre(F.col("q"))), w, 480), 8))
    assert {r.item_id: r.cells for r in spark.table("codes").collect()} == {r.item_id: r.cells for r in batch.collect()}
    n = stream.fold_counts(spark.table("codes"), stream.fold_counts(spark.table("codes"), None))
    assert n.agg(F.sum("n")).first()[0] == 2 * 40 * 8
