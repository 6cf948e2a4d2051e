"""The jobs: growing input on copies, reruns, refusals, the command line, and the registered queries against their SQL."""

import hashlib
import itertools
import json
import logging
import os
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import audit_wiring, encode_documents, queries
from sparsewing.operators import wiring
from tests.test_queries import SF, TABLES, plain

ROOT = Path(__file__).resolve().parents[1]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def config():
    return json.loads(encode_documents.CONFIG.read_text())


def add(spark, at, rows):
    spark.createDataFrame([(i, t, None, s, 0) for i, t, s in rows], DOCS).coalesce(1).write.mode("append").parquet(at)


def index(spark, at):
    return sorted((tuple(map(repr, (r.doc_id, r.n_words, r.cells, r.source))) for r in encode_documents.read_back(spark, at).collect()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    settings = lambda: {r.key: r.value for r in spark.sql("SET").collect()}
    before = settings()
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    db.execute(queries.ORACLE[name])
    names = [d[0] for d in db.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in db.fetchall()), key=repr)
    assert got == want and got
    assert before == settings()


def test_growing_documents(spark, tmp_path, config, caplog):
    """Each run takes in what is new, once; what stands there is what one run over all of it gives."""
    caplog.set_level(logging.INFO, "jobs.encode_documents")
    docs, out, mark = f"{tmp_path}/documents", f"{tmp_path}/codes", f"{tmp_path}/mark"
    run = lambda o=out, m=mark: encode_documents.run(spark, docs, o, m, config)
    first = [(1, "One two two three", "a"), (2, None, "a"), (3, " \t\n", None), (None, "x" * 5000, ""), (4, "A a A a", "1")]
    add(spark, docs, first)
    assert run() == 5 and run() == 0
    once = index(spark, out)
    assert len(once) == 5
    later = [(1, "One two two three", "a"), (5, "word " * 3000, "b"), (6, "one TWO two three", None)]
    add(spark, docs, later)
    add(spark, docs, [(7, "more", "b")])
    assert run() == 4
    both = index(spark, out)
    assert len(both) == 9 and set(once) <= set(both)
    assert run() == 0 and index(spark, out) == both
    assert run(f"{tmp_path}/o2", f"{tmp_path}/m2") == 9 and index(spark, f"{tmp_path}/o2") == both
    rows = {(r.doc_id, r.source): r for r in encode_documents.read_back(spark, out).collect()}
    assert rows[1, "a"].cells == rows[6, None].cells and rows[1, "a"].n_words == 4 and len(rows[1, "a"].cells) == config["winners"]
    assert rows[2, "a"].cells == rows[3, None].cells == [] and rows[None, None].n_words == 1
    assert [m for m in caplog.messages if "read 4 new documents" in m and "now holds 9" in m]
    assert {p.name for p in Path(out).iterdir() if p.is_dir() and p.name[0] not in "_."} == {"source=a", "source=b", "source=1", "source=__HIVE_DEFAULT_PARTITION__"}


def test_an_index_holds_codes_of_one_config(spark, tmp_path, config):
    docs, out, mark = f"{tmp_path}/documents", f"{tmp_path}/codes", f"{tmp_path}/mark"
    add(spark, docs, [(1, "a b c", "s")])
    encode_documents.run(spark, docs, out, mark, config)
    with pytest.raises(ValueError, match="another config"):
        encode_documents.run(spark, docs, out, mark, config | {"winners": 8})
    assert encode_documents.run(spark, docs, out, mark, config | {"max_files_per_batch": 1}) == 0


def test_batches_and_a_single_file(spark, tmp_path, config):
    """The number of files in a batch, and whether the path is a folder or a file, change nothing."""
    docs = f"{tmp_path}/documents"
    rows = [(i, f"text of number {i} and {i % 3}", f"s{i % 2}") for i in range(12)]
    for at in range(0, 12, 4):
        add(spark, docs, rows[at : at + 4])
    assert encode_documents.run(spark, docs, f"{tmp_path}/o1", f"{tmp_path}/m1", config | {"max_files_per_batch": 1}) == 12
    spark.createDataFrame([(i, t, None, s, 0) for i, t, s in rows], DOCS).toPandas().to_parquet(f"{tmp_path}/one.parquet")
    assert encode_documents.run(spark, f"{tmp_path}/one.parquet", f"{tmp_path}/o2", f"{tmp_path}/m2", config) == 12
    assert index(spark, f"{tmp_path}/o1") == index(spark, f"{tmp_path}/o2")


def test_encoding_is_a_map(spark, tmp_path, config):
    """No shuffle of the documents: every exchange of the plan is the wiring's."""
    add(spark, f"{tmp_path}/documents", [(1, "a", "s")])
    w = spark.createDataFrame([(0, 0, 1)], "dim long, cell long, w long")
    w.write.parquet(f"{tmp_path}/w")
    df = encode_documents.encoded(spark.read.parquet(f"{tmp_path}/documents"), spark.read.parquet(f"{tmp_path}/w"), config)
    plan = df._jdf.queryExecution().executedPlan().toString()
    stream = plan[: plan.index("BroadcastExchange")]
    assert "Exchange hashpartitioning" not in stream and "PythonUDF" not in plan and "ArrowEval" not in plan


@pytest.fixture
def circuit(spark, tmp_path):
    """Two sets of two types each."""
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return f"{tmp_path}/{name}.parquet"

    lines = [(1, 10, 3), (1, 10, 4), (2, 10, 5), (3, 10, 9), (3, 11, 2), (4, 12, 1), (5, 12, 8), (9, 12, 50), (None, 10, 7), (1, None, 7), (1, 13, None)]
    return [
        write("lineitem", lines, "l_suppkey long, l_partkey long, l_quantity int"),
        write("supplier", [(1, 0), (2, 0), (3, 1), (4, 2), (5, 3), (6, None)], "s_suppkey long, s_nationkey int"),
        write("nation", [(0, "n0", 0), (1, "n1", 0), (2, "n2", 1), (3, "n3", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        write("region", [(0, "A B"), (1, "C/D"), (2, "empty")], "r_regionkey int, r_name string"),
    ]


def test_audit(spark, tmp_path, circuit, caplog):
    caplog.set_level(logging.INFO, "jobs.audit_wiring")
    out, config = f"{tmp_path}/out", {"thresholds": [1, 5, 100], "regions": None, "nulls": 9, "seed": 2}
    got = {(r.region, r.threshold): r for r in audit_wiring.run(spark, *circuit, out, config).collect()}
    assert set(got) == {("A B", 1), ("A B", 5), ("C/D", 1), ("C/D", 5)}
    a = got["A B", 1]  # entries: dim 0 to cell 10 with 12 from two nodes, dim 1 to cell 10 with 9, to cell 11 with 2
    assert (a.entries, a.kept, a.weight, a.cells, a.dims, a.mean_inputs, a.single_input, a.max_fan_out, a.top_dim, a.q, a.four_cycles) == (3, 3, 23, 2, 2, 1.5, 1, 2, 1, 1, 0)
    b = got["A B", 5]
    assert (b.kept, b.weight, b.kept_share, b.weight_share, b.cells, b.top_dim, b.fan_out_cv) == (2, 21, round(2 / 3, 9), round(21 / 23, 9), 1, 0, 0.0)
    assert got["C/D", 5].q == 0 and got["C/D", 1].q == 1
    # cell 10 has both of its set's dims in every wiring, so Q never moves; at threshold 5 of C/D no cell has two
    assert all((x.q_null_mean, x.q_null_sd, x.q_z, x.q_p_upper, x.q_p_lower) == (x.q, 0.0, None, 1.0, 1.0) for x in got.values())
    w = sorted((r.region, r.dim, r.cell, r.w, r.partners) for r in spark.read.parquet(f"{out}/wiring").collect())
    assert w == [("A B", 0, 10, 12, 2), ("A B", 1, 10, 9, 1), ("A B", 1, 11, 2, 1), ("C/D", 2, 12, 1, 1), ("C/D", 3, 12, 8, 1)]
    assert any("read 11 edges" in m and "wrote 5 entries" in m for m in caplog.messages) and any("wrote 4 rows" in m for m in caplog.messages)
    again = audit_wiring.run(spark, *circuit, out, config).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got.values()))


def test_random_wirings_keep_the_cells_inputs(spark):
    """Q of each draw, by drawing every cell's dims in order of their digests."""
    g = random.Random(3)
    rows = [("s", d, c, g.randint(1, 9)) for c in range(30) for d in g.sample(range(7), g.randint(1, 5))]
    df = spark.createDataFrame(rows, "region string, dim long, cell long, w long")
    got = {(r.threshold, r.draw): r.q for r in wiring.shuffled_co_occurrence(df, [1, 4], ["region"], 3, 5).collect()}
    dims = sorted({d for _, d, _, _ in rows})
    for t in (1, 4):
        for draw in range(3):
            n, shared = Counter(c for _, _, c, w in rows if w >= t), Counter()
            for c, k in n.items():
                mine = sorted(dims, key=lambda d: hashlib.md5(f"null:5:{draw}:{d}:{c}".encode()).hexdigest())[:k]  # noqa: B023
                shared.update(itertools.combinations(sorted(mine), 2))
            assert got[t, draw] == sum(x * x for x in shared.values())


def test_audit_of_some_sets_leaves_the_others(spark, tmp_path, circuit):
    out = f"{tmp_path}/out"
    audit_wiring.run(spark, *circuit, out, {"thresholds": [1, 5], "regions": None, "nulls": 2, "seed": 2})
    spark.createDataFrame([(3, 11, 40)], "l_suppkey long, l_partkey long, l_quantity int").write.mode("append").parquet(circuit[0])
    got = {(r.region, r.threshold): r for r in audit_wiring.run(spark, *circuit, out, {"thresholds": [5, 30], "regions": ["A B"], "nulls": 2, "seed": 2}).collect()}
    assert set(got) == {("A B", 1), ("A B", 5), ("A B", 30), ("C/D", 1), ("C/D", 5)}
    assert (got["A B", 1].weight, got["A B", 5].weight, got["A B", 30].weight, got["C/D", 1].weight) == (23, 63, 42, 9)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_command_lines(tmp_path):
    """Both programs, each in a session of its own."""
    env = os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"}
    table = lambda t: f"{SF}/{t}.parquet"
    (tmp_path / "some.json").write_text(json.dumps({"thresholds": [50], "regions": ["ASIA"], "nulls": 3, "seed": 1}))
    calls = [
        ["jobs.encode_documents", "--documents", table("documents"), "--output", f"{tmp_path}/codes", "--checkpoint", f"{tmp_path}/mark"],
        ["jobs.audit_wiring", "--edges", table("lineitem"), "--nodes", table("supplier"), "--types", table("nation"), "--sets", table("region"), "--output", f"{tmp_path}/audit", "--config", f"{tmp_path}/some.json"],
    ]
    for call in calls:
        done = subprocess.run([sys.executable, "-m", *call], cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, done.stderr[-2000:]
        assert "read " in done.stderr
    assert duckdb.sql(f"SELECT count(*) FROM '{tmp_path}/codes/*/*.parquet'").fetchall()[0][0] == duckdb.sql(f"SELECT count(*) FROM '{table('documents')}'").fetchall()[0][0]
    assert duckdb.sql(f"SELECT region, threshold FROM '{tmp_path}/audit/audit/*/*/*.parquet'").fetchall() == [("ASIA", 50)]


def test_counts_of_bins(spark):
    rows = [(0, [3, 1, 3, 3, 0]), (1, []), (2, [7]), (3, [2] * 500)]
    got = {r.i: r.n for r in spark.createDataFrame(rows, "i int, b array<int>").select("i", encode_documents.counts(F.col("b")).alias("n")).collect()}
    assert got == {0: {0: 1, 1: 1, 3: 3}, 1: {}, 2: {7: 1}, 3: {2: 500}}
    docs = spark.createDataFrame([(0, "A b a"), (1, None)], "doc_id long, text string")
    made = encode_documents.vectors(docs, 64)
    assert "array_remove" not in made._jdf.queryExecution().optimizedPlan().toString()  # no pass over the words for each dimension
    assert [sum(r.q) for r in made.orderBy("doc_id").collect()] == [3, 0]
