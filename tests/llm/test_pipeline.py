"""Every stage of the pipeline against a plain restatement, each on what the stage before has kept."""

import os
import random

import pytest

import corpus_pipeline
from tests.llm.brute import WORD, contaminated, near, repeats, scheduled, said_twice

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """The smallest tables, with planted rows: a wordless text, a near copy, a shared passage, a benchmark passage."""
    at = str(tmp_path_factory.mktemp("sf"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench.write.parquet(f"{at}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    g = random.Random(1)
    new = lambda n: " ".join("".join(g.choice(["th", "er", "ing", "on", "re", "an"]) for _ in range(3)) for _ in range(n))
    base, passage, item = new(300), new(90), bench.first().text
    extra = ["12 34 !!", None, base, base.replace(" ", "  ", 3) + " end", new(50) + " " + passage + " " + new(40), passage + " " + new(60), item, new(30) + " " + item]
    rows += [(10_000 + i, t, "en", None if i % 2 else "src0", len(t or "")) for i, t in enumerate(extra)]
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


def test_stages(spark, sf_dir, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "source_mixing"]
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, held = df.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in df.collect()}
        out = stage(spark, df, sf_dir)
        if i < 4:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r for r in df.collect()}
        assert df.count() == len(after)
        held.append(len(after))
        text = {d: r.text for d, r in before.items()}
        if name == "language_id":
            assert {d for d, t in text.items() if not t or not any(c.isalpha() for c in t)} == set(before) - set(after)
        elif name == "minhash_near_dedup":
            assert set(after) == {d for d, x in near(text, 5).items() if x[2]}
            assert 10_003 not in after and 10_002 in after
        elif name == "suffix_array_dedup":
            gone, said = repeats(text, 400), said_twice(text, 51)
            for d, t in text.items():
                kept = bytes(b for b, x, y in zip((t or "").encode(), gone[d], said[d], strict=True) if not (x or y)).decode("utf-8", "ignore")
                assert (after[d].text, after[d].n_chars) == (kept, len(kept))
            assert sum(gone[10_004]) >= 400 and sum(gone[10_005]) >= 400
            passage = " ".join((text[10_005] or "").split(" ")[:90])
            assert all(passage not in after[d].text for d in (10_004, 10_005)) and any(any(y) and not any(x) for x, y in zip(gone.values(), said.values(), strict=True))
        elif name == "benchmark_decontamination":
            assert set(before) - set(after) == {d for d, x in contaminated(text, items).items() if x[4]} >= {10_006}
        else:
            assert set(after) <= set(before) and all(0 < r.taken <= 2 * r.size for r in after.values())
            sizes = [(r.source, len(WORD.findall(r.text or ""))) for r in before.values()]
            assert {(r.source, r.size) for r in after.values()} <= set(sizes)
            for source, (target, taken) in scheduled(sizes).items():
                mine = [r for r in after.values() if r.source == source]
                assert sum(r.taken for r in mine) == taken and all(abs(r.target - target) < 1e-6 for r in mine)
    assert corpus_pipeline.run(spark, sf_dir).count() == held[-1]


def test_null_and_repeated_ids(spark, sf_dir):
    """Rows are judged by themselves: an id that repeats or is null neither loses nor spares a document."""
    g = random.Random(4)
    new = lambda n: " ".join("".join(g.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    a, b, c, e = new(60), new(70), new(80), new(90)
    stages = dict(corpus_pipeline.STAGES)

    def run(name, rows):
        df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
        return stages[name](spark, df, sf_dir).collect()

    got = run("minhash_near_dedup", [(3, a), (3, a), (3, b), (None, c), (None, e), (5, a + " x")])
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(3, a), (3, b), (0, c), (0, e)])
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    got = run("benchmark_decontamination", [(3, item), (3, b), (None, c), (None, item)])
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(3, b), (0, c)])
    got = run("source_mixing", [(3, a), (3, b), (None, c), (None, e)])
    assert sorted((r.doc_id or 0, r.text, r.size) for r in got) == sorted([(3, a, 60), (3, b, 70), (0, c, 80), (0, e, 90)])
    assert sum(r.taken for r in got) == scheduled([("s", n) for n in (60, 70, 80, 90)])["s"][1]


def test_no_documents(spark, sf_dir, tmp_path):
    """Every stage of an empty table gives an empty one with the columns of documents, the last with its own."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    columns = df.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, df, sf_dir).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        assert df.count() == 0 and (df.columns == columns if i < 4 else set(columns) < set(df.columns))
