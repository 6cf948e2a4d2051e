"""Extra columns whose names the operators use themselves change no result, and texts beyond a block are read whole."""

from pyspark.sql import functions as F

from sparsewing.llm import common, decontaminate, langid, lm, mixing, pivots, warc

NAMES = ["size", "sid", "target", "taken", "at", "rank", "block", "row", "n_words", "spans", "items", "cid", "rep", "label_", "d", "a", "b", "kind", "run", "order", "digest", "sha", "first", "letter", "score", "train_tokens", "uid", "h", "bucket", "class"]


def clashing(df):
    return df.withColumns({n: F.lit("x") for n in NAMES if n not in df.columns})


def same(a, b):
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and a.columns == b.columns


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"some words of text number {i % 5} and {i % 3} more words to read", "s" if i % 2 else None, i % 3 > 0) for i in range(30)], "doc_id long, text string, source string, train boolean").repartition(2)
    same(mixing.mix(docs), mixing.mix(clashing(docs)))
    same(lm.score_texts(docs), lm.score_texts(clashing(docs)))
    items = spark.createDataFrame([(1, "some words of text number 1 and")], "item_id long, text string")
    same(decontaminate.judged(decontaminate.contamination(docs, items)), decontaminate.judged(decontaminate.contamination(clashing(docs), clashing(items))))
    vectors = spark.createDataFrame([(i, [1.0, i % 3 / 100], 1) for i in range(12)], "vec_id long, embedding array<float>, label int")
    same(pivots.near_vectors(vectors), pivots.near_vectors(clashing(vectors)))


def test_clashing_columns_of_pages(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i}", f"<p>{i % 4}</p>") for i in range(12)], "page_id long, url string, html string").repartition(2)

    def index(p, name):
        folder = common.shared_path(spark, name)
        return warc.capture_index(warc.read_warc(warc.write_warc(p, folder), folder)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts")

    same(index(pages, "plain"), index(clashing(pages), "clashing"))


def test_texts_beyond_a_block(spark):
    """A text of more than BLOCK bytes, with what matters at its end."""
    long = "plain words without end " * (common.BLOCK // 20)
    tail = "these thirteen words stand in the benchmark and at the very end here"
    docs = spark.createDataFrame([(1, long + tail, True), (2, long, True), (3, "short text", False)], "doc_id long, text string, train boolean")
    assert len(long) > common.BLOCK
    found = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.judged(decontaminate.contamination(docs, spark.createDataFrame([(1, tail)], "item_id long, text string"))).collect()}
    assert found == {1: (13, 1), 2: (0, 0), 3: (0, 0)}
    got = {r.doc_id: r for r in lm.score_texts(docs).collect()}
    assert got[1].n_tokens == len((long + tail).split()) + 1 and got[1].train_tokens == got[1].n_tokens + got[2].n_tokens
    model = langid.train(spark.createDataFrame([("plain words without end", "en"), ("der die das und nicht", "de")], "text string, lang string"))
    both = spark.createDataFrame([(1, long + "der die das und nicht " * (common.BLOCK // 8))], "doc_id long, text string")
    r = langid.identify(both, model).first()
    assert r.lang_pred == "de" and sorted(r.lang_set) == ["de", "en"]
