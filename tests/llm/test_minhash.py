import random

from sparsewing.llm import minhash
from sparsewing.llm.minhash import near_duplicates
from tests.llm.brute import near

SCHEMA = "doc_id long, text string, component_id string, n_shingles int"


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def fixture():
    g = random.Random(5)
    word = lambda: "".join(g.choice("abcde") for _ in range(4))
    docs, i = {}, 0
    for n in (6, 30, 120, 400):
        for _ in range(6):
            base = [word() for _ in range(n)]
            for k in range(6):
                w = base[:]
                for _ in range(int(n * 0.02 * k)):
                    w[g.randrange(n)] = word()
                docs[i] = " ".join(w) if k % 2 else "\n".join(x.upper() for x in w)
                i += 1
    docs |= {i: None, i + 1: "", i + 2: "  \t ", i + 3: "one two", i + 4: "ONE  two", i + 5: "one", i + 6: "é " * 5000}
    return docs


def test_against_brute_force(spark):
    docs = fixture()
    for size in (4, 5):
        df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], SCHEMA).repartition(3)
        assert got(near_duplicates(df, size)) == near(docs, size)


def test_empty_nulls_and_repeats(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f", "", 0), (3, "a b c d e f", "", 0), (3, "a b c d e f", "", 0), (4, None, "", 0)], SCHEMA)
    rows = near_duplicates(df).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id or 0, r.kept) for r in rows) == [(False, 3, 3, True), (False, 3, 3, True), (False, 4, 4, True), (True, 0, 0, True)]


def test_families_in_blocks(spark, monkeypatch):
    """Followings and families of any size are cut into blocks: one large family of copies around the threshold."""
    g = random.Random(7)
    base = [f"w{k}" for k in range(60)]
    docs = {}
    for i in range(120):
        w = base[:]
        for _ in range(g.choice([1, 2, 3, 4])):
            w[g.randrange(60)] = f"x{g.randrange(40)}"
        docs[i] = " ".join(w)
    want = near(docs, 4)
    assert 1 < len({c for _, c, _ in want.values()}) < 120
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], SCHEMA).repartition(3)
    for rows in (1024, 8, 1):
        monkeypatch.setattr(minhash, "ROWS", rows)
        assert got(near_duplicates(df, 4)) == want


def test_long_words_of_one_substitution(spark):
    """The Thue-Morse word and its complement collide under any polynomial hash modulo 2**64."""
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    docs = {1: a, 2: a.translate(str.maketrans("ab", "ba")), 3: a}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs.items()], SCHEMA)
    assert got(near_duplicates(df, 4)) == {1: (1, 1, True), 2: (1, 2, True), 3: (1, 1, False)}
