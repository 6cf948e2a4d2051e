import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparsewing.llm import decontaminate, langid, lm, mixing, suffixes
from tests.llm.brute import WORD, contaminated, low, repeats, scheduled, unigram

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans int"


def words(g, n, k=3):
    return [" ".join("".join(g.choice("abcdeé") for _ in range(g.randint(1, k))) for _ in range(n))][0]


@pytest.fixture(scope="module")
def texts():
    g = random.Random(11)
    out = {i: words(g, g.choice([0, 1, 5, 40, 90])) for i in range(60)}
    shared = [words(g, 30) for _ in range(4)]
    for i in range(60, 110):
        out[i] = words(g, g.randint(0, 20)) + " " + g.choice(shared) + "\n" + words(g, g.randint(0, 20))
    out |= {110: None, 111: "", 112: "a" * 700, 113: "ab" * 300, 114: out[70], 115: out[70], 116: "a" * 700, 117: "日本" * 200}
    return out


def frame(spark, texts, parts=3):
    return spark.createDataFrame([(i, t, "x", "s", 0, 1) for i, t in texts.items()], DOCS).repartition(parts)


def test_passages_of_words(spark):
    """Words of passages that stand elsewhere too, whatever blanks are between them; a passage ends with its document."""
    g = random.Random(12)
    passage = words(g, 12).split(" ")
    docs = {i: " ".join([*words(g, g.randint(0, 30)).split(" "), *(passage[: g.randint(5, 12)] if i % 2 else []), *words(g, 3).split(" ")]) for i in range(60)}
    docs |= {60: "\n ".join(passage), 61: "q " + "\t".join(passage) + " r", 62: None, 63: "", 64: " ", 65: "x " * 40, 66: "a1 b2", 67: "日本 " * 9 + "é " * 9}
    toks = {i: WORD.findall(t or "") for i, t in docs.items()}
    seen = defaultdict(int)
    for w in toks.values():
        for k in range(len(w) - 7):
            seen[tuple(w[k : k + 8])] += 1
    want, left = {}, {}
    for i, w in toks.items():
        gone = set()
        for k in range(len(w) - 7):
            if seen[tuple(w[k : k + 8])] > 1:
                gone |= set(range(k, k + 8))
        want[i], left[i] = len(gone), [x for k, x in enumerate(w) if k not in gone]
    assert sum(n > 0 for n in want.values()) > 10
    for hot in (suffixes.HOT, 1):
        suffixes.HOT, was = hot, suffixes.HOT
        try:
            got = {r.doc_id: r for r in suffixes.remove_repeats(frame(spark, docs), length=None, words=8).collect()}
        finally:
            suffixes.HOT = was
        assert {i: r.passage_words for i, r in got.items()} == want
        assert {i: WORD.findall(r.kept_text) for i, r in got.items()} == left
    both = {r.doc_id: r for r in suffixes.remove_repeats(frame(spark, docs), length=70, words=8).collect()}
    removed(suffixes.remove_repeats(frame(spark, docs), length=70), docs, 70)
    assert {i: r.passage_words for i, r in both.items()} == want
    assert all(set(r.kept_text) <= set(docs[i] or "") and len(r.kept_text) <= len(got[i].kept_text) for i, r in both.items())


def removed(df, texts, length):
    want = repeats(texts, length)
    for r in df.collect():
        raw, gone = (texts[r.doc_id] or "").encode(), want[r.doc_id]
        kept = bytes(b for b, x in zip(raw, gone, strict=True) if not x)
        runs = sum(x and (k == 0 or not gone[k - 1]) for k, x in enumerate(gone))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()), r.doc_id
        assert r.kept_text == kept.decode("utf-8", "ignore")


def test_suffixes_against_brute_force(spark, texts):
    df = suffixes.remove_repeats(frame(spark, texts), length=80)
    assert df.count() == len(texts)
    removed(df, texts, 80)


def test_suffixes_of_long_texts(spark, texts, monkeypatch):
    """Texts over a segment are anchored piece by piece."""
    monkeypatch.setattr(suffixes, "BLOCK", 128)
    removed(suffixes.remove_repeats(frame(spark, texts), length=80), texts, 80)


def test_suffixes_of_hot_anchors(spark, texts, monkeypatch):
    """Every anchor counts as hot: ranges of starts, then single strings."""
    monkeypatch.setattr(suffixes, "HOT", 1)
    removed(suffixes.remove_repeats(frame(spark, texts), length=80), texts, 80)


def test_suffixes_with_nulls_repeats_and_nothing(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    t = "xyz " * 150
    df = spark.createDataFrame([(None, t, None, None, None, 1), (3, t, None, None, None, 1), (3, t, None, None, None, 1), (4, None, None, None, None, 1)], DOCS)
    rows = sorted(((r.doc_id or 0), r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(df).collect())
    assert rows == [(0, 600, 600), (3, 600, 600), (3, 600, 600), (4, 0, 0)]


def test_two_stage_is_a_suffix_array():
    g = random.Random(4)
    for alphabet, n in ((b"ab", 300), (b"abcdefg", 500), (b"a", 50)):
        t = bytes(g.choice(alphabet) for _ in range(n)) + b"\0"
        sa = suffixes.two_stage(t, 1000)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        lcp = suffixes.common_prefixes(t, sa, 1000)
        for k in range(1, len(sa)):
            a, b = t[sa[k] :], t[sa[k - 1] :]
            m = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert lcp[k] == m


def test_contamination_against_brute_force(spark, monkeypatch):
    g = random.Random(6)
    items = {i: words(g, g.choice([0, 2, 6, 20, 30])) for i in range(25)} | {90: None, 91: "A-b a_B", 92: "a b a b"}
    docs = {i: words(g, 40) for i in range(40)}
    for i in range(40, 80):
        w = WORD.findall(items[g.randrange(25)] or "")
        k = g.randrange(max(1, len(w)))
        docs[i] = words(g, 10) + " " + " ".join(w[k : k + 15]).upper() + ". " + words(g, 5)
    docs |= {80: None, 81: "", 82: "... !!"}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    want = contaminated(docs, items, 5)
    for chars in (decontaminate.BENCH_CHARS, 300):  # one block, and several that are merged
        monkeypatch.setattr(decontaminate, "BENCH_CHARS", chars)
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.judged(decontaminate.contamination(df, bench, 5)).collect()}
        assert got == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(df, none).filter("n_hit > 0").count() == 0
    assert decontaminate.contamination(df.limit(0), bench).count() == 0


def test_contamination_of_repeated_and_null_ids(spark, monkeypatch):
    """Every row is judged by itself, whatever its id and however many blocks the benchmark has."""
    items = {i: " ".join(f"w{i}x{k}" for k in range(8)) for i in range(20)}
    rows = [(i, t) for i in (7, None) for t in (items[3] + " a b", items[12] + " a b", "c d e f g h i j k l", "c d e f g h i j k l")]
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted((i or 0, 10, 8 * (t[0] == "w"), [x for x in ("3", "12") if items[int(x)] in t]) for i, t in rows)
    for chars in (decontaminate.BENCH_CHARS, 100):
        monkeypatch.setattr(decontaminate, "BENCH_CHARS", chars)
        got = decontaminate.contamination(df, bench, 5).collect()
        assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.items) for r in got) == want


def test_language_mixtures(spark):
    g = random.Random(8)
    syl = {"xx": ["ta", "ko", "ri", "mo"], "yy": ["sch", "ung", "ein", "ber"], "zz": ["eau", "oui", "ille", "é"], "ww": ["gwy", "dda", "llh", "fe"]}
    text = lambda lang, n: " ".join("".join(g.choice(syl[lang]) for _ in range(g.randint(1, 4))) for _ in range(n))
    rows = [(i, text(lang, 40), lang) for i in range(60) for lang in syl]
    model = langid.train(spark.createDataFrame([(t, lang) for _, t, lang in rows], "text string, lang string"))
    mixed = text("xx", 30) + " " + text("yy", 60)
    test = [(1, text("xx", 5), "xx"), (2, text("yy", 30), "yy"), (3, text("zz", 1), "zz"), (4, mixed, "yy"), (5, None, "und"), (6, "12 34 !", "und"), (7, "", "und"), (8, " ".join((text("ww", 60), text("xx", 40), text("yy", 40), text("zz", 40))), "ww")]
    df = spark.createDataFrame([(i, t, 9.0) for i, t, _ in test], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    assert {i: got[i].lang_pred for i, _, _ in test} == {i: p for i, _, p in test}
    assert got[4].lang_set == ["xx", "yy"] and abs(got[4].score - 2 / 3) < 0.05
    assert sorted(got[8].lang_set) == sorted(syl) and abs(got[8].score - 1 / 3) < 0.05
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(df, ([], langid.np.zeros((langid.CELLS, 0), dtype="float32"))).filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(df.limit(0), model).count() == 0


def test_lm_base_and_score(spark):
    g = random.Random(9)
    docs = {i: words(g, g.choice([0, 1, 30, 80]), 2) for i in range(80)} | {90: None, 91: "", 92: "Zz zz ZZ"}
    train = [i for i in docs if i % 3]
    df = spark.createDataFrame([(i, t, i in train) for i, t in docs.items()], "doc_id long, text string, train boolean").repartition(3)
    want = unigram(docs, train)
    got = {r.doc_id: r for r in lm.score_texts(df).collect()}
    toks = {i: ["<s>", *WORD.findall(low(t)), "</s>"] for i, t in docs.items()}
    big, ctx, uni = defaultdict(int), defaultdict(int), defaultdict(int)
    for i in train:
        for a, b in zip(toks[i], toks[i][1:]):
            big[a, b] += 1
            ctx[a] += 1
            uni[b] += 1
    for i, r in got.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[i][:3]
        assert abs(r.base_score - want[i][3]) < 1e-7
        assert r.held_out == (i not in train) and r.score < 0
    # seen bigrams are scored from their discounted counts, rounded down by at most one code
    from math import log10

    for i in train:
        exact = sum(log10((big[p] - lm.D) / ctx[p[0]]) for p in zip(toks[i], toks[i][1:]))
        assert exact - len(toks[i]) / 32 - 1e-6 <= got[i].score <= exact + 1e-6
    assert lm.score_texts(df.limit(0)).count() == 0
    assert lm.score_texts(df.withColumn("train", F.lit(False))).filter("n_known > 0").count() == 0


def mixed_fixture():
    g = random.Random(2)
    rows = [(i, words(g, g.choice([0, 1, 20, 200])), g.choice(["a", "b", "c", "d", None] + ["big"] * 4)) for i in range(300)]
    return rows + [(1, rows[1][1], "a"), (None, "x y z", "a"), (500, None, "b"), (501, "w " * 30000, "e")]


def test_mixing(spark):
    rows = mixed_fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df.repartition(4)).collect()
    again = mixing.mix(df.repartition(2)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    want = scheduled([(s, len(WORD.findall(t or ""))) for _, t, s in rows])
    by = {(r.source_size, round(r.target, 6)): 0 for r in out}
    for r in out:
        by[r.source_size, round(r.target, 6)] += r.taken
        assert 0 <= r.taken <= 2 * r.size and (r.first_at is None) == (r.taken == 0) and 0 <= (r.first_at or 0) <= 1
    assert len(out) == len(rows)
    assert by == {(size[s], round(t, 6)): n for s, (t, n) in want.items()}
    assert all(abs(n - t) <= 8 for t, n in want.values())
    # blocks of one word: documents of a source begin at slots of their own
    firsts = [(r.source_size, r.first_at) for r in out if r.taken]
    assert len(set(firsts)) == len(firsts)
    assert mixing.mix(df.limit(0)).count() == 0


def test_a_small_source_beside_a_large_one(spark):
    """However few slots, a source of nine words gets its share, and a source's words stay near its target."""
    rows = [(i, "w " * 50, "large") for i in range(2000)] + [(9000, "nine words " * 4 + "x", "small"), (9001, "a b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for slots in (1 << 10, 1 << 18):
        got = defaultdict(lambda: [0, 0.0])
        for r in mixing.mix(df, slots=slots).collect():
            got[r.source_size][0] += r.taken
            got[r.source_size][1] = r.target
        want = scheduled([(s, len(t.split())) for _, t, s in rows], slots=slots)
        assert {n: x[0] for n, x in got.items()} == {100_000: want["large"][1], 9: want["small"][1], 2: want[None][1]}
        assert abs(got[9][0] - 18) <= 1 and abs(got[2][0] - 4) <= 1 and abs(got[100_000][0] - got[100_000][1]) <= 0.01 * got[100_000][1]


def test_equal_ids_and_sizes_are_ordered_by_their_text(spark):
    """Reruns over other partitions take the same words of the same texts, told apart by a key of their own."""
    rows = [(7, " ".join([f"w{i}"] * 20), "s", i) for i in range(40)] + [(8, " ".join([f"v{i}"] * 20), "t", 100 + i) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row long")
    one = {r.row: r.taken for r in mixing.mix(df.repartition(1), keep=("row",)).collect()}
    two = {r.row: r.taken for r in mixing.mix(df.repartition(5, "row"), keep=("row",)).collect()}
    assert one == two and len({n for n in one.values()}) > 1


def test_the_points_decide_the_mix(spark, monkeypatch):
    """Other points give other documents, near the same targets; with poor ones a source goes without."""
    rows = mixed_fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    taken = lambda: {(r.doc_id, r.size, r.target): r.taken for r in mixing.mix(df, slots=1 << 10).collect()}
    first = taken()
    monkeypatch.setattr(mixing, "GOLDEN", 2**0.5 - 1)
    other = taken()
    assert first != other and first.keys() == other.keys()
    total = lambda x: sum(x.values())
    assert abs(total(first) - total(other)) < 0.02 * total(first)
    monkeypatch.setattr(mixing, "points", lambda slots: slots.withColumn("x", F.lit(0.0)))
    assert {t for (_, n, t), k in taken().items() if k} != {t for (_, n, t), k in first.items() if k}


def test_hash_of_ids_splits_like_python(spark):
    from sparsewing.llm.common import held_out

    df = spark.range(50).withColumnRenamed("id", "doc_id")
    got = {r.doc_id for r in df.filter(held_out(df, 7, 2)).collect()}
    assert got == {i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2}
