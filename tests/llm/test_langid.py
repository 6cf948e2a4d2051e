"""Mixture inference against a plain restatement: one text at a time, one word at a time."""

import random
from math import exp, log

from sparsewing.llm import langid

M32 = (1 << 32) - 1
VOCAB = {
    "de": "der die das und nicht ist haben schön über straße werden auch wenn für größe zeit".split(),
    "en": "the and with that have this from which would their there about when make like time".split(),
    "fr": "le la les des est une pour dans avec plus être très où garçon temps même".split(),
    "tr": "bir ve için çok daha gibi olan ile değil güzel şey zaman kadar sonra büyük".split(),
}


def cell(a, b, c):
    x = ((a * 0x9E3779B1 & M32) ^ (b * 0x85EBCA77 & M32)) * 0xC2B2AE3D & M32
    x ^= c * 0x9E3779B1 & M32
    return ((x ^ (x >> 15)) * 0x85EBCA77 & M32) >> 17


def letters(text):
    out, word = [], []
    for b in text.encode():
        b = b + 32 if 65 <= b <= 90 else b
        if 97 <= b <= 122 or b >= 128:
            word.append(b)
        elif word:
            out.append(word)
            word = []
    return out + ([word] if word else [])


def trigrams(word):
    x = [0, *word, 0]
    return [cell(*x[i : i + 3]) for i in range(len(word))]


def learned(rows):
    langs = sorted({lang for _, lang in rows})
    counts = {lang: {} for lang in langs}
    for text, lang in rows:
        for w in letters(text or ""):
            for c in trigrams(w):
                counts[lang][c] = counts[lang].get(c, 0) + 1
    total = {lang: sum(x.values()) for lang, x in counts.items()}
    return langs, lambda lang, c: log((counts[lang].get(c, 0) + 0.5) / (total[lang] + 0.5 * langid.CELLS))


def em(like, langs, rounds=400):
    prop = dict.fromkeys(langs, 1 / len(langs))
    for _ in range(rounds):
        new = dict.fromkeys(langs, 0.0)
        for w in like:
            s = sum(prop[x] * w[x] for x in langs)
            for x in langs:
                new[x] += prop[x] * w[x] / s / len(like)
        prop = new
    return prop, sum(log(sum(prop[x] * w[x] for x in langs)) for w in like)


def judged(text, langs, ll):
    words = letters(text or "")
    if not words or not any(c.isalpha() for c in text):
        return "und", 0.0, []
    logs = [{x: sum(ll(x, c) for c in trigrams(w)) for x in langs} for w in words]
    top = [max(w.values()) for w in logs]
    like = [{x: exp(max(v - t, -60.0)) for x, v in w.items()} for w, t in zip(logs, top, strict=True)]
    full, _ = em(like, langs)
    alone = {x: sum(w[x] for w in logs) for x in langs}
    lead = max(langs, key=lambda x: alone[x])
    order = [lead, *sorted((x for x in langs if x != lead), key=lambda x: -full[x])]
    best, score = {lead: 1.0}, alone[lead]
    for size in range(2, len(langs) + 1):
        prop, value = em(like, order[:size])
        value += sum(top) - (size - 1) * langid.PENALTY / 2 * log(len(words) + 1)
        if value <= score:
            break
        best, score = prop, value
    pred = max(sorted(best), key=lambda x: best[x])
    return pred, best[pred], sorted(x for x, v in best.items() if v >= 0.005)


def test_against_plain_em(spark):
    g = random.Random(4)
    text = lambda lang, n: " ".join(g.choice(VOCAB[lang]) for _ in range(n))
    train = [(text(lang, 60), lang) for lang in VOCAB for _ in range(6)] + [(None, "en"), ("", "de")]
    model = langid.train(spark.createDataFrame(train, "text string, lang string").repartition(3))
    langs, ll = learned(train)
    assert model[0] == langs
    docs = [text(lang, n) for lang in VOCAB for n in (1, 3, 40)]
    docs += [text("de", 40) + " " + text("fr", 20), text("en", 30) + " " + text("tr", 30) + " " + text("fr", 30), " ".join(text(x, 60) for x in VOCAB)]
    docs += [None, "", "12 34 !", "Über-GRÖSSE", "x", "٣ ①", "日本語", "the " * 3000]
    rows = [(i, t, "own", 0.5) for i, t in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, letter string, score double").repartition(4)
    got = {r.doc_id: r for r in langid.identify(df, model).collect()}
    sizes = set()
    for i, t in enumerate(docs):
        pred, score, chosen = judged(t, langs, ll)
        assert (got[i].lang_pred, got[i].letter) == (pred, "own"), (i, t)
        assert abs(got[i].score - score) < 0.01 and sorted(got[i].lang_set) == chosen
        sizes.add(len(chosen))
    assert sizes >= {0, 1, 2, 3, 4}


def test_no_training_row_and_no_document(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    model = langid.train(empty)
    df = spark.createDataFrame([("abc",), (None,)], "text string")
    assert {(r.lang_pred, r.score) for r in langid.identify(df, model).collect()} == {("und", 0.0)}
    assert langid.identify(df.limit(0), model).count() == 0
