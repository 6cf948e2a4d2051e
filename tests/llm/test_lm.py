"""The bigram model against a plain restatement with rare contexts and many shards, and its probabilities' sums."""

import random
from collections import Counter, defaultdict
from math import ceil, log10

import numpy as np
import pyarrow as pa
import pytest

from sparsewing.llm import common, lm
from sparsewing.llm.trie import STEP, Trie, quantise
from tests.llm.brute import WORD, low

B, E = "<s>", "</s>"


def code(p):
    return ceil(-log10(p) * STEP - 1e-9) / STEP


def restated(docs, train, shards):
    """{doc_id: score}: only the marks are frequent. A seen bigram has its discounted share; an unseen one its context's unseen
    mass times the unigram, where the start mark's is counted in the following word's shard and spread over all shards."""
    toks = {i: [B, *WORD.findall(low(t)), E] for i, t in docs.items()}
    pair, uni, after = Counter(), Counter(), defaultdict(set)
    for i in train:
        pair.update(zip(toks[i], toks[i][1:], strict=False))
        uni.update(toks[i][1:])
    for a, b in pair:
        after[a].add(b)
    n, v = sum(uni.values()), len(uni)
    ctx = Counter()
    for (a, _), c in pair.items():
        ctx[a] += c

    def shard(w):
        h = common.words_of(pa.RecordBatch.from_arrays([pa.array([w])], names=["text"])).hash
        return int(lm.shard_of(h, shards)[0])

    first = Counter(shard(w) for w in after[B] if w != E)

    def cost(a, b):
        c = pair[a, b]
        if c:
            return code((c - lm.D) / ctx[a])
        if a == B and b == E:
            rest = lm.D * 1 / ctx[B] if ctx[B] else 1.0
        elif a == B:
            rest = min(lm.D * max(first[shard(b)], 0.5) * shards / ctx[B], 1.0) if ctx[B] else 1.0
        else:
            rest = min(lm.D * len(after[a]) / ctx[a], 1.0) if ctx[a] else 1.0
        return code(rest) - log10((uni[b] + 1) / (n + v + 1))

    return {i: -sum(cost(a, b) for a, b in zip(t, t[1:], strict=False)) for i, t in toks.items()}


@pytest.mark.parametrize("chars", [400, 16 << 20])
def test_rare_contexts_and_unseen_bigrams(spark, monkeypatch, chars):
    monkeypatch.setattr(lm, "SHARD_CHARS", chars)
    monkeypatch.setattr(lm, "HOT_SHARE", 2.0)  # nothing but the marks is frequent
    g = random.Random(11)
    kinds = ["".join(g.choice("abcdefg") for _ in range(4)) for _ in range(120)]
    docs = {i: " ".join(g.choice(kinds) for _ in range(g.choice([0, 1, 2, 15, 60]))) for i in range(150)}
    docs |= {200: None, 201: "never seen words here", 202: kinds[0], 203: kinds[0].upper() + " " + kinds[1]}
    train = [i for i in docs if i % 3 and i < 200]
    df = spark.createDataFrame([(i, t, i in train) for i, t in docs.items()], "doc_id long, text string, train boolean").repartition(5)
    shards = max(8, sum(len(t or "") for t in docs.values()) // chars + 1)
    assert shards == 8 or shards > 20
    want = restated(docs, train, shards)
    got = {r.doc_id: r.score for r in lm.score_texts(df).collect()}
    assert got.keys() == want.keys()
    for i, s in want.items():
        assert abs(got[i] - s) < 1e-6, (i, docs[i], got[i], s)


def test_codes_never_round_up():
    p = np.concatenate([10.0 ** -np.linspace(0, 290, 5000), [1.0, 0.5, 1e-12, 1e-8]])
    q = 10.0 ** (-quantise(p).astype(float) / STEP)
    assert (q <= p * (1 + 1e-9)).all() and (q >= p * 10 ** (-1 / STEP) * (1 - 1e-9)).all()
    g = np.random.default_rng(3)
    for _ in range(200):  # what a context's successors and its unseen words get
        c = g.integers(1, 10 ** int(g.integers(1, 10)), int(g.integers(1, 300)))
        codes = quantise(np.append((c - lm.D) / c.sum(), min(1.0, lm.D * len(c) / c.sum())))
        mass = (10.0 ** (-codes.astype(float) / STEP)).sum()
        assert mass <= 1 + 1e-9


def test_packed_and_written_tries_agree(tmp_path):
    ctx, first = np.array([3, 9, 1 << 50], dtype=np.uint64), np.array([0, 2, 2, 3])
    word, prob, back = np.array([4, 7, 1], dtype=np.uint64), quantise(np.array([0.5, 1e-12, 1.0])), quantise(np.array([0.1, 1.0, 1e-200]))
    Trie.write(str(tmp_path / "t"), ctx, first, word, back, prob)
    ask = np.array([3, 3, 9, 1 << 50, 8], dtype=np.uint64), np.array([7, 5, 4, 1, 1], dtype=np.uint64)
    a, b = Trie(str(tmp_path / "t")).search(*ask), Trie(Trie.pack(ctx, first, word, back, prob)).search(*ask)
    assert a[0].tolist() == b[0].tolist() == [384, -1, -1, 0, -1] and a[1].tolist() == b[1].tolist() == [32, 32, 0, 6400, 0]
