"""Token counts against the library that owns the vocabulary file, and the transducers against plain restatements."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from sparsewing.llm import tokencount as tc

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def counter():
    return tc.Counter(tc.Compiled(PATH))


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def some(g, letters, most, n):
    return ["".join(g.choice(letters) for _ in range(g.randint(1, most))) for _ in range(n)]


def test_texts_against_the_library(counter, library):
    g = random.Random(5)
    low = "abcdefghijklmnopqrstuvwxyz"
    texts = ["", None, " ", "don't we'll I've you're he'd x'lx 'rx 've 'v 'r 'l '' 's's !'s ''s can''t 'S 'RE O'Reilly 'm1 '1 'l"]
    texts += ["a<|endoftext|>b", "<|startoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext|", "<|ENDOFTEXT|>", "é<|endoftext|>é", "'<|endoftext|>s"]
    texts += some(g, low, 40, 400) + some(g, "ab", 60, 400) + [g.choice(low) * g.randint(1, 300) for _ in range(50)]
    texts += some(g, "aeth'rsl ve!?1٣ 　 \u0085​ÄßİKſḱéé̈Σς\U0001f600‍क्\x00", 60, 800)
    texts += ["".join(chr(g.choice([g.randint(0, 0x24F), g.randint(0, 0xD7FF), g.randint(0xE000, 0x10FFFF)])) for _ in range(g.randint(1, 40))) for _ in range(400)]
    texts += ["x" * 20_000, some(g, low, 50_000, 1)[0], "é" * 9000, "word " * 30_000]
    assert counter.texts(pa.array(texts)).tolist() == library(texts)


def test_pieces_by_the_pattern():
    """All strings over one character of each class, wherever chunks are cut."""
    letters = {" ": tc.SPACE, "1": tc.NUMBER, "a": tc.LETTER, "!": tc.OTHER, "'": tc.QUOTE, "s": tc.ENDS, "r": tc.R, "v": tc.V, "e": tc.E, "l": tc.DOUBLE}
    rule = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
    words = ["".join(x) for x in itertools.product("'!arel1s ", repeat=4)]
    text = " ".join(words) + " "
    kind = np.array([letters[c] for c in text], dtype=np.uint8)
    want = [m.start() for m in rule.finditer(text)]
    old = tc.CHUNK
    try:
        for tc.CHUNK in (1, 3, 7, 256, 1 << 16):
            assert tc.starts(kind).tolist() == want
    finally:
        tc.CHUNK = old


def test_small_vocabularies_by_plain_merging():
    """Random merges, some of which make tokens that no text can reach, against merging the least pair again and again."""
    g = random.Random(8)
    for _ in range(60):
        left, right, made = [], [], {}
        live = [97, 98, 99, 256 + 97, 256 + 98]
        text = {x: (x,) for x in live}
        while len(left) < 12:
            a, b = g.choice(live), g.choice(live)
            new = text[a] + text[b]
            if any(x >= 256 for x in text[a]) or new in made:
                continue
            made[new] = 512 + len(left)
            left.append(a)
            right.append(b)
            live.append(512 + len(left) - 1)
            text[live[-1]] = new
        m = tc.Merges(np.array(left), np.array(right))
        rank = {(a, b): i for i, (a, b) in enumerate(zip(left, right, strict=True))}
        pieces = [bytes(g.choice(b"abc") for _ in range(g.randint(1, 25))) for _ in range(40)]
        want = []
        for p in pieces:
            s = [*p[:-1], p[-1] + 256]
            while True:
                found = [(rank[x], i) for i, x in enumerate(zip(s, s[1:], strict=False)) if x in rank]
                if not found:
                    break
                r, i = min(found)
                s[i : i + 2] = [512 + r]
            want.append(len(s))
        data, size = np.frombuffer(b"".join(pieces), dtype=np.uint8), np.array([len(p) for p in pieces])
        first = np.cumsum(size) - size
        assert m.count(data, first, size).tolist() == want
        assert [m._one(np.array([*p[:-1], p[-1] + 256])) for p in pieces] == want


def test_transitions_dropped_and_made_anew(counter, library, monkeypatch):
    monkeypatch.setattr(tc, "CELLS", 1)
    texts = some(random.Random(9), "abcdefgh ", 90, 50)
    assert counter.texts(pa.array(texts)).tolist() == counter.texts(pa.array(texts)).tolist() == library(texts)


def test_rows(spark, library):
    texts = [None, "", "Two words", "Two words", "ü" * 3000, "a b " * 400_000]
    rows = [(i if i != 2 else None, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(2)
    got = sorted(((r.n_bytes, r.n_tokens, r.over_limit) for r in tc.token_counts(df, PATH).collect()))
    want = library(texts)
    assert got == sorted((len((t or "").encode()), n, n > 2048) for t, n in zip(texts, want, strict=True))
    assert tc.token_counts(df.limit(0), PATH).count() == 0
