"""Plain restatements of what the operators compute, for small inputs."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from math import ceil, floor, log, log10, sqrt

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t, size):
    w = WORD.findall(low(t))
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def reach(nodes, links):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def near(docs, size, num=80, den=100):
    """docs: {doc_id: text} to {doc_id: (n_shingles, component, kept)}."""
    sets = {i: shingles(t, size) for i, t in docs.items()}
    by = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            by[x].append(i)
    both = Counter((a, b) for ids in by.values() for a in ids for b in ids if a < b)
    links = [(a, b) for (a, b), n in both.items() if den * n >= num * (len(sets[a]) + len(sets[b]) - n)]
    c = reach(docs, links)
    return {i: (len(sets[i]), c[i], c[i] == i) for i in docs}


def repeats(texts, length):
    """{doc_id: text} to {doc_id: list of removed byte flags}."""
    seen = Counter()
    raw = {i: (t or "").encode() for i, t in texts.items()}
    for b in raw.values():
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] += 1
    out = {}
    for i, b in raw.items():
        gone = [False] * len(b)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        out[i] = gone
    return out


def said_twice(texts, words):
    """{doc_id: text} to {doc_id: list of byte flags}: the words of passages of ``words`` words that stand elsewhere too, and the
    blanks between two such words."""
    toks = {i: [(m.group(), m.start(), m.end()) for m in WORD.finditer(t or "")] for i, t in texts.items()}
    seen = Counter(tuple(x[0] for x in w[k : k + words]) for w in toks.values() for k in range(len(w) - words + 1))
    out = {}
    for i, w in toks.items():
        t = texts[i] or ""
        gone = [False] * len(t.encode())
        byte = [0]
        for c in t:
            byte.append(byte[-1] + len(c.encode()))
        cut = {j for k in range(len(w) - words + 1) if seen[tuple(x[0] for x in w[k : k + words])] > 1 for j in range(k, k + words)}
        for j in cut:
            a, b = byte[w[j][1]], byte[w[j + 1][1] if j + 1 in cut else w[j][2]]
            gone[a:b] = [True] * (b - a)
        out[i] = gone
    return out


def scheduled(docs, share=1.5, cap=2.0, weights=(3, 1, 2), slots=1 << 18):
    """[(source, size)] to {source: (target, taken)}: water-filled targets; sources whose targets lie in one power of 64 have a
    schedule; each slot's golden-ratio point falls into a source's stretch of the targets and takes one block of words there,
    at most ``cap`` times the source's words."""
    size = Counter()
    for s, n in docs:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    full, left = {}, share * sum(size.values())
    while True:
        open_ = [s for s in order if s not in full]
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = [s for s in open_ if weight[s] * level >= cap * size[s]]
        if not over:
            break
        for s in over:
            full[s] = cap * size[s]
            left -= full[s]
    target = {s: full.get(s, weight[s] * level if open_ else 0) for s in order}
    out = {s: (target[s], 0) for s in order}
    golden, held = (sqrt(5) - 1) / 2, defaultdict(list)
    for s in order:
        if target[s] > 0:
            held[int(log(max(target[s], 1.0)) / log(64))].append(s)
    for mine in held.values():
        ends, upto, n = [], 0.0, Counter()
        for s in mine:
            upto += target[s]
            ends.append(upto)
        block = max(1, ceil(floor(upto) / max(slots, len(mine) * 64 * 64)))
        for i in range(max(1, round(floor(upto) / block))):
            n[mine[min(bisect_right(ends, (i + 0.5) * golden % 1.0 * upto), len(mine) - 1)]] += 1
        for s in mine:
            out[s] = (target[s], min(n[s] * block, int(cap * size[s])))
    return out


BW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(docs, items, size=13):
    win = {}
    for i, t in items.items():
        w = BW.findall(low(t))
        if w:
            win[i] = {tuple(w)} if len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
    by = defaultdict(set)
    for i, s in win.items():
        for x in s:
            by[x].add(i)
    sizes = sorted({len(x) for x in by})
    out = {}
    for d, t in docs.items():
        w, got, hit = BW.findall(low(t)), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in by:
                    got |= by[x]
                    hit |= set(range(k, k + n))
        out[d] = (len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(map(str, got))).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


def unigram(docs, train):
    toks = {i: [*WORD.findall(low(t)), None] for i, t in docs.items()}
    c = Counter(x for i in train for x in toks[i])
    n, v = sum(c.values()), len(c)
    return {i: (len(t), sum(c[x] > 0 for x in t), n, sum(log10((c[x] + 1) / (n + v + 1)) for x in t)) for i, t in toks.items()}
