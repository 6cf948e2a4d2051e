"""Language-model scoring with a sharded Elias-Fano n-gram trie.

Model: bigrams over the words of a text and one end mark. A seen bigram has the discounted probability
(c(vw) - D) / c(v); an unseen one the back-off weight D * T(v) / c(v) (T: different successors; 1 for an unknown context) times
the unigram probability (c(w) + 1) / (N + V + 1). All counts come from all training rows. Bigram probabilities and weights are
quantised downwards, so no context gives more than it has.

Data flow. Blocks of about ``BLOCK_BYTES`` of text send, to the shard of each context, the distinct bigrams with counts and
the documents that hold them, as packed blobs: a few rows a block, not one a token. A shard adds the training counts
up, writes its trie, maps it, scores every bigram sent to it by successor search, and answers with integer sums per
document. Words after an unseen bigram go on to the shard that counts them. Sums are whole numbers, so results do not
depend on the order of tasks.

Frequent words (at most ``4 / HOT_SHARE`` of them, found in a first pass over all rows and counted exactly in a second) are
no shard's burden: bigrams of two frequent words are scored in the blocks from a table of bounded size, and a frequent
context before other words is dealt over all shards by the following word; there its unseen mass is shared out
evenly over the shards, so only a frequent context's probabilities may differ from a sum of one either way. Words are 64-bit hashes, followers 40-bit fingerprints of them.

Edge cases: null, empty and wordless texts are the end mark alone; repeated rows are trained on and scored row by row; a
null id counts as training; without training rows every word is unknown; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from functools import partial
from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewing.llm.common import U64, blocks, bound_batches, checkpoint, starts_of, words_of, write_table
from sparsewing.llm.trie import FINGER, STEP, Trie, quantise

BLOCK_BYTES, SHARD_CHARS, HOT_SHARE, D = 4 << 20, 16 << 20, 1 / 256, 0.75
#: Sums per document count 1/UNIT of a decimal order of magnitude.
UNIT = 1 << 36
M40 = U64((1 << FINGER) - 1)
#: Hashes that stand for the start and the end of a text.
BOS, EOS = U64(0x123456789ABCDEF1), U64(0x0FEDCBA987654321)


def _logs(p: np.ndarray) -> np.ndarray:
    """-log10(p) in units."""
    return np.rint(-np.log10(p) * UNIT).astype(np.int64)


def _codes(c: np.ndarray) -> np.ndarray:
    return c.astype(np.int64) * (UNIT // STEP)


def _bigrams(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, words, documents of all bigrams of a block (one more than words in each document), and words per document."""
    w = words_of(batch)
    h, n = w.hash, w.n
    at = w.count_upto[:-1] + np.arange(len(n))
    total = len(h) + len(n)
    v, x = np.empty(total, dtype=U64), np.empty(total, dtype=U64)
    first, last = np.zeros(total, dtype=bool), np.zeros(total, dtype=bool)
    first[at], last[at + n] = True, True
    v[first], v[~first] = BOS, h
    x[last], x[~last] = EOS, h
    return v, x, np.repeat(np.arange(len(n)), n + 1), n


def _train(batch) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("train")).to_numpy(zero_copy_only=False).astype(bool)


# ---------------------------------------------------------------- frequent words
def _frequent(batches):
    """Words with a share of HOT_SHARE of a block's training tokens, and the tokens of every block (hash 0)."""
    for b in blocks(batches, BLOCK_BYTES):
        w = words_of(b)
        h = np.sort(w.hash[np.repeat(_train(b), w.n)])
        s = starts_of(h)
        c = np.diff(np.concatenate((s, [len(h)])))
        keep = c >= max(1.0, HOT_SHARE * len(h))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((h[s][keep].view(np.int64), [0]))), pa.array(np.concatenate((c[keep], [len(h)])))], names=["h", "c"])


def _hot_counts(batches, hot: np.ndarray):
    """Exact training counts of frequent words (with the marks) and of pairs of them, from all rows of a task."""
    k = len(hot)
    table, single, tokens, texts = np.zeros(k * k, dtype=np.int64), np.zeros(k, dtype=np.int64), 0, 0
    for b in blocks(batches, BLOCK_BYTES):
        v, x, doc, n = _bigrams(b)
        t = _train(b)
        on = t[doc]
        a, c = _place(hot, v[on]), _place(hot, x[on])
        single += np.bincount(a[a >= 0], minlength=k)
        both = (a >= 0) & (c >= 0)
        table += np.bincount(a[both] * k + c[both], minlength=k * k)
        tokens += int(on.sum())
        texts += int(t.sum())
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.concatenate((table, single, [tokens, texts])).tobytes()], pa.binary())], names=["part", "counts"])


def _sum_blobs(f: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, dtype=np.int64) for c in f.counts)
    return pd.DataFrame({"part": [0], "counts": [total.tobytes()]})


def _place(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each value in a sorted array, or -1."""
    if not len(sorted_):
        return np.full(len(x), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


class Hot:
    """What every task knows: frequent words, their counts, the pair table, tokens and texts of training."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, shards: int):
        k = len(words)
        self.words, self.shards = words, shards
        self.pair = counts[: k * k].reshape(k, k)
        self.single = counts[k * k : k * k + k].copy()
        self.tokens, self.texts = int(counts[-2]), int(counts[-1])
        self.single[_place(words, np.array([EOS]))[0]] = self.texts
        self.finger = np.sort(words & M40)
        self.by_finger = np.argsort(words & M40)
        # back-off among pairs of frequent words: their unseen mass
        c = np.maximum(self.single, 1)[:, None]
        self.seen = np.where(self.pair > 0, np.maximum(self.pair - D, 1e-9) / c, 0.0)
        self.rest = np.where(self.single > 0, D * np.maximum((self.pair > 0).sum(axis=1), 1) / c[:, 0], 1.0)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h & M40) >> U64(8)).astype(np.int64) % shards


# ---------------------------------------------------------------- blocks to shards
def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], dtype=np.int64).tobytes()
    return zlib.compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _unpack(raw: bytes) -> list[np.ndarray]:
    raw = zlib.decompress(raw)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    shape = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(n, 2)
    out, at = [], 8 + 16 * n
    for size, k in shape.tolist():
        out.append(np.frombuffer(raw, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[size], k, at))
        at += size * k
    return out


def _narrow(x: np.ndarray) -> np.ndarray:
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32)


ROWS = "kind int, shard int, block long, n long, data binary"
SCHEMA = pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
BIGRAMS, DOCS, SUMS, WORDS, TABLE, TOTAL = range(6)


def _row(kind: int, shard: int, block: int, data: bytes, n: int = 0) -> dict:
    return {"kind": kind, "shard": shard, "block": block, "n": n, "data": data}


def _send(batches, shared):
    hot: Hot = shared.value
    part, k = TaskContext.get().partitionId(), 0
    for b in blocks(batches, BLOCK_BYTES):
        block = part << 32 | k
        k += 1
        v, x, doc, n = _bigrams(b)
        t = _train(b)
        a, c = _place(hot.words, v), _place(hot.words, x)
        # frequent pairs, and the base counts of frequent contexts, need no shard
        both = (a >= 0) & (c >= 0)
        sums = np.zeros((4, len(n)), dtype=np.int64)
        i, j, d = a[both], c[both], doc[both]
        seen = hot.pair[i, j] > 0
        unseen = _codes(quantise(hot.rest[i])) + _uni(hot, hot.single[j])
        np.add.at(sums[0], d, np.where(seen, _codes(quantise(np.where(seen, hot.seen[i, j], 1.0))), unseen))
        np.add.at(sums[3], d, ~seen)
        words = (a >= 0) & (v != BOS)
        cnt = hot.single[a[words]]
        np.add.at(sums[1], doc[words], -_logs(cnt + 1.0))
        np.add.at(sums[2], doc[words], cnt > 0)
        ids = b.column(b.schema.get_field_index("doc_id"))
        none = ids.is_null().to_numpy(zero_copy_only=False)
        rows = [_row(DOCS, block % hot.shards, block, _pack(*sums, ids.fill_null(0).to_numpy(zero_copy_only=False), none.astype(np.uint8), t.astype(np.uint8), n + 1))]
        rest = ~both
        v, x, doc, frequent = v[rest], x[rest], doc[rest], a[rest] >= 0
        shard = np.where(frequent, shard_of(x, hot.shards), shard_of(v, hot.shards))
        x = x & M40
        o = np.lexsort((doc, x, v, shard))
        v, x, doc, shard = v[o], x[o], doc[o], shard[o]
        same = (v[1:] == v[:-1]) & (x[1:] == x[:-1])
        entry = np.concatenate(([0], np.cumsum(~(same & (doc[1:] == doc[:-1]))))) if len(v) else np.zeros(0, np.int64)
        s = starts_of(entry)  # one for each bigram and document
        times = np.diff(np.concatenate((s, [len(v)])))
        v, x, doc, shard = v[s], x[s], doc[s], shard[s]
        cut = np.searchsorted(shard, np.arange(hot.shards + 1))
        for q in range(hot.shards):
            lo, hi = int(cut[q]), int(cut[q + 1])
            if lo == hi:
                continue
            vs, xs = v[lo:hi], x[lo:hi]
            new = np.concatenate(([True], (vs[1:] != vs[:-1]) | (xs[1:] != xs[:-1])))
            first = np.flatnonzero(new)
            ctx = starts_of(vs[first])
            per_ctx = np.diff(np.concatenate((ctx, [len(first)])))
            docs_of = np.diff(np.concatenate((first, [hi - lo])))
            w = xs[first]
            rows.append(_row(BIGRAMS, q, block, _pack(vs[first][ctx], _narrow(per_ctx), (w >> U64(32)).astype(np.uint8), w.astype(np.uint32), _narrow(docs_of), _narrow(doc[lo:hi]), _narrow(times[lo:hi]), t.astype(np.uint8))))
        yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA)


def _uni(hot: Hot, count: np.ndarray) -> np.ndarray:
    """-log10((count + 1) / (N + V + 1)) but for the part of N and V, which is added once V is known (as a number of tokens)."""
    return _logs(count + 1.0)


# ---------------------------------------------------------------- shards
def _score(f: pd.DataFrame, shared) -> pd.DataFrame:
    hot: Hot = shared.value
    out = []
    shard = int(f.shard.iloc[0])
    docs = f[f.kind == DOCS]
    for r in docs.itertuples():
        out.append(_row(DOCS, shard, r.block, r.data))
    f = f[f.kind == BIGRAMS].sort_values("block")
    blocks_, got = f.block.tolist(), []
    keys, firsts = [], []
    for raw in f.data:
        v, per, hi, lo, docs_of, doc, times, t = _unpack(raw)
        firsts.append(v)
        keys.append(hi.astype(U64) << U64(32) | lo)
        got.append((per, docs_of, doc, times, t.astype(bool)))
    if not blocks_:
        return pd.DataFrame(out, columns=SCHEMA.names)
    size = [len(k) for k in keys]
    ctx, vid = np.unique(np.concatenate(firsts), return_inverse=True)
    key, at = np.concatenate(keys), 0
    del keys, f
    for (per, *_), v in zip(got, firsts, strict=True):
        n = int(per.sum(dtype=np.int64))
        key[at : at + n] |= np.repeat(vid[: len(v)].astype(U64) << U64(FINGER), per)
        vid, at = vid[len(v) :], at + n
    del firsts, vid
    o = np.argsort(key, kind="stable")
    s = starts_of(key[o])
    uniq = key[o[s]]
    of = np.empty(len(key), dtype=np.int32)
    of[o] = np.repeat(np.arange(len(s), dtype=np.int32), np.diff(np.concatenate((s, [len(o)]))))
    del key, o
    cut = np.cumsum([0, *size])
    count = np.zeros(len(uniq), dtype=np.int64)
    for i, (_, docs_of, doc, times, t) in enumerate(got):
        on = t[doc]
        np.add.at(count, np.repeat(of[cut[i] : cut[i + 1]], docs_of)[on], times[on].astype(np.int64))
    uvid = (uniq >> U64(FINGER)).astype(np.int32)
    here = np.bincount(uvid, weights=count, minlength=len(ctx)).astype(np.int64)
    kinds = np.bincount(uvid, weights=count > 0, minlength=len(ctx)).astype(np.int64)
    frequent = _place(hot.words, ctx)
    # a frequent context is dealt over all shards: its count is known, its unseen mass here covers one shard of the words
    total = np.where(frequent >= 0, hot.single[np.maximum(frequent, 0)], here)
    scale = np.where(frequent >= 0, hot.shards, 1)
    weight = np.where(total > 0, np.minimum(D * np.maximum(kinds, 0.5) * scale / np.maximum(total, 1), 1.0), 1.0)
    on = count > 0
    finger = uniq & M40
    per = np.bincount(uvid[on], minlength=len(ctx))
    trie = Trie(Trie.pack(ctx, np.concatenate(([0], np.cumsum(per))), finger[on], quantise(weight), quantise((count[on] - D) / total[uvid[on]])))
    code, back = (np.empty(len(uniq), dtype=np.int16) for _ in range(2))
    for i in range(0, len(uniq), 1 << 18):
        code[i : i + (1 << 18)], back[i : i + (1 << 18)] = trie.search(ctx[uvid[i : i + (1 << 18)]], finger[i : i + (1 << 18)])
    del trie
    hot_at = _place(hot.finger, finger)
    unseen = code < 0
    cost = np.where(unseen, _codes(back), _codes(code))
    known_word = unseen & (hot_at >= 0)
    cost[known_word] += _uni(hot, hot.single[hot.by_finger[hot_at[known_word]]])
    # the base part of the context's own token, where its count is not known everywhere
    plain = frequent < 0
    own = np.where(plain, -_logs(np.where(plain, here, 0) + 1.0), 0)
    known = plain & (here > 0)
    going = unseen & (hot_at < 0)
    go: list[tuple[np.ndarray, ...]] = []
    for i, (_, docs_of, doc, times, t) in enumerate(got):
        entry = np.repeat(of[cut[i] : cut[i + 1]], docs_of)
        m = times.astype(np.int64)
        sums = np.zeros((4, len(t)), dtype=np.int64)
        np.add.at(sums[0], doc, cost[entry] * m)
        np.add.at(sums[1], doc, own[uvid[entry]] * m)
        np.add.at(sums[2], doc, known[uvid[entry]] * m)
        np.add.at(sums[3], doc, unseen[entry] * m)  # tokens whose N and V part is still to come
        idx = np.flatnonzero((sums != 0).any(axis=0))
        out.append(_row(SUMS, shard, blocks_[i], _pack(_narrow(idx), sums[0, idx], sums[1, idx], _narrow(sums[2, idx]), _narrow(sums[3, idx]))))
        k = np.flatnonzero(going[entry])
        if len(k):
            go.append((finger[entry[k]], doc[k].astype(np.uint32), np.full(len(k), i, dtype=np.uint32), times[k].astype(np.uint32)))
    # words after unseen bigrams go on to the shard that counts them
    if go:
        w, d, b, m = (np.concatenate(x) for x in zip(*go, strict=True))
        q = shard_of(w, hot.shards)
        o = np.lexsort((w, q))
        w, d, b, q, m = w[o], d[o], b[o], q[o], m[o]
        cut = np.searchsorted(q, np.arange(hot.shards + 1))
        ids = np.array(blocks_, dtype=np.int64)
        for k in np.flatnonzero(np.diff(cut)):
            i, j = int(cut[k]), int(cut[k + 1])
            out.append(_row(WORDS, int(k), shard, _pack(ids, w[i:j], _narrow(b[i:j]), _narrow(d[i:j]), _narrow(m[i:j]))))
    seen = (frequent < 0) & (here > 0)
    fo = np.argsort(ctx[seen] & M40, kind="stable")
    out.append(_row(TABLE, shard, -1, _pack((ctx[seen] & M40)[fo], here[seen][fo])))
    out.append(_row(TOTAL, shard, -1, b"", int(seen.sum())))
    return pd.DataFrame(out, columns=SCHEMA.names)


def _words(f: pd.DataFrame) -> pd.DataFrame:
    """Unigram parts of words after unseen bigrams, from the table of their shard."""
    t = f[f.kind == TABLE]
    finger, count = (_unpack(t.data.iloc[0]) if len(t) else (np.zeros(0, U64), np.zeros(0, U64)))
    got: dict[int, list] = {}
    for raw in f[f.kind == WORDS].sort_values("block").data:
        ids, w, b, d, m = _unpack(raw)
        at = _place(finger, w)
        c = np.where(at >= 0, count[np.maximum(at, 0)].astype(np.int64) if len(count) else 0, 0)
        cost = _logs(c + 1.0) * m.astype(np.int64)
        o = np.argsort(b, kind="stable")
        for i, j in zip(s := starts_of(b[o]), [*s[1:], len(o)], strict=True):
            got.setdefault(int(ids[b[o[i]]].astype(np.int64)), []).append((d[o[i:j]].astype(np.int64), cost[o[i:j]]))
    out = []
    for blk, parts in got.items():
        d, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        idx = np.unique(d)
        total = np.zeros(len(idx), dtype=np.int64)
        np.add.at(total, np.searchsorted(idx, d), c)
        zero = np.zeros(len(idx), dtype=np.int64)
        out.append(_row(SUMS, int(f.shard.iloc[0]), blk, _pack(_narrow(idx), total, zero, zero, zero)))
    return pd.DataFrame(out, columns=SCHEMA.names)


def _finish(f: pd.DataFrame, tokens: int, texts: int, kinds: int) -> pd.DataFrame:
    """Adds up the sums of a block's documents. base: the unigram model; score: the bigram model."""
    got = _unpack(f[f.kind == DOCS].data.iloc[0])
    s = np.stack([a.astype(np.int64) for a in got[:4]])
    ids, none, train, n = got[4].astype(np.int64), got[5] > 0, got[6] > 0, got[7].astype(np.int64)
    for raw in f[f.kind == SUMS].data:
        idx, *parts = _unpack(raw)
        for k in range(4):
            s[k, idx] += parts[k].astype(np.int64)
    norm = log10(tokens + kinds + 1)
    base = s[1] / UNIT + log10(texts + 1) - n * norm
    ids = pd.arrays.IntegerArray(ids, none)
    return pd.DataFrame({"doc_id": ids, "held_out": ~train, "n_tokens": n, "n_known": s[2] + (texts > 0), "train_tokens": tokens, "base_score": base, "score": -(s[0] / UNIT) - s[3] * norm})


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, train) to one row per document: OUT. Rows with ``train`` are learned from; all are scored."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "train")
    chars = int(docs.agg(F.sum(F.length("text"))).first()[0] or 0)
    shards = max(8, chars // SHARD_CHARS + 1)
    often = docs.mapInArrow(_frequent, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    often = checkpoint(often)
    n = often.filter("h = 0").agg(F.sum("c")).first()[0] or 0
    hot = [r.h for r in often.filter((F.col("h") != 0) & (F.col("c") >= max(1.0, HOT_SHARE / 2 * n))).select("h").collect()]
    hot = np.unique(np.concatenate((np.array(hot, dtype=np.int64).view(U64), [BOS, EOS])))
    got = docs.mapInArrow(partial(_hot_counts, hot=hot), "part int, counts binary")
    # sums are taken in two steps, so no task holds more tables than partitions in its share
    got = got.withColumn("part", F.spark_partition_id() % 16).groupBy("part").applyInPandas(_sum_blobs, "part int, counts binary").collect()
    counts = sum((np.frombuffer(r.counts, dtype=np.int64) for r in got), np.zeros(len(hot) * (len(hot) + 1) + 2, dtype=np.int64))
    known = Hot(hot, counts, shards)
    shared = spark.sparkContext.broadcast(known)
    sent = docs.mapInArrow(lambda it: _send(it, shared), ROWS)
    scored = write_table(sent.groupBy("shard").applyInPandas(lambda f: _score(f, shared), ROWS), "scored")
    kinds = int(scored.filter(F.col("kind") == TOTAL).agg(F.sum("n")).first()[0] or 0)
    named = hot[(known.single > 0) & (hot != BOS)]
    kinds += len(named)
    more = scored.filter(F.col("kind").isin(WORDS, TABLE)).groupBy("shard").applyInPandas(_words, ROWS)
    every = scored.filter(F.col("kind").isin(DOCS, SUMS)).unionByName(more)
    return every.groupBy("block").applyInPandas(partial(_finish, tokens=known.tokens, texts=known.texts, kinds=kinds), OUT)
