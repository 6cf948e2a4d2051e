"""Benchmark decontamination with an FM-index per training shard.

A shard is what one task reads, cut where the indexed words reach ``SHARD_WORDS``. A benchmark window is ``size`` words of
an item in a row (a shorter item is one window). Words that no item has cannot lie in an occurrence, so each shard indexes
exactly the runs of item words that are long enough for the shortest window; nothing that could match is left out. The
windows are found by backward search through wavelet-tree ranks, their places by sampled suffix positions, and their
spans are merged per document.

The benchmark is read in blocks of about ``BENCH_CHARS`` characters, each sent to the tasks in turn, so that what is
broadcast has a bound whatever the benchmark's size; with several blocks each row of the documents gets a key, once, and
the blocks' spans are merged by it.

Edge cases: null or wordless texts have no words, no hits and are clean; null or wordless items match nothing; equal
items count each with its own id, null item ids are left out; repeated documents are judged row by row; an empty
benchmark or table gives clean rows or none; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewing.llm.common import SIGN, Words, blocks, bound_batches, bytes_of, words_of, write_table
from sparsewing.llm.fmindex import FMIndex

SHARD_WORDS, BENCH_CHARS = 1 << 20, 2_000_000


class Windows:
    """Windows of a block of items over a vocabulary of word hashes: symbols 1..V, right-aligned; ids by window."""

    def __init__(self, ids: list[str], texts: list[str], size: int):
        v, o = bytes_of(pa.array(texts, pa.large_string()))
        w = Words(v, o, SIGN)
        self.size = size
        self.vocab, sym = np.unique(w.hash, return_inverse=True)
        sym += 1
        rows, length, item = [], [], []
        for i in range(len(ids)):
            x = sym[w.count_upto[i] : w.count_upto[i + 1]]
            n = min(len(x), size)
            for k in range(len(x) - n + 1 if n else 0):
                rows.append(np.concatenate((np.zeros(size - n, np.int64), x[k : k + n])))
                length.append(n)
                item.append(i)
        rows = np.array(rows, dtype=np.int64).reshape(-1, size)
        self.rows, inv = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, np.zeros(0, np.int64))
        inv = np.asarray(inv).reshape(-1)
        self.length = (self.rows > 0).sum(axis=1)
        o = np.lexsort((item, inv)) if len(inv) else np.zeros(0, np.int64)
        pair = np.unique(np.stack([inv[o], np.array(item, dtype=np.int64)[o]], axis=1), axis=0) if len(inv) else np.zeros((0, 2), np.int64)
        self.item = pair[:, 1]
        self.item_upto = np.searchsorted(pair[:, 0], np.arange(len(self.rows) + 1))
        self.ids = np.array(ids, dtype=object)
        self.least = int(self.length.min()) if len(self.rows) else 0


OUT = "n_words long, spans array<struct<s:int,e:int>>, items array<string>"


def _flush(held: list, win: Windows):
    """Builds the index of a shard and yields its documents' rows. held: (columns kept, n_words, run doc, run word, run length, symbols)."""
    kept = pa.Table.from_batches([h[0] for h in held]).combine_chunks()
    n = np.concatenate([h[1] for h in held])
    base = np.cumsum([0, *[len(h[1]) for h in held]])
    doc = np.concatenate([h[2] + b for h, b in zip(held, base, strict=False)])
    word, size = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
    spans, items = [[] for _ in n], [[] for _ in n]
    if len(doc):
        seq = np.concatenate([h[5] for h in held])
        start = np.concatenate(([0], np.cumsum(size + 1)[:-1]))  # a separator, symbol 0, follows every run
        text = np.zeros(int(size.sum() + len(size)), dtype=np.int64)
        text[np.arange(len(seq)) + np.repeat(np.arange(len(size)), size)] = seq
        fm = FMIndex(text, len(win.vocab))
        lo, hi = fm.search(win.rows, win.length)
        which = np.repeat(np.arange(len(lo)), hi - lo)
        at = fm.locate(np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[which])
        edge = np.zeros(len(text) + 1, dtype=np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + win.length[which], -1)
        hit = np.concatenate(([0], (np.cumsum(edge[:-1]) > 0).astype(np.int8), [0]))
        s, e = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
        run = np.searchsorted(start, s, side="right") - 1
        for r, a, b in zip(run.tolist(), (s - start[run] + word[run]).tolist(), (e - start[run] + word[run]).tolist(), strict=True):
            spans[doc[r]].append({"s": a, "e": b})
        d = doc[np.searchsorted(start, at, side="right") - 1]
        got = np.unique(np.stack([d, which], axis=1), axis=0)
        for r, k in got.tolist():
            items[r].extend(win.item[win.item_upto[k] : win.item_upto[k + 1]].tolist())
        items = [sorted({win.ids[k] for k in x}) if x else [] for x in items]
    yield pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in kept.columns), pa.array(n, pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(items, pa.list_(pa.string()))], names=[*kept.column_names, "n_words", "spans", "items"])


def _scan(batches, win: Windows):
    held, words = [], 0
    for b in blocks(batches):
        w = words_of(b, SIGN)
        if len(win.vocab):
            at = np.searchsorted(win.vocab, w.hash)
            at[at == len(win.vocab)] = 0
            known = win.vocab[at] == w.hash
        else:
            at, known = np.zeros(len(w.hash), np.int64), np.zeros(len(w.hash), bool)
        # runs of known words of one document
        k = np.concatenate(([0], known.astype(np.int8), [0]))
        begin = known & ((k[:-2] == 0) | np.concatenate(([True], w.doc[1:] != w.doc[:-1]))[: len(known)])
        final = known & ((k[2:] == 0) | np.concatenate((w.doc[1:] != w.doc[:-1], [True]))[: len(known)])
        s, e = np.flatnonzero(begin), np.flatnonzero(final) + 1
        keep = e - s >= max(win.least, 1)
        s, e = s[keep], e[keep]
        idx = np.repeat(s - np.concatenate(([0], np.cumsum(e - s)[:-1])) if len(s) else s, e - s) + np.arange(int((e - s).sum()))
        held.append((b.select([c for c in b.schema.names if c != "text"]), w.n, w.doc[s], s - w.count_upto[w.doc[s]], e - s, at[idx] + 1))
        words += len(idx) + len(w.n)
        if words >= SHARD_WORDS:
            yield from _flush(held, win)
            held, words = [], 0
    if held:
        yield from _flush(held, win)


def contamination(docs: DataFrame, bench: DataFrame, size: int = 13, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ``keep``, n_words, n_hit, n_items, items, spans), one row per document: words that lie in an occurrence of a
    window of ``size`` item words, the items found, and the merged spans [s, e) of words. ``keep``: columns to carry along."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    bench = bench.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null and text is not null")
    chars = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / BENCH_CHARS))
    if n > 1:
        docs = write_table(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    named = [f for f in docs.schema.fields if f.name != "text"]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in named), OUT])
    found = None
    for k in range(n):
        rows = bench.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
        win = spark.sparkContext.broadcast(Windows([r.item_id for r in rows], [r.text for r in rows], size))
        part = docs.mapInArrow(lambda it, win=win: _scan(it, win.value), out)
        found = part if found is None else found.unionByName(part)
    if n > 1:
        found = found.groupBy(*(f.name for f in named), "n_words").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        step = "case when size(a) > 0 and element_at(a, -1).e >= x.s then concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).s as s, greatest(element_at(a, -1).e, x.e) as e))) else concat(a, array(x)) end"
        found = found.withColumn("spans", F.expr(f"aggregate(array_sort(spans), cast(array() as array<struct<s:int,e:int>>), (a, x) -> {step})"))
    return found.select("doc_id", *keep, "n_words", F.expr("aggregate(spans, 0L, (a, x) -> a + (x.e - x.s))").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_sort("items").alias("items"), "spans")


def judged(found: DataFrame) -> DataFrame:
    """Adds the digest of the item ids and the verdict: some hit, and at least one word in twenty."""
    return found.withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256)).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
