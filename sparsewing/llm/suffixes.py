"""Removal of repeated strings with suffix arrays built by two-stage sorting.

A byte goes when a string of ``length`` bytes that covers it also starts elsewhere, in any document; a word goes when a
passage of ``words`` words that covers it also starts elsewhere, whatever blanks stand between them. Either rule may be
left out. Matches do not cross documents, overlaps count, and all strings are judged on the input. Both rules run
the same steps over elements: bytes, or 64-bit hashes of words.

1. Anchors. In every string of ``length`` elements the smallest hash among its substrings of ``ANCHOR`` elements (the
   leftmost of equals) is its anchor. The choice depends on the string alone, so equal strings have equal anchors at equal
   offsets. Starts with one anchor in a row form a piece: the stretch of text that holds exactly their strings. Only
   anchors, digests of pieces (blake2b), ids and positions are shuffled.
2. Pieces with equal anchors and digests fold into one with a count; a piece that occurs twice is repeated as a whole. What is
   left open are pieces that occur once but share their anchor with other pieces. Their elements, and one copy of each
   piece beside them, are fetched by a second read of just those documents and dealt into buckets by anchor.
3. Each bucket is sorted as one text by ``two_stage``: suffixes smaller than their successors are sorted directly, the rest
   are induced by bucket scans. Adjacent common prefixes of ``length`` elements or more mark repeated starts. Words are
   numbered within a bucket first, which leaves two bytes of each.
   An anchor with more than ``HOT`` different pieces is first cut: by ranges of ``STRIDE`` starts together with the
   elements that all strings of a range share, and where that is still hot, by single strings. This loses nothing, since
   equal strings agree in both keys, and no bucket holds an unbounded group.
4. Repeated starts become spans, are merged per document, and the rest stays.

Edge cases: null text is empty, a text shorter than ``length`` has no strings; very long texts are anchored in segments that
share ``length - 1`` elements; repeated rows, with or without the same id, repeat each other; null ids are kept as null;
an empty table gives an empty result.
"""

from __future__ import annotations

from hashlib import blake2b, sha256
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewing.llm.common import BLOCK, BYTE, U64, Words, blocks, bound_batches, bytes_of, checkpoint, drop_path, mix64, partitions, powers, shared_path, starts_of

LENGTH, PASSAGE, HOT, STRIDE, BUCKET = 400, 51, 256, 24, 1 << 19
#: Beyond so many entries positions and spans reach the texts by a shuffled join instead of a broadcast one; an entry takes
#: about 80 bytes.
BROADCAST = 1_000_000


@dataclass(frozen=True)
class Rule:
    """Strings of ``length`` elements of ``width`` bytes: 1, the bytes of the text, or 8, the hashes of its words."""

    length: int
    width: int = 1

    @property
    def anchor(self) -> int:
        """Elements of an anchor."""
        return max(1, min(64 if self.width == 1 else 8, self.length // 2))

    @property
    def segment(self) -> int:
        return BLOCK // self.width

    def elements(self, batch) -> tuple[np.ndarray, np.ndarray]:
        """All elements of a block, and the documents' borders."""
        v, o = bytes_of(batch.column(batch.schema.get_field_index("text")))
        if self.width == 1:
            return v, o
        w = Words(v, o, lower=False)
        return w.hash, w.count_upto


#: Times that eight bytes are compared at once.
_ROUNDS = 4


# ---------------------------------------------------------------- suffix array
def two_stage(text: bytes, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes at least. A zero byte must end the text."""
    t = np.frombuffer(text, dtype=np.uint8)
    n = len(t)
    # smaller than the successor: the next different byte is larger
    run = np.flatnonzero(np.concatenate((t[1:] != t[:-1], [True])))  # last positions of runs of one byte
    up = np.zeros(len(run), dtype=bool)
    up[:-1] = t[run[:-1] + 1] > t[run[:-1]]
    up[-1] = True  # the end is smaller than anything; it counts as directly sorted
    small = np.repeat(up, np.diff(np.concatenate(([-1], run))))
    direct = _sorted(np.flatnonzero(small), t, text, depth)
    cut = np.searchsorted(t[direct], np.arange(257))
    heads: list[list[np.ndarray]] = [[] for _ in range(256)]  # induced suffixes of each bucket, in order
    out = []
    for c in np.unique(t).tolist():
        own, first = direct[cut[c] : cut[c + 1]], heads[c]
        k = 0
        while k < len(first):  # larger ones stand first in a bucket; runs of c induce more of them
            _induce(first[k], t, small, heads)
            k += 1
        _induce(own, t, small, heads)
        out.extend(first)
        out.append(own)
    return np.concatenate(out)


def _sorted(p: np.ndarray, t: np.ndarray, text: bytes, depth: int) -> np.ndarray:
    """Positions in the order of the ``depth`` bytes from each: eight bytes at a time while many are equal, then group by
    group."""
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate((t, np.zeros(8 * _ROUNDS + 8, dtype=np.uint8))), 8)
    group, tied = np.zeros(len(p), dtype=np.int64), np.arange(len(p))
    for k in range(0, min(8 * _ROUNDS, depth), 8):
        key = eight[np.minimum(p[tied] + k, len(t))].copy().view(">u8")[:, 0].astype(U64)
        o = np.lexsort((key, group[tied]))
        p[tied], key = p[tied[o]], key[o]
        new = np.ones(len(tied) + 1, dtype=bool)
        new[1:-1] = (key[1:] != key[:-1]) | (group[tied[1:]] != group[tied[:-1]])
        group[tied] = tied[np.maximum.accumulate(np.where(new[:-1], np.arange(len(tied)), 0))]
        tied = tied[~(new[:-1] & new[1:])]
        if not len(tied):
            return p
    k += 8
    s = starts_of(group[tied])
    for a, b in zip(tied[s].tolist(), (tied[[*s[1:] - 1, len(tied) - 1]] + 1).tolist(), strict=True):
        p[a:b] = sorted(p[a:b].tolist(), key=lambda i: text[i + k : i + depth])
    return p


def _induce(done: np.ndarray, t: np.ndarray, small: np.ndarray, heads: list) -> None:
    p = done[done > 0] - 1
    p = p[~small[p]]
    if not len(p):
        return
    c = t[p]
    o = np.argsort(c, kind="stable")
    p, c = p[o], c[o]
    s = starts_of(c)
    for a, b in zip(s, [*s[1:], len(p)], strict=True):
        heads[c[a]].append(p[a:b])


def common_prefixes(text: bytes, sa: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa`` (0 for the first), counted up to ``most``."""
    step = 32
    t = np.frombuffer(text + bytes(most + step), dtype=np.uint8)
    a, b = sa[1:].astype(np.int64), sa[:-1].astype(np.int64)
    lcp, todo, k = np.zeros(len(sa), dtype=np.int64), np.arange(len(a)), 0
    near = np.lib.stride_tricks.sliding_window_view(t, step)
    while len(todo) and k < most:
        same = np.ones(len(todo), dtype=bool)
        for i in range(0, len(todo), 1 << 15):
            x, y = near[a[todo[i : i + (1 << 15)]] + k], near[b[todo[i : i + (1 << 15)]] + k]
            d = x != y
            same[i : i + (1 << 15)] = ~d.any(axis=1)
            stop = np.flatnonzero(~same[i : i + (1 << 15)])
            lcp[todo[i + stop] + 1] = np.minimum(k + d[stop].argmax(axis=1), most)
        todo = todo[same]
        k += step
    lcp[todo + 1] = most
    return lcp


def _numbered(pieces: list[bytes]) -> tuple[list[bytes], int]:
    """Words (8 bytes each) as numbers of one, two or three bytes, in the order of their first differing byte or any other."""
    n = np.array([len(p) // 8 for p in pieces])
    kinds, code = np.unique(np.frombuffer(b"".join(pieces), dtype=U64), return_inverse=True)
    width = 1 if len(kinds) < 255 else 2 if len(kinds) < 65535 else 3
    code = (code + 1).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - width :].tobytes()
    cut = np.concatenate(([0], np.cumsum(n))) * width
    return [code[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], width


def repeated_starts(pieces: list[bytes], live: list[int], rule: Rule) -> list[np.ndarray]:
    """Per piece: which of its first ``live`` starts begin a string of the rule's length that begins anywhere else here."""
    width = 1
    if rule.width > 1:
        pieces, width = _numbered(pieces)
    text, length = b"\0".join(pieces) + b"\0", rule.length * width
    size = np.array([len(p) for p in pieces])
    base = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    ok = np.zeros(len(text), dtype=bool)
    for a, m in zip(base, live, strict=True):
        ok[a : a + m * width : width] = True
    sa = two_stage(text, length)
    sa = sa[ok[sa]]
    same = common_prefixes(text, sa, length) >= length
    hit = np.zeros(len(text), dtype=bool)
    hit[sa[same]] = True
    hit[sa[np.flatnonzero(same) - 1]] = True
    return [hit[a : a + m * width : width] for a, m in zip(base, live, strict=True)]


# ---------------------------------------------------------------- anchors and pieces
def _units(o: np.ndarray, length: int, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, and segments of long ones: (row, first element within the block, elements)."""
    rows, first, size = [], [], []
    for r in np.flatnonzero(np.diff(o) >= length).tolist():
        a, b = int(o[r]), int(o[r + 1])
        for s in range(a, b - length + 1, segment):
            rows.append(r)
            first.append(s)
            size.append(min(segment + length - 1, b - s))
    return np.array(rows, np.int64), np.array(first, np.int64), np.array(size, np.int64)


def _anchored(x: np.ndarray, length: int, anchor: int):
    """For the elements of one unit or several glued ones: anchor hashes, and the anchor position chosen for each start (valid
    only where the string stays inside its unit)."""
    n = len(x)
    p, q = powers(n + 1)
    h = np.zeros(n + 1, dtype=U64)
    np.cumsum((BYTE[x] if x.dtype == np.uint8 else x) * p[:n], out=h[1:])
    a = mix64((h[anchor:] - h[:-anchor]) * q[: n - anchor + 1])
    bits = U64(22)
    m = (a >> bits << bits) | np.arange(len(a), dtype=U64)
    win, have = length - anchor + 1, 1
    while have * 2 <= win:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if win > have:
        m = np.minimum(m[: -(win - have)], m[win - have :])
    return a, (m & ((U64(1) << bits) - U64(1))).astype(np.int64)


def _glued(v: np.ndarray, o: np.ndarray, rule: Rule):
    """Units glued to at most about a segment each time; yields (row, start in document, elements, unit offsets)."""
    rows, first, size = _units(o, rule.length, rule.segment)
    i = 0
    while i < len(rows):
        j = i + 1
        total = int(size[i])
        while j < len(rows) and total + size[j] <= rule.segment:
            total += int(size[j])
            j += 1
        x = np.concatenate([v[f : f + s] for f, s in zip(first[i:j], size[i:j], strict=True)])
        yield rows[i:j], first[i:j] - o[rows[i:j]], x, np.concatenate(([0], np.cumsum(size[i:j])))
        i = j


def _digests(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    raw, w = memoryview(x.tobytes()), x.itemsize
    return np.frombuffer(b"".join([blake2b(raw[a:b], digest_size=8).digest() for a, b in zip((lo * w).tolist(), (hi * w).tolist(), strict=True)]), dtype=np.int64)


def _pieces(batches, rule: Rule):
    length = rule.length
    for b in blocks(batches):
        v, o = rule.elements(b)
        rid = b.column(b.schema.get_field_index("rid")).to_numpy(zero_copy_only=False)
        for rows, begin, x, u in _glued(v, o, rule):
            a, best = _anchored(x, length, rule.anchor)
            starts = np.concatenate([np.arange(s, e - length + 1) for s, e in zip(u[:-1], u[1:], strict=True)])
            pos = best[starts]
            s = starts_of(pos)
            lo = starts[s]
            live = np.diff(np.concatenate((s, [len(pos)])))
            whole = _digests(x, lo, lo + live + length - 1)
            unit = np.searchsorted(u, lo, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(rid[rows[unit]], pa.int64()), pa.array(lo - u[unit] + begin[unit], pa.int64()), pa.array(live, pa.int32()), pa.array(a[pos[s]].view(np.int64)), pa.array(whole), pa.array(pos[s] - lo, pa.int32())], names=["rid", "at", "live", "anchor", "whole", "off"])


def _fetch(batches, rule: Rule):
    for b in blocks(batches):
        v, o = rule.elements(b)
        got: list = []
        for r, want in enumerate(b.column(b.schema.get_field_index("want")).to_pylist()):
            got.extend({**w, "piece": v[o[r] + w["at"] : o[r] + w["at"] + w["live"] + rule.length - 1].tobytes()} for w in want)
        if got:
            yield pa.RecordBatch.from_pylist(got, schema=pa.schema([("rid", pa.int64()), ("at", pa.int64()), ("live", pa.int32()), ("anchor", pa.int64()), ("off", pa.int32()), ("rows", pa.int64()), ("hot", pa.bool_()), ("piece", pa.binary())]))


PIECE = "rid long, at long, live int, anchor long, off int, rows long, hot boolean, piece binary"
SPANS = "rid long, s long, e long"


def _ranges(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _meeting(f: pd.DataFrame, rule: Rule) -> np.ndarray:
    """Which pieces can share a string. A string holds its anchor and at least half of the other elements on one side of it, so
    pieces that share one have an equal half: the anchor with so many elements before it, or after it. Pieces whose halves
    are their own are left out, as are halves that only folded pieces have, whose strings are known to repeat."""
    w, a = rule.width, rule.anchor
    half = -(-(rule.length - a) // 2)
    seen: dict = {}
    for i, (anchor, off, rows, p) in enumerate(zip(f.anchor, f.off, f.rows, f.piece, strict=True)):
        if off >= half:
            seen.setdefault((anchor, 0, p[(off - half) * w : (off + a) * w]), [0]).append(i)
            seen[anchor, 0, p[(off - half) * w : (off + a) * w]][0] += rows == 1
        if (off + a + half) * w <= len(p):
            seen.setdefault((anchor, 1, p[off * w : (off + a + half) * w]), [0]).append(i)
            seen[anchor, 1, p[off * w : (off + a + half) * w]][0] += rows == 1
    keep = np.zeros(len(f), dtype=bool)
    for single, *who in seen.values():
        if len(who) > 1 and single:
            keep[who] = True
    return keep


def _bucket(f: pd.DataFrame, rule: Rule) -> pd.DataFrame:
    out = []
    f = f[_meeting(f, rule)].sort_values(["anchor", "rid", "at"])
    if f.empty:
        return pd.DataFrame({"rid": [], "s": [], "e": []}).astype("int64")
    for hit, rid, at, rows in zip(repeated_starts(list(f.piece), list(f.live), rule), f.rid, f["at"], f.rows, strict=True):
        if rows == 1:
            s, e = _ranges(hit)
            out.extend((rid, at + a, at + b - 1 + rule.length) for a, b in zip(s.tolist(), e.tolist(), strict=True))
    return pd.DataFrame(out, columns=["rid", "s", "e"]).astype("int64")


def _cut(batches, rule: Rule, stride: int):
    """Cuts each piece into ranges of ``stride`` starts by their distance to the anchor, keyed by what the range's strings
    share, with a digest of each range."""
    length, wide = rule.length, rule.width
    key = lambda raw: int.from_bytes(blake2b(raw, digest_size=8).digest(), "big", signed=True)
    for b in batches:
        rows = []
        for w in b.to_pylist():
            k, p = 0, w["piece"]
            while k < w["live"]:
                d = w["off"] - k  # distance of the start to the anchor; ranges are aligned on it
                block = d // stride
                m = min(w["live"] - k, d - block * stride + 1)
                last = w["off"] - block * stride  # the last start of the aligned range, whose first is stride - 1 before
                core = p[last * wide : (last - stride + 1 + length) * wide]
                part = p[k * wide : (k + m + length - 1) * wide]
                rows.append({"rid": w["rid"], "at": w["at"] + k, "live": m, "anchor": key(core + block.to_bytes(4, "big", signed=True) + w["anchor"].to_bytes(8, "big", signed=True)), "off": d, "rows": w["rows"], "hot": False, "piece": part, "h": key(part)})
                k += m
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=b.schema.append(pa.field("h", pa.int64())))


def _sorted_buckets(open_: DataFrame, rule: Rule) -> DataFrame:
    """Spans of repeated starts among pieces that meet under ``anchor``; no anchor is hot."""
    n = max(partitions(open_.sparkSession), int((open_.agg(F.sum(F.length("piece"))).first()[0] or 0) // BUCKET))
    return open_.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(n))).groupBy("bucket").applyInPandas(partial(_bucket, rule=rule), SPANS)


def _open_cut(hot: DataFrame, rule: Rule) -> DataFrame:
    """Spans from pieces of hot anchors: by ranges of starts, then by single strings where a range is hot again."""
    spans = None
    named = [x.split()[0] for x in PIECE.split(", ")]
    for stride in (STRIDE, 1):
        per = checkpoint(hot.mapInArrow(partial(_cut, rule=rule, stride=stride), PIECE + ", h long"))
        one = per.groupBy("anchor", "h").agg(F.sum("rows").alias("rows"), F.min(F.struct("rid", "at", "live", "off", "hot", "piece")).alias("x"))
        one = checkpoint(one.select("anchor", "h", "rows", "x.*"))
        keys = one.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("rows").alias("all"))
        many = one.filter("rows > 1").select("anchor", "h")
        same = per.filter("rows = 1").join(many, ["anchor", "h"]).select("rid", F.col("at").alias("s"), (F.col("at") + F.col("live") + rule.length - 1).alias("e"))
        left = one.join(keys.filter("kinds > 1"), "anchor")
        part = same.unionByName(_sorted_buckets(checkpoint(left.filter(F.col("kinds") <= HOT).select(named)), rule))
        spans = part if spans is None else spans.unionByName(part)
        hot = checkpoint(left.filter(F.col("kinds") > HOT).select(named))
        if stride == 1 or hot.isEmpty():
            break
    return spans


def _table(df: DataFrame, name: str, held: list[str]) -> DataFrame:
    """Writes a table of columns to the shared folder, which takes less room than a checkpoint, and names it in ``held``."""
    held.append(shared_path(df.sparkSession, name))
    df.write.parquet(held[-1])
    return df.sparkSession.read.schema(df.schema).parquet(held[-1])


def repeated_spans(texts: DataFrame, rule: Rule) -> DataFrame:
    """(rid, spans) of the texts (rid, text) that have repeated strings; spans are merged, sorted [s, e) ranges of elements."""
    spark, held = texts.sparkSession, []
    bound_batches(spark)
    made = "rid long, at long, live int, anchor long, whole long, off int"
    every = _table(texts.mapInArrow(partial(_pieces, rule=rule), made).withColumn("piece", F.monotonically_increasing_id()), "pieces", held)
    one = every.groupBy("anchor", "whole").agg(F.count("*").alias("rows"), F.min("piece").alias("first"))
    keys = one.groupBy("anchor").agg(F.sum("rows").alias("all"), F.count("*").alias("kinds"), F.min("rows").alias("fewest")).filter("all > 1").drop("all")
    open_ = (F.col("kinds") > 1) & (F.col("fewest") == 1)
    named = _table(one.join(keys, "anchor").filter((F.col("rows") > 1) | open_).select("anchor", "whole", "rows", F.when(open_, F.col("first")).alias("first"), (F.col("kinds") > HOT).alias("hot")), "named", held)
    met = every.join(named, ["anchor", "whole"]).withColumn("fetch", F.coalesce(F.col("piece") == F.col("first"), F.lit(False))).filter((F.col("rows") > 1) | F.col("fetch"))
    met = _table(met.select("rid", "at", "live", "anchor", "off", "rows", "hot", "fetch"), "met", held)
    for path in held[:2]:
        drop_path(spark, path)
    whole = met.filter("rows > 1").select("rid", F.col("at").alias("s"), (F.col("at") + F.col("live") + rule.length - 1).alias("e"))
    whole = checkpoint(_merged(whole))
    left = met.filter("fetch").select("rid", F.struct("rid", "at", "live", "anchor", "off", "rows", "hot").alias("w"))
    want = checkpoint(left.groupBy("rid").agg(F.collect_list("w").alias("want")))
    n = want.agg(F.sum(F.size("want"))).first()[0] or 0
    fetched = _table(texts.join(F.broadcast(want) if n <= BROADCAST else want, "rid").mapInArrow(partial(_fetch, rule=rule), PIECE).dropDuplicates(["rid", "at"]), "fetched", held)
    spans = _sorted_buckets(fetched.filter("not hot"), rule)
    hot = fetched.filter("hot")
    if not hot.isEmpty():
        spans = spans.unionByName(_open_cut(hot, rule))
    spans = spans.select("rid", F.struct("s", "e").alias("x")).groupBy("rid").agg(F.collect_list("x").alias("spans"))
    both = whole.unionByName(spans).groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = checkpoint(both.select("rid", _join_spans("spans")))
    for path in held[2:]:
        drop_path(spark, path)
    return out


def _join_spans(name: str):
    step = "case when size(a) > 0 and element_at(a, -1).e >= x.s then concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).s as s, greatest(element_at(a, -1).e, x.e) as e))) else concat(a, array(x)) end"
    return F.expr(f"aggregate(array_sort({name}), cast(array() as array<struct<s:bigint,e:bigint>>), (a, x) -> {step})").alias("spans")


def _merged(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans")).select("rid", _join_spans("spans"))


def _without(x: bytes, spans) -> tuple[bytes, int]:
    """What is left of ``x`` outside the sorted [s, e) ranges, which may overlap, and the number of maximal runs cut."""
    parts, at, runs = [], 0, 0
    for s, e in spans:
        if s > at or not runs:
            parts.append(x[at:s])
            runs += 1
        at = max(at, e)
    return b"".join([*parts, x[at:]]), runs


def _keep(batches, rules: tuple[Rule, ...]):
    for b in blocks(batches):
        v, o = bytes_of(b.column(b.schema.get_field_index("text")))
        w = Words(v, o, lower=False)
        found = {r.width: b.column(b.schema.get_field_index(f"spans{r.width}")).to_pylist() for r in rules}
        rows = []
        for r in range(b.num_rows):
            x = v[o[r] : o[r + 1]].tobytes()
            own = [(s["s"], s["e"]) for s in found.get(1, {r: None})[r] or ()]
            first = w.count_upto[r]
            said = [(int(w.start[first + s["s"]] - o[r]), int(w.end[first + s["e"] - 1] - o[r])) for s in found.get(8, {r: None})[r] or ()]
            both = sorted(own + said)
            kept, runs = _without(x, own if 1 in found else both)
            left = kept if 1 in found and not said else _without(x, both)[0]
            rows.append((len(x), len(x) - len(kept), runs, sha256(kept).hexdigest(), sum(s["e"] - s["s"] for s in found.get(8, {r: None})[r] or ()), left.decode("utf-8", "ignore")))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("row")), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.string())], names=["row", *MADE])


MADE = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_words", "kept_text")


def remove_repeats(docs: DataFrame, length: int | None = LENGTH, words: int | None = None) -> DataFrame:
    """All columns of ``docs`` but ``text``, with n_bytes, n_removed, n_spans and kept_sha256 (of the remaining bytes) by the rule
    of bytes, passage_words (words in repeated passages) by the rule of words, and kept_text: what is left by both, where a
    character that a span cuts goes as a whole. Without the rule of bytes the first four are of what is left by the
    rule of words. Columns that have one of these names already are replaced."""
    rules = tuple(Rule(n, w) for n, w in ((length, 1), (words, 8)) if n)
    rid = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), "text")
    others = [f for f in docs.schema.fields if f.name not in ("text", *MADE)]
    rows = docs.select(rid.alias("rid"), "text", F.struct(*[F.col(f"`{f.name}`") for f in others]).alias("row"))
    out = rows
    for rule in rules:
        spans = repeated_spans(rows.select("rid", "text"), rule).withColumnRenamed("spans", f"spans{rule.width}")
        n = spans.agg(F.sum(F.size(f"spans{rule.width}"))).first()[0] or 0
        out = out.join(F.broadcast(spans) if n <= BROADCAST else spans, "rid", "left")
    out = out.drop("rid").mapInArrow(partial(_keep, rules=rules), f"row {rows.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_words long, kept_text string")
    return out.select("row.*", *MADE)
