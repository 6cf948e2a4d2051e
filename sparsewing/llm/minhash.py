"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

Method
  1. Every text becomes its set of distinct word shingles (64-bit hashes) and a signature of ``CHUNKS * WIDTH`` symbols of
     16 bits, each the low bits of a minimum over the set. Documents with equal sets fold into one class at once.
  2. Two signatures that differ in at most ``RADIUS`` = 15 symbols agree, by the pigeonhole principle, in one of the eight
     chunks but for ``RADIUS // CHUNKS`` = 1 symbol. Each class therefore enters the index under every chunk with every
     choice of one wrong symbol (8 * 4 keys), and *all* pairs within the radius meet under some key. At a Jaccard
     similarity of 0.8 a pair lies outside the radius with a chance of about 1 in 10,000; closer pairs far less often.
  3. Links are confirmed where classes meet, on the full shingle sets with integers: den * |A n B| >= num * |A u B|. No
     pair leaves its task: a task returns a spanning forest of the links that it has found, at most a row a class.
     First each class meets the leader that most of its keys have, together with the leader's other followers, which makes
     most components at a cost linear in the rows. Keys that then hold one component are done. The others are gathered
     into families, by the component that has most of a key's rows: there each class of another component (a probe)
     meets every class of the family's keys. So every pair that shares a key and is not yet linked is judged.
     Families and followings of any size are cut into blocks of about ``ROWS`` classes and ``ITEMS`` shingles.

Components are found by ``graph.components`` and carry the smallest document id.

Edge cases: null or wordless texts have empty sets and link with nothing; a text with fewer words than a shingle is one
shingle; repeated rows and ids are rows of one class when their sets are equal; a null id gets component null and stays
kept; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewing.llm.common import U64, blocks, bound_batches, checkpoint, mix64, partitions, words_of, write_table
from sparsewing.llm.graph import components

CHUNKS, WIDTH, RADIUS, ROWS, ITEMS = 8, 4, 15, 1024, 1 << 20
SYMBOLS = CHUNKS * WIDTH
#: Beyond so many ids the texts to verify are found by a shuffled join instead of a broadcast one (8 bytes an id).
BROADCAST_IDS = 2_000_000
_MUL = mix64(np.arange(1, SYMBOLS + 1, dtype=U64) * U64(0xA0761D6478BD642F)) | U64(1)
_MIX = mix64(np.arange(11, 75, dtype=U64)) | U64(1)


def shingles(batch, size: int):
    """For each document of a block: its sorted distinct shingle hashes. Yields (row, uint64 array), empty sets too."""
    w = words_of(batch)
    h, upto = w.hash, w.count_upto
    if len(h) >= size:
        s = np.zeros(len(h) - size + 1, dtype=U64)
        for k in range(size):
            s += h[k : k + len(s)] * _MIX[k]
        s = mix64(s)
    else:
        s = np.zeros(0, dtype=U64)
    for r in range(len(upto) - 1):
        a, b = upto[r], upto[r + 1]
        if b - a >= size:
            x = np.sort(s[a : b - size + 1])
            yield r, x if len(x) < 2 else x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif b > a:
            yield r, mix64(np.array([int((h[a:b] * _MIX[32 : 32 + b - a]).sum()) + int(b - a) & (2**64 - 1)], dtype=U64))
        else:
            yield r, np.zeros(0, dtype=U64)


def set_keys(h: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One hash for each set of hashes; sets are glued in ``h`` and begin at ``at``."""
    return mix64(np.add.reduceat(mix64(h ^ U64(0x5DEECE66D)), at) + n.astype(U64))


def _sketch(batches, size: int):
    for b in blocks(batches):
        sets = [x for _, x in shingles(b, size)]
        n = np.array([len(x) for x in sets])
        full = np.flatnonzero(n)
        sig = np.zeros((len(sets), SYMBOLS), dtype=np.uint16)
        key = np.zeros(len(sets), dtype=U64)
        if len(full):
            h = np.concatenate([sets[r] for r in full])
            at = np.concatenate(([0], np.cumsum(n[full])[:-1]))
            for k in range(SYMBOLS):
                sig[full, k] = (np.minimum.reduceat(h * _MUL[k], at) >> U64(20)).astype(np.uint16)
            key[full] = set_keys(h, at, n[full])
        raw = sig.tobytes()
        step = SYMBOLS * 2
        yield pa.RecordBatch.from_arrays(
            [b.column(b.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(key.view(np.int64)), pa.array([raw[i * step : (i + 1) * step] for i in range(len(sets))], pa.binary())],
            names=["doc_id", "n_shingles", "node", "sig"],
        )


def sketch(docs: DataFrame, size: int) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(partial(_sketch, size=size), "doc_id long, n_shingles long, node long, sig binary")


def _sigs(col) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype=np.uint16).reshape(-1, SYMBOLS)


def _keys(frames):
    for f in frames:
        if not len(f):
            continue
        s = _sigs(f.sig).reshape(-1, CHUNKS, WIDTH).astype(U64)
        for c in range(CHUNKS):
            for wrong in range(WIDTH):
                k = np.full(len(s), c * WIDTH + wrong + 1, dtype=U64)
                for i in range(WIDTH):
                    if i != wrong:
                        k = k * U64(1 << 16) + s[:, c, i] + U64(1)
                yield pd.DataFrame({"key": mix64(k ^ (U64(c * WIDTH + wrong + 1) << U64(56))).view(np.int64), "node": f.node.to_numpy()})


def _sets(batches, size: int):
    """The full set of each text."""
    for b in blocks(batches):
        sets = [x for _, x in shingles(b, size)]
        # an id may stand on rows of different texts; only the named class's text counts
        node = b.column(b.schema.get_field_index("node")).to_numpy()
        full = [i for i, x in enumerate(sets) if len(x)]
        if not full:
            continue
        n = np.array([len(sets[i]) for i in full])
        h, at = np.concatenate([sets[i] for i in full]), np.concatenate(([0], np.cumsum(n)[:-1]))
        right = set_keys(h, at, n).view(np.int64) == node[full]
        yield pa.RecordBatch.from_arrays([pa.array(node[full][right], pa.int64()), pa.array(n[right], pa.int64()), pa.array([sets[i].tobytes() for i, r in zip(full, right, strict=True) if r], pa.binary())], names=["node", "n", "items"])


def full_sets(docs: DataFrame, named: DataFrame, size: int) -> DataFrame:
    """(node, n, items) of the classes in ``named`` (node, doc_id); only their texts leave the scan."""
    many = named.count()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(named) if many <= BROADCAST_IDS else named, "doc_id")
    sets = write_table(texts.select("node", "text").mapInArrow(partial(_sets, size=size), "node long, n long, items binary"), "sets")
    # an id that stands on several rows of one text made its class several times
    return sets if sets.count() == many else write_table(sets.dropDuplicates(["node"]), "sets")


# ---------------------------------------------------------------- confirming links where classes meet
class Sets:
    """Full sets of the rows of a group, glued and numbered, so that one row is compared with all others at once."""

    def __init__(self, items: list[bytes], num: int, den: int):
        self.n = np.array([len(x) // 8 for x in items])
        self.at = np.cumsum(self.n) - self.n
        kinds, self.codes = np.unique(np.frombuffer(b"".join(items), dtype=U64), return_inverse=True)
        self.mark = np.zeros(len(kinds), dtype=np.int8)
        self.num, self.den = num, den

    def linked(self, i: int) -> np.ndarray:
        """Which rows are similar enough to row ``i``."""
        own = self.codes[self.at[i] : self.at[i] + self.n[i]]
        self.mark[own] = 1
        both = np.add.reduceat(self.mark[self.codes], self.at, dtype=np.int64)
        self.mark[own] = 0
        return both * self.den >= self.num * (self.n + self.n[i] - both)


def _grow(sets: Sets) -> list[tuple[int, int]]:
    """A spanning forest of all links of a group: a row is compared with what no row before it has reached."""
    left, out = np.ones(len(sets.n), dtype=bool), []
    for first in range(len(left)):
        if not left[first]:
            continue
        left[first], todo = False, [first]
        while todo and left.any():
            i = todo.pop()
            got = np.flatnonzero(sets.linked(i) & left)
            left[got] = False
            todo.extend(got.tolist())
            out.extend((i, j) for j in got.tolist())
    return out


def _probe(sets: Sets, lab: np.ndarray, probes: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between probes and rows of other components."""
    lab, out = np.unique(lab, return_inverse=True)[1], []
    for i in probes.tolist():
        if (lab == lab[i]).all():
            continue
        got = np.flatnonzero(sets.linked(i) & (lab != lab[i]))
        for j in got[np.unique(lab[got], return_index=True)[1]].tolist():
            out.append((i, j))
            lab[lab == lab[j]] = lab[i]
    return out


def _links(f: pd.DataFrame, probing: bool, num: int, den: int) -> pd.DataFrame:
    """(u, v) of many groups dealt to one call."""
    f = f.sort_values(["fam", "lo", "hi", "node"], ignore_index=True)
    k, node, items, probe = f[["fam", "lo", "hi"]].to_numpy(), f.node.to_numpy(), f["items"].to_numpy(), f.probe.to_numpy()
    at = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1)))) if len(f) else []
    lab = f.lab.to_numpy()
    out = []
    for s, e in zip(at, [*at[1:], len(f)], strict=True):
        if e - s < 2:
            continue
        sets = Sets(items[s:e].tolist(), num, den)
        got = _probe(sets, lab[s:e], np.flatnonzero(probe[s:e])) if probing else _grow(sets)
        out.extend((node[s + i], node[s + j]) for i, j in got)
    return pd.DataFrame(out, columns=["u", "v"]).astype("int64")


def _judged(rows: DataFrame, sets: DataFrame, probing: bool, num: int, den: int) -> DataFrame:
    """Links among ``rows`` (fam, lo, hi, node, lab, probe), each group with its classes' full sets."""
    rows = rows.join(sets, "node")
    size = rows.agg(F.sum("n")).first()[0] or 0
    buckets = max(partitions(rows.sparkSession), size // ITEMS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("fam", "lo", "hi"), F.lit(buckets))).drop("n")
    return checkpoint(rows.groupBy("bucket").applyInPandas(partial(_links, probing=probing, num=num, den=den), "u long, v long"))


def _blocks(rows: str, items: str) -> F.Column:
    return F.ceil(F.greatest(F.col(rows) / ROWS, F.col(items) / ITEMS)).cast("int")


def _with_large(rows: DataFrame, large: DataFrame) -> DataFrame:
    """``rows`` with the blocks of the families that are cut; there is at most one in ``ROWS`` rows, and beyond a stated number of
    them they are joined by a shuffle."""
    return rows.join(F.broadcast(large) if large.count() <= BROADCAST_IDS // 4 else large, "fam", "left")


def followings(shared: DataFrame, sizes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links of each class with the leader that most of its keys have and the leader's other followers, in blocks."""
    mine = shared.groupBy("node", "lead").agg(F.count("*").alias("hits")).groupBy("node").agg(F.max(F.struct("hits", "lead")).alias("x"))
    mine = checkpoint(mine.select("node", F.col("x.lead").alias("fam")).join(sizes, "node"))
    per = mine.filter("node <> fam").groupBy("fam").agg(F.count("*").alias("rows"), F.sum("n").alias("all"))
    per = checkpoint(per.select("fam", _blocks("rows", "all").alias("nb")))
    rest = _with_large(mine.filter("node <> fam"), per.filter("nb > 1")).select("fam", F.pmod(F.xxhash64("node"), F.coalesce("nb", F.lit(1))).cast("int").alias("lo"), "node")
    lead = per.select("fam", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("lo"), F.col("fam").alias("node"))
    rows = rest.unionByName(lead).select("fam", "lo", F.lit(0).alias("hi"), "node", F.lit(0).cast("long").alias("lab"), F.lit(False).alias("probe"))
    return _judged(rows, sets, False, num, den)


def families(shared: DataFrame, lab: DataFrame, sizes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links between different components whose classes share a key."""
    k = shared.join(lab, "node", "left").select("key", "node", F.coalesce("lab", "node").alias("lab"))
    per = k.groupBy("key", "lab").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("labs"), F.max(F.struct("c", "lab")).alias("x"))
    mixed = per.filter("labs > 1").select("key", F.col("x.lab").alias("fam"))
    rows = k.join(mixed, "key").groupBy("fam", "node", "lab").agg(F.lit(1).alias("one")).join(sizes, "node")
    rows = checkpoint(rows.select("fam", "node", "lab", "n", (F.col("lab") != F.col("fam")).alias("probe")))
    per = rows.groupBy("fam").agg(F.count("*").alias("rows"), F.sum("n").alias("all"), F.count_if("probe").alias("probes"), F.sum(F.when(F.col("probe"), F.col("n"))).alias("probed"))
    per = checkpoint(per.select("fam", _blocks("rows", "all").alias("nb"), _blocks("probes", "probed").alias("np")).filter("nb > 1 or np > 1"))
    rows = _with_large(rows, per).withColumns({"nb": F.coalesce("nb", F.lit(1)), "np": F.coalesce("np", F.lit(1))}).withColumns({"blk": F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"), "pb": F.pmod(F.xxhash64("node", F.lit(1)), F.col("np")).cast("int")})
    # a class is met by the probes of every block, a probe meets the classes of every block; one entry where both are one
    met = F.transform(F.sequence(F.lit(0), F.col("np") - 1), lambda p: F.struct(F.col("blk").alias("lo"), p.alias("hi"), (F.col("probe") & (p == F.col("pb"))).alias("probe")))
    meets = F.when(F.col("probe"), F.filter(F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda b: F.struct(b.alias("lo"), F.col("pb").alias("hi"), F.lit(True).alias("probe"))), lambda x: x["lo"] != F.col("blk"))).otherwise(F.array())
    rows = rows.select("fam", "node", "lab", F.explode(F.concat(met, meets)).alias("x")).select("fam", "x.lo", "x.hi", "node", "lab", "x.probe")
    return _judged(rows, sets, True, num, den)


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` (doc_id, text, ...) to (doc_id, n_shingles, component_id, kept), one row per document."""
    bound_batches(docs.sparkSession)
    rows = write_table(sketch(docs, size), "sketch")
    classes = rows.filter("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("sig").alias("sig"))
    classes = checkpoint(classes)
    keys = classes.select("node", "sig").mapInPandas(_keys, "key long, node long")
    many = keys.groupBy("key").agg(F.count("*").alias("rows"), F.min("node").alias("lead")).filter("rows > 1").select("key", "lead")
    shared = checkpoint(keys.join(many, "key").select("key", "node", "lead"))
    named = shared.groupBy("node").agg(F.lit(1).alias("one")).join(classes.select("node", F.col("rep").alias("doc_id")), "node").select("node", "doc_id")
    sets = full_sets(docs, named, size)
    sizes = sets.select("node", "n")
    links = followings(shared, sizes, sets, num, den)
    lab = components(links, hashed=True).select("node", F.col("component").alias("lab"))
    more = families(shared, lab, sizes, sets, num, den)
    # the components that the later links join, by the names they have so far
    ends = more.join(lab.select(F.col("node").alias("u"), F.col("lab").alias("x")), "u", "left").join(lab.select(F.col("node").alias("v"), F.col("lab").alias("y")), "v", "left")
    ends = checkpoint(ends.select(F.coalesce("x", "u").alias("u"), F.coalesce("y", "v").alias("v")))
    again = components(ends, hashed=True).select(F.col("node").alias("was"), F.col("component").alias("now"))
    of = classes.select("node", "rep").join(lab, "node", "left").select("node", "rep", F.coalesce("lab", "node").alias("lab"))
    of = of.join(again, F.col("lab") == F.col("was"), "left").select("node", "rep", F.coalesce("now", "lab").alias("lab"))
    least = of.groupBy("lab").agg(F.min("rep").alias("component_id"))
    of = of.join(least, "lab").select("node", "component_id")
    out = rows.withColumn("node", F.when(F.col("n_shingles") > 0, F.col("node"))).select("doc_id", "n_shingles", "node").join(of, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
