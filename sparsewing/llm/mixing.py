"""Mixing sources to target weights by a low-discrepancy schedule.

Targets. Sources in code-point order (null last) weigh 3, 1, 2, repeating, and share ``share`` times all words by weight;
a source above ``cap`` times its own size stops there and its excess is shared again among the rest until none is above.

Schedule. Sources whose targets lie within a factor of ``CLASS`` form a class with a schedule of its own, so that a block is
small beside every target of its class, however large the other sources are. In a class, slot ``i`` takes the point
frac((i + 1/2) * golden ratio) through the cumulative targets to a source, so every stretch of slots holds each source in
proportion up to a logarithmic error. Slots are ranked within their source. Each source's documents stand in a hash-shuffled
ring of words, cut into equal blocks of words; the slot of rank ``r`` takes block ``r`` of the ring, lap after lap. The
points alone decide how many blocks a source gives, and when: its taken words are its slots times the block, which
differs from its target by a few blocks, and never more than ``cap`` laps. A class has ``SLOTS`` slots, or ``FINE`` for each of
its sources times ``CLASS`` where that is more: a number that depends on the sources, not on their size. A block is one word
at least. ``first_at`` (0 to 1) is the place in the mix of the slot that takes the first words of a document: classes
run side by side, so it puts the mix in order.

A source may hold any part of the rows: running sums go over hash buckets of about ``BUCKET`` rows, then over a source's
bucket totals, never over all its rows in one task. One row per source is sorted in one task to number the sources.

Edge cases: null and wordless texts have size 0 and are taken 0 times; repeated rows are separate documents, ordered by
id, size and the digest of the text; null ids are mixed too; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparsewing.llm.common import checkpoint

WEIGHTS, SLOTS, BUCKET = (3, 1, 2), 1 << 18, 1000
CLASS, FINE = 64, 64
GOLDEN = (math.sqrt(5) - 1) / 2
WORD = r"[^\x20\x09-\x0D]+"


def targets(per: DataFrame, share: float, cap: float) -> DataFrame:
    """(sid, source, source_size, target) from (source, source_size)."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("sid", F.row_number().over(w).cast("long") - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    per = checkpoint(per.withColumn("w", weight).withColumn("top", F.col("source_size") * F.lit(float(cap))))
    total = float(per.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0  # words per unit of weight; rises until no source passes its cap
    while True:
        x = per.agg(F.sum(F.when(F.col("w") * level >= F.col("top"), F.col("top"))), F.sum(F.when(F.col("w") * level < F.col("top"), F.col("w")))).first()
        if not x[1]:
            break
        new = (total - (x[0] or 0.0)) / x[1]
        if new <= level:
            break
        level = new
    return per.withColumn("target", F.least("top", F.col("w") * level)).select("sid", "source", "source_size", "target")


def points(slots: DataFrame) -> DataFrame:
    """``slots`` (id) with ``x``, a point between 0 and 1 for each."""
    x = (F.col("id") + 0.5) * GOLDEN
    return slots.withColumn("x", x - F.floor(x))


def classes(per: DataFrame, slots: int) -> DataFrame:
    """``per`` with the class of each source, the words of a block and the number of slots of its class. A row per source."""
    per = per.filter("target > 0").withColumn("class", F.floor(F.log(F.greatest("target", F.lit(1.0))) / math.log(CLASS)).cast("int"))
    own = per.groupBy("class").agg(F.sum("target").alias("all"), F.count("*").alias("k"))
    block = F.greatest(F.lit(1), F.ceil(F.floor("all") / F.greatest(F.lit(slots), F.col("k") * CLASS * FINE))).cast("long")
    own = own.withColumn("block", block).withColumn("slots", F.greatest(F.lit(1), F.round(F.floor("all") / block)).cast("long"))
    return per.join(F.broadcast(own.drop("k", "all")), "class")  # a class for each power of CLASS


def schedule(spark, per: DataFrame) -> DataFrame:
    """(sid, rank, at): the slots of each source in order, and their place in the mix. ``per``: sid, target, class, slots."""
    w = Window.partitionBy("class").orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    cum = per.withColumn("hi", F.sum("target").over(w)).withColumn("lo", F.col("hi") - F.col("target"))
    cum = checkpoint(cum.withColumn("end", F.max("hi").over(Window.partitionBy("class"))).select("class", "slots", "sid", "lo", "hi", "end"))
    # points fall into 1024 equal cells, which a source's interval overlaps, so the interval is found by an equi-join
    cells = 1024
    grid = cum.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / F.col("end") * cells), F.least(F.lit(cells - 1), F.floor(F.col("hi") / F.col("end") * cells))))).drop("slots")
    hits = None
    for r in cum.groupBy("class", "slots").count().orderBy("class").collect():  # a row per class
        pts = points(spark.range(r.slots)).withColumn("cell", F.floor(F.col("x") * cells))
        hit = pts.join(grid.filter(F.col("class") == r["class"]), "cell").filter("x * end >= lo and x * end < hi").select("sid", F.col("id").alias("slot"), ((F.col("id") + 0.5) / r.slots).alias("at"))
        hits = hit if hits is None else hits.unionByName(hit)
    if hits is None:
        return spark.createDataFrame([], "sid long, rank long, at double")
    hit = checkpoint(hits.withColumn("part", F.floor(F.col("slot") / 2048)))
    # ranks: within stretches of slots, then over the stretches of a source
    sums = hit.groupBy("sid", "part").agg(F.count("*").alias("k")).withColumn("before", F.sum("k").over(Window.partitionBy("sid").orderBy("part")) - F.col("k"))
    rank = F.row_number().over(Window.partitionBy("sid", "part").orderBy("slot")) - 1 + F.col("before")
    return hit.join(sums.select("sid", "part", "before"), ["sid", "part"]).select("sid", rank.cast("long").alias("rank"), "at")


def mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, seed: int = 17, slots: int = SLOTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) to (doc_id, ``keep``, size, source_size, target, taken, first_at), one
    row per document. ``keep``: columns to carry along."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64("text").alias("digest"), *keep))
    per = checkpoint(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")).select("source", "source_size"), share, cap))
    ruled = checkpoint(classes(per, slots))
    n = rows.count()
    buckets = max(1, math.ceil(n / BUCKET))
    few = per.count() <= 10_000
    keyed = rows.join(F.broadcast(per) if few else per, rows["source"].eqNullSafe(per["source"])).drop(per["source"])
    h = F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "size", F.lit(seed))
    keyed = keyed.withColumn("h", h).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)))
    sums = keyed.groupBy("sid", "bucket").agg(F.sum("size").alias("words")).withColumn("before", F.sum("words").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("words"))
    w = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "size", "digest").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.join(sums.select("sid", "bucket", "before"), ["sid", "bucket"]).withColumn("at", F.sum("size").over(w) - F.col("size") + F.col("before"))
    placed = checkpoint(placed.select("doc_id", *keep, "sid", "size", "source_size", "target", "at").withColumn("uid", F.monotonically_increasing_id()))
    # pieces: a document's stretch of each block that it meets, lap after lap while the source's slots reach it
    slot = checkpoint(schedule(spark, ruled))
    have = slot.groupBy("sid").agg(F.count("*").alias("have")).join(ruled.select("sid", "block"), "sid")
    block = F.col("block")
    most = F.least(F.col("have") * block, F.floor(F.col("source_size") * F.lit(float(cap)))).cast("long")
    laps = placed.filter("size > 0").join(F.broadcast(have) if few else have, "sid").withColumn("most", most).filter("most > at")
    laps = laps.withColumn("lap", F.explode(F.sequence(F.lit(0), F.floor((F.col("most") - 1 - F.col("at")) / F.col("source_size")).cast("int"))))
    laps = laps.withColumn("s", F.col("at") + F.col("lap") * F.col("source_size")).withColumn("e", F.least(F.col("s") + F.col("size"), "most"))
    piece = laps.withColumn("rank", F.explode(F.sequence(F.floor(F.col("s") / block), F.floor((F.col("e") - 1) / block))))
    words = F.least(block, F.col("e") - F.col("rank") * block) - F.greatest(F.lit(0), F.col("s") - F.col("rank") * block)
    got = piece.select("uid", "sid", "rank", words.alias("n")).join(slot, ["sid", "rank"]).groupBy("uid").agg(F.sum("n").alias("taken"), F.min("at").alias("first_at"))
    out = placed.join(got, "uid", "left")
    return out.select("doc_id", *keep, "size", "source_size", F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_at")
