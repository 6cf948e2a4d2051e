"""The stages of the corpus pipeline.

Each takes (spark, docs, sf_dir), where ``docs`` is all that the stage before has kept, and returns a DataFrame; all but the
last return the columns of ``documents``. Ids may repeat or be null: no stage decides by id, rows are told apart by a key of
their own, made once, or by the digest of their text where the text alone decides. Keys of dropped documents are
broadcast up to ``FEW`` of them and joined by a shuffle beyond.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparsewing.llm import decontaminate, langid, mixing, suffixes
from sparsewing.llm.common import checkpoint, held_out, table, write_table
from sparsewing.llm.minhash import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
FEW = 2_000_000


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with a key, ``row``, in a table, so that the key stays the same whoever reads it."""
    return write_table(docs.select(COLUMNS).withColumn("row", F.monotonically_increasing_id()), "keyed")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (with ``row``) but for the rows of ``gone``."""
    gone = checkpoint(gone)
    return docs.join(F.broadcast(gone) if gone.count() <= FEW else gone, "row", "left_anti").select(COLUMNS)


def language_id(spark, docs, sf_dir):
    """Drops documents without a letter and those in which no language holds half of the words."""
    train = docs.filter(~F.coalesce(held_out(docs, 3, 1), F.lit(False)) & F.col("lang").isNotNull())
    model = langid.train(train.select("text", "lang"))
    return langid.identify(docs.select(COLUMNS), model).filter("lang_pred <> 'und' and score >= 0.5").select(COLUMNS)


def minhash_near_dedup(spark, docs, sf_dir):
    """Keeps one document of each component of near-duplicates (five words, similarity 0.8): the one with the smallest id, or
    one of those; null ids come last."""
    docs = _keyed(docs)
    found = near_duplicates(docs.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    of = checkpoint(found.join(docs.select("row", "doc_id"), "row"))
    first = of.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("x")).select("x.row")
    return _without(docs, of.join(first, "row", "left_anti").select("row"))


def suffix_array_dedup(spark, docs, sf_dir):
    """Cuts every passage of over 50 words, and every string of 400 bytes, that stands elsewhere too out of the texts; documents
    stay, with what is left of them."""
    out = suffixes.remove_repeats(docs.select(COLUMNS), length=suffixes.LENGTH, words=suffixes.PASSAGE)
    return out.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(COLUMNS)


def benchmark_decontamination(spark, docs, sf_dir):
    """Drops contaminated documents."""
    docs = docs.withColumn("row", F.unhex(F.md5("text")))
    found = decontaminate.judged(decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=("row",)))
    return _without(docs, found.filter("contaminated").select("row").distinct())


def source_mixing(spark, docs, sf_dir):
    """The documents that the mix takes, with the words taken of each."""
    docs = _keyed(docs)
    got = checkpoint(mixing.mix(docs, keep=("row",)).filter("taken > 0").drop("doc_id"))
    return docs.join(F.broadcast(got) if got.count() <= FEW else got, "row").drop("row")


STAGES = [(f.__name__, f) for f in (language_id, minhash_near_dedup, suffix_array_dedup, benchmark_decontamination, source_mixing)]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
