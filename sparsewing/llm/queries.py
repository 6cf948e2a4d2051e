"""The registered queries ``opN_<name>`` over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparsewing.llm import centroids, chat, decontaminate, langid, lm, mixing, pivots, suffixes, tokencount, urlfilter, warc
from sparsewing.llm.common import checkpoint, drop_path, held_out, shared_path, table
from sparsewing.llm.minhash import near_duplicates


def op1_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, num=80, den=100)


def op2_lm_scoring(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm.score_texts(docs.withColumn("train", ~F.coalesce(held_out(docs, 7, 2), F.lit(False))))


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(held_out(docs, 3, 1), F.lit(False)))
    model = langid.train(docs.filter("not held_out and lang is not null").select("text", "lang"))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "lang_set")


def op4_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.read_back(chat.format_chats(rows.unionByName(more))))


def op5_suffix_array_dedup(spark, sf_dir):
    """By the rule of 400 bytes, and beside it the words in passages of over 50 words that stand elsewhere too; ``text`` is what
    both leave."""
    out = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400, words=suffixes.PASSAGE)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_words", F.col("kept_text").alias("text"))


def op6_url_filters(spark, sf_dir):
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op7_embedding_near_dedup(spark, sf_dir):
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op8_benchmark_decontamination(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_warc_index_merge(spark, sf_dir):
    folder = shared_path(spark, "warc")
    files = warc.write_warc(table(spark, sf_dir, "pages"), folder)
    index = checkpoint(warc.capture_index(warc.read_warc(files, folder)))
    drop_path(spark, folder)
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts")


def op11_centroid_clustering(spark, sf_dir):
    return centroids.described(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark, sf_dir):
    import public_tokenizers

    return tokencount.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_lm_scoring, op3_language_id, op4_chat_formatting, op5_suffix_array_dedup, op6_url_filters, op7_embedding_near_dedup, op8_benchmark_decontamination, op9_source_mixing, op10_warc_index_merge, op11_centroid_clustering, op12_token_counts)}


def queries():
    import corpus_pipeline

    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql():
    from sparsewing.llm.oracles import ORACLE

    return dict(ORACLE)
