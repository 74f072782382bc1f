"""Registered queries of this package: ``name -> (spark, folder of Parquet tables) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import functions as F

from growthlens.llm import align, ann, bpe, centroids, chat, langid, mixing, pii, word_bpe
from growthlens.llm import quality as rules
from growthlens.llm import toxicity as kernel
from growthlens.llm.common import remainder, table
from growthlens.llm.exact_dedup import exact_dedup
from growthlens.llm.simhash import hex_fingerprint, simhash_classes


def op1_quality(spark, folder):
    docs = table(spark, folder, "documents")
    scored = rules.quality(docs, rules.fit(docs, table(spark, folder, "labels")))
    return scored.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op2_mixing(spark, folder):
    return mixing.mix(table(spark, folder, "documents"), mixing.TARGETS)


def op3_exact_dedup(spark, folder):
    return exact_dedup(table(spark, folder, "documents"))


def op4_chat(spark, folder):
    return chat.format_preferences(chat.swapped_replies(table(spark, folder, "conversations")))


def op5_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    scored = kernel.toxicity(docs, kernel.fit(docs, table(spark, folder, "labels")))
    return scored.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_neighbours(spark, folder):
    return ann.nearest(table(spark, folder, "embeddings"), every=100, count=10)


def op7_simhash(spark, folder):
    classes = simhash_classes(table(spark, folder, "documents"), words_per_shingle=3, distance=3)
    return classes.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def op8_language(spark, folder):
    docs = table(spark, folder, "documents")
    found = langid.predict(docs, langid.fit(docs), max_distance=1.0)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op9_bpe(spark, folder):
    return bpe.digests(table(spark, folder, "documents"))


def op10_pii(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii.KEY).select("doc_id", "n_entities", "kinds", "text", "n_kept")


def op11_alignment(spark, folder):
    return align.link_report(table(spark, folder, "documents"))


def op12_clusters(spark, folder):
    return centroids.cluster(table(spark, folder, "embeddings"), k=8, rounds=10, dimensions=64, scale=1024, salt="3")


def op13_word_bpe(spark, folder):
    return word_bpe.digests(table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_mixing, op3_exact_dedup, op4_chat, op5_toxicity, op6_neighbours, op7_simhash, op8_language, op9_bpe, op10_pii, op11_alignment, op12_clusters, op13_word_bpe)}
