"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import shared_folder
from . import chat, embeddings, importance, jaccard, mixing, pack, periods, pii, secrets, substring, tokenize, toxicity
from .common import read_table
from .oracles import ORACLES as ORACLES


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.digest_formatted(chat.format_conversations(rows.unionByName(probe)))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.digest_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    ledger = secrets.scan_increment(docs, f"{shared_folder(spark)}/secret-ledger-{uuid.uuid4().hex}")
    return secrets.secret_digests(secrets.findings_by_path(docs, ledger))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.crc32_of(pack.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = toxicity.score_documents(docs, toxicity.learn(docs, labels))
    return scored.select("doc_id", toxicity.held_out_column(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.size("sentences").alias("n_sentences"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = substring.dedup_substrings(read_table(spark, sf_dir, "documents").select("doc_id", "text"), substring.CLAUSES)
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return cleaned.select("doc_id", "text", F.size("removed_spans").alias("n_removed"), removed.alias("removed_chars"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(pii.find_pii(read_table(spark, sf_dir, "documents")))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return embeddings.top_k(vectors, vectors.where(F.col("vec_id") % embeddings.QUERY_EVERY == 0))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the texts, by a checksum of the id, has a period planted from one of its words on: that word and those after it, over and over."""
    x = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    x = x.withColumn("words", F.when(F.col("h") % 10 == 0, F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")))
    x = x.withColumn("g", F.expr("h div 10")).withColumn("n", F.size("words")).withColumn("a", F.expr("if(n > 0, cast(g % n as int), 0)"))
    x = x.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    planted = F.expr("concat(slice(words, 1, a), slice(flatten(array_repeat(slice(words, a + 1, p), cast((n - a) div p + 1 as int))), 1, n - a))")
    texts = x.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))
    return periods.run_digests(periods.periodic_runs(texts))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "epochs")


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_format,
        op2_sentencepiece,
        op3_secret_scan,
        op4_packing,
        op5_toxicity,
        op6_substring_dedup,
        op7_ngram_jaccard,
        op8_pii,
        op9_embedding_dedup,
        op10_top_k,
        op11_periodic_runs,
        op12_importance_resampling,
        op13_source_mixing,
    )
}
