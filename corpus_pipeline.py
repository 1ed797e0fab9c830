"""A training corpus from `documents`: toxic documents go, one document of each near-duplicate group stays, repeated
passages are cut, personal data is generalised, and what remains is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.

Rows, in every stage: null and empty texts stay (they score 0, link with nothing, hold no run and no entity, and pack as
their end id); a null doc_id stays; extra columns are kept up to packing, whatever their names; an empty table gives an
empty one; texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import jaccard, pack, pii, substring, toxicity
from folioforge.llm.common import read_table, release_shuffles
from folioforge.sources.staging import drop_staged, staged


def _with_length(docs: DataFrame) -> DataFrame:
    """n_chars follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents whose score reaches the threshold; labels are learnt from outside the held-out quarter. Repeated
    rows go or stay alike."""
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    flagged = toxicity.flag_documents(docs, model)
    flag = flagged.columns[-1]
    return flagged.where(~F.col(flag)).drop(flag)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each component, each of its texts once; rows without a doc_id belong to none and stay."""
    found = jaccard.jaccard_components(docs)
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    one = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return one.unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes every run of sentences that stands before, by doc_id and place; no row goes, so a document may end up empty."""
    cleaned = substring.dedup_substrings(docs, substring.CLAUSES)
    return _with_length(cleaned.drop(cleaned.columns[-1]))


def generalise_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in place of each entity and of each term that gives one away; repeated rows change alike."""
    return _with_length(pii.sanitise(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences, with their ids; repeated rows are packed each."""
    pieces = pack.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("pii", generalise_pii),
    ("packing", pack_sequences),
]

#: SQL cannot express the stages (a trained model, a tokenizer); tests/llm holds their operators against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:  # the next stage's table is whole, so nothing reads this one again
            drop_staged(spark, before)
        before = path
        release_shuffles(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
