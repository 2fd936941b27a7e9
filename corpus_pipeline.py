"""The corpus pipeline: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of
``documents``.  ``run`` writes what each stage returns to the shared folder and
reads it as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from lodestone.llm.common import saved, table
from lodestone.llm.queries import VOCABULARY, mix_levels, unseen

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    labels = spark.read.parquet(table(sf_dir, "labels"))
    docs = docs.select(*COLUMNS)
    scored = toxicity.score(docs, toxicity.learn(docs, labels, ~unseen(F.col("doc_id"))), name="toxicity_score")
    return scored.where(F.col("toxicity_score") < 0.7).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go; so do documents of which no word is
    left by that.  n_chars follows the text."""
    words = lambda c: F.trim(F.translate(F.coalesce(F.col(c), F.lit("")), "\t\n\x0b\x0c\r", "     ")) != ""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), counted=True)
    return out.where((F.col("n_removed") == 0) | words("text")).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, 0.8) the smallest id stays.
    Rows without an id stay."""
    groups = ngram_join.jaccard_components(docs, size=5, percent=80)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(saved(gone), "doc_id", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the production mix takes, as often as it takes them."""
    return mixing.choose(docs, mix_levels(), mixing.n_words(F.col("text")), copies=True).select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, ids and the digest of the decoded text of what is left."""
    return bpe.encode_decode(docs, public_tokenizers.path(VOCABULARY), keep=True).drop("decoded")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

# A trained model, a similarity join and a tokenizer: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(table(sf_dir, "documents"))
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = saved(docs)
    return docs
