"""From raw documents to packed token sequences.

Language ID, quality rules, near-duplicate removal, masking of personal data,
best-fit packing. Every stage takes the documents its predecessor kept and
returns documents with the same columns; the last returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.llm import langid, ngram_join, packing, pii, rules
from shopfloor.sources.staging import stage

LEAST_LANGUAGE_SCORE = 0.3
UNITS_KEPT = 200_000
"""Words whose ids a worker remembers while it packs: a third of the operator's, beside heaps that other stages have filled."""


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts that look like no language of the corpus."""
    found = langid.identify(docs, out=("_lang_pred", "_lang_score"))
    kept = (F.col("_lang_pred") != langid.UNKNOWN) & (F.col("_lang_score") >= LEAST_LANGUAGE_SCORE)
    return found.where(kept).select(*docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the cascade of quality rules rejects."""
    return rules.apply_rules(docs, out="_rejected_by").where("_rejected_by is null").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies; rows without an id are kept."""
    groups = ngram_join.jaccard_components(docs)
    kept = stage(groups.select(F.col("component_id").alias("doc_id")).where("doc_id is not null").distinct(), "kept")
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind, and counts the characters anew."""
    clean = pii.masked(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces packed into sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, units_kept=UNITS_KEPT)


STAGES = [
    ("language_id", known_language),
    ("quality_rules", good_quality),
    ("ngram_dedup", one_of_each_group),
    ("personal_data", masked),
    ("packing", packed),
]

# A learned classifier and a tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of documents, each written down before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
