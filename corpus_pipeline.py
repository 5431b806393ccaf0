"""A training corpus from raw documents: rules, classifier, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir); all but the last return rows of docs with the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import packing, pii, quality_cnn, quality_rules, simhash
from clickloom.llm.shared import table
from clickloom.sources.shared import fresh_folder, remove


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels").where("quality = 1"))


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold go; the classifier learns from what the stage is given."""
    return quality_cnn.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the least id stays, by the wide rule: five-word shingles, of
    which about 0.8 or more are alike. op10's own rule, three words and three bits, finds few near copies."""
    return simhash.keep_one(docs, wide=True)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind; n_chars is counted anew where there is such a column."""
    clean = pii.redact(docs, around=True)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    packed = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules_stage),
    ("quality classifier", quality_classifier_stage),
    ("near-dedup", near_dedup_stage),
    ("personal data", pii_stage),
    ("packing", packing_stage),
]
#: A classifier, fingerprints and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each one keeps is written to the shared folder and read by the next.

    A stage's rows are removed once the next one's are written; those of the last but one stay, as the result reads
    them, until the session's folder is removed.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = fresh_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if before:
            remove(spark, before)
        before = f"{folder}/{k}"
    return STAGES[-1][1](spark, docs, sf_dir)
