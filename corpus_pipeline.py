"""A corpus in five stages: language ID, near-duplicate removal, masking of personal data, mixing of sources, encoding.

Each stage takes (spark, docs, sf_dir) and returns what is kept, in the columns of documents; the last returns ids' digests instead. Texts that a
stage changes get their own n_chars. Null texts are "und" to the first stage and go. Each row is a document: also where ids are repeated or null, no
stage adds or loses rows for that. Empty tables give empty results, and other columns than those of documents are left out. run() writes each
stage's rows to the folder that machines share and reads them for the next; it keeps no more than two stages' rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import jaccard_join, language_id, mixing, personal_data, pieces
from textloom.llm.common import shared_folder, with_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; lang becomes the language found. Learns from the labelled documents given."""
    dictionaries = language_id.learn(docs)
    told = language_id.identify(docs, dictionaries).where(~F.col("rejected"))
    return told.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates; documents without words stay."""
    return jaccard_join.representatives(docs).select(*COLUMNS)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind."""
    keyed, key = with_key(docs, "doc_id")
    found = personal_data.personal_spans(keyed, key).where(F.size("spans") > 0).select(F.col("doc_id").alias(key), F.col("spans").alias("__spans"))
    none = F.array().cast(found.schema["__spans"].dataType)
    text = personal_data.masked(F.col("text"), F.coalesce("__spans", none))
    masked = keyed.join(found, key, "left").withColumn("text", F.when(F.col("__spans").isNull(), F.col("text")).otherwise(text))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many rows of each document as the mix has copies of it."""
    keyed, key = with_key(docs, "doc_id")
    copies = mixing.mix_sources(keyed, id_col=key).where("copies > 0").select(F.col("doc_id").alias(key), F.col("copies").alias("__copies"))
    many = keyed.join(copies, key).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return many.select(*COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, number of ids, and the digests of ids and of the decoded text."""
    return pieces.digests(docs.select("doc_id", "lang", "source", "text"), pieces.default_model()).drop("text")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: Compression, iterations and the encoding are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k % 2}")
        docs = spark.read.parquet(f"{folder}/{k % 2}")
    return docs
