"""From raw documents to token ids: five stages, each an operator of tessera.llm.

All stages take rows with a null doc_id and repeated rows as they come, and any
text, whole. An empty table goes through all of them and gives no rows; empty
tables of labels or of the benchmark reject nothing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import _spark, bpe, decontaminate, near_dedup, pii, toxicity

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labelled ones scores below one half; null and empty texts have the score of a text without any hit.

    Equal rows have equal scores. Without labels of both kinds no document is rejected.
    """
    return toxicity.drop_toxic(docs, toxicity.train(docs, _spark.table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of those that share four fifths of their five-word shingles.

    Null and empty texts and rows with a null doc_id are in no class and stay; rows of one doc_id stay or go together.
    """
    return near_dedup.deduplicate(docs, shingle=5, similar=(80, 100))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words stand in windows of the benchmark; null and empty texts stay, each row is judged by itself."""
    return decontaminate.drop_contaminated(docs, _spark.table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the kind of each personal detail in its place; n_chars is that of the new text and null for a null one."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (32-bit little-endian) and a digest of the text they decode to, for every row; null and empty texts have no ids."""
    coded = bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("bpe", encode),
]

ORACLE_SQL = None  # neither the model nor the merges are SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spark.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = _spark.checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
