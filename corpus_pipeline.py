"""The corpus pipeline: quality, near-duplicates, benchmark decontamination, secrets, tokens.

Each stage takes the documents its predecessor kept and reads further tables from ``sf_dir``. All but the last return
the columns of ``documents``; the last one returns the token ids.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bpe, decontaminate, neardup, quality, secrets
from riskloom.llm.queries import id_fold, table
from riskloom.llm.staging import bounded_batches, set_aside, stage

QUALITY_THRESHOLD = 0.3


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled ones outside the held-out fold."""
    model = quality.train_quality(docs, table(spark, sf_dir, "labels"), id_fold(5) != 0)
    rows, own = set_aside(docs, ["_score", "_accepted"])
    return quality.score_quality(rows, model, QUALITY_THRESHOLD, "_score", "_accepted").where("_accepted = 1").select(own)


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more."""
    bounded_batches(spark)
    return neardup.drop_near_duplicates(docs, neardup.ForestParams(shingle=5, percent=80))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; n_chars follows a text that changed."""
    bounded_batches(spark)
    masked = secrets.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    changed = F.col("text").contains(secrets.MASK)
    return masked.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and digests of the ids and of the bytes that they decode to."""
    bounded_batches(spark)
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(docs.select("doc_id", "text"), ranks, pattern).drop("text")
    return bpe.decode(encoded, ranks, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_one_of_near),
    ("benchmark decontamination", keep_uncontaminated),
    ("secret scans", mask_secrets),
    ("byte-level BPE", to_tokens),
]

#: Trained scores, component search and byte-pair merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
