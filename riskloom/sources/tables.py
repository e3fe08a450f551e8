"""Tables at rest: transactions, snapshots, feedback labels, instruction files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.scoring import model_input
from riskloom.schemas import FEATURES, FEATURE_VERSION, LABELED_DDL, SNAPSHOT_FEATURES, TXN_DDL


def read_transactions(spark: SparkSession, path: str, alt: str | None = None) -> DataFrame:
    """History from ``path``, or from ``alt`` when that is missing."""
    for candidate in (path, alt):
        if candidate is None:
            continue
        try:
            return spark.read.schema(TXN_DDL).parquet(candidate)
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no transaction history at {path!r} or {alt!r}")


def write_transactions(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet partitioned by day; rows of a day are spread by hash, so no day is one file."""
    df.withColumn("day", F.to_date("timestamp")).write.mode(mode).partitionBy("day").parquet(path)


def new_transactions(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of the batch whose transaction_id is not stored yet, one per id."""
    return batch.dropDuplicates(["transaction_id"]).join(
        existing.select("transaction_id"), "transaction_id", "left_anti")


def append_new(batch: DataFrame, path: str) -> None:
    """Insert-or-ignore on transaction_id."""
    spark = batch.sparkSession
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        write_transactions(batch.dropDuplicates(["transaction_id"]), path)
        return
    write_transactions(new_transactions(batch, stored), path)


def feature_snapshots(features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One JSON document of the 17 numeric features per transaction, with the columns of ``keep``."""
    numeric = model_input(features, ["transaction_id", *keep])
    return numeric.select("transaction_id", F.to_json(F.struct(*FEATURES)).alias("features"),
                          F.lit(FEATURE_VERSION).alias("feature_version"), *keep)


def write_feature_snapshots(features: DataFrame, path: str) -> None:
    feature_snapshots(features).write.mode("append").parquet(path)


def expand_feedback(labeled: DataFrame) -> DataFrame:
    """Label rows with their JSON features as columns and is_fraud."""
    return labeled.withColumn("f", F.from_json("features", SNAPSHOT_FEATURES)).select(
        "transaction_id", "f.*", (F.col("analyst_label") == "fraud").cast("int").alias("is_fraud"),
        "created_at")


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Stored labels, oldest first."""
    return expand_feedback(spark.read.schema(LABELED_DDL).parquet(path)).orderBy("created_at")


def write_instructions(splits: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines per split (train, val, test) under ``path/split=<name>``."""
    splits.write.mode(mode).partitionBy("split").json(path)
