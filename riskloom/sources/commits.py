"""Commit records: a version of a set of files exists for readers once its record is written, and not before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _store(spark: SparkSession, path: str):
    files = spark._jvm.org.apache.hadoop.fs
    folder = files.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def commit(record: DataFrame, root: str, version: int) -> None:
    """Writes the record of a version; it counts from the moment when Spark marks the folder as complete."""
    record.coalesce(1).write.mode("overwrite").parquet(f"{root}/_commits/version={version}")


def committed(spark: SparkSession, root: str) -> list[int]:
    """The versions whose records are complete, oldest first; one number per publication."""
    store, folder = _store(spark, f"{root}/_commits/version=*/_SUCCESS")
    return sorted(int(found.getPath().getParent().getName().split("=")[1]) for found in store.globStatus(folder) or [])


def record(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{root}/_commits/version={version}")
