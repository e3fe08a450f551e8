"""Intermediate tables in the shared folder, and folders of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import stage, work_dir

__all__ = ["bounded_batches", "bounded_collect", "fresh_dir", "own_exchange", "set_aside", "stage"]


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` that every executor reaches."""
    return work_dir(spark, name)


#: Rows that a Python task receives at once; a batch of the default size may hold tens of megabytes of text.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to ``BATCH_ROWS`` rows, which bounds the buffers on both sides of a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def bounded_collect(df: DataFrame, limit: int) -> list:
    """Rows of a table whose size the caller bounds; more than ``limit`` rows is an error, never a cut."""
    rows = df.take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    return rows


def set_aside(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[Column]]:
    """``df`` with other names for those of its columns that are called as one of ``names``, and the list that selects all
    columns under their own names again; so an operator's own columns never meet those of its input."""
    taken = {c.lower() for c in [*df.columns, *names]}
    inner = {}
    for c in df.columns:
        new = c
        while new.lower() in taken and c.lower() in {n.lower() for n in names}:
            new += "_"
        taken.add(new.lower())
        inner[c] = new
    return df.withColumnsRenamed(inner), [F.col(f"`{inner[c]}`").alias(c) for c in df.columns]


def own_exchange(grouped: DataFrame, key: str) -> DataFrame:
    """``grouped`` (one row per ``key``) such that a later join by the key shuffles it anew.

    A join that reuses the partitioning of an aggregate can't be split by adaptive execution; one between two plain
    exchanges can, and the other side may have very many rows of one key. The key passes through an expression that
    leaves its value alone.
    """
    return grouped.withColumn(key, F.when(F.rand(0) < 2, F.col(key)))
