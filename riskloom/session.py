"""Session helpers shared by jobs, tests and the bench."""

from __future__ import annotations

import math
import os
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "riskloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE, Arrow).

    On a cluster pass no master: spark-submit provides it, together with
    ``spark.sql.shuffle.partitions`` and ``spark.checkpoint.dir``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for streaming checkpoints and staged tables.

    Executors on other hosts must see it, so it is placed under the shared
    ``spark.checkpoint.dir``. Only when that is unset (single-machine tests)
    does it fall back to a temporary folder.
    """
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = os.path.join(tempfile.gettempdir(), "riskloom")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_AREAS: list[list[str]] = []


@contextmanager
def staging_area(spark: SparkSession) -> Iterator[None]:
    """Owns the tables staged inside it and removes them at its end.

    Results are lazy, so write (or collect) them inside::

        with staging_area(spark):
            linked_counts(txns).write.parquet(target)
    """
    _AREAS.append([])
    try:
        yield
    finally:
        for path in _AREAS.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def owned_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that goes with the innermost staging area, where there is one."""
    path = work_dir(spark, name)
    if _AREAS:
        _AREAS[-1].append(path)
    return path


#: What one task is to hold: bytes of a shuffle or of files, and rows of the input.
TASK_BYTES, TASK_ROWS = 16 << 20, 100_000


def _bytes(text: str) -> int:
    """A size as Spark's settings spell it (1048576b, 64k, 16MB)."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


@contextmanager
def bounded_tasks(spark: SparkSession, rows: int = 0) -> Iterator[None]:
    """Jobs that start inside are dealt to more tasks where the input is larger, not to larger tasks.

    A shuffle is merged to tasks of ``TASK_BYTES`` at most, a scan reads as much in a task, and shuffles of ``rows`` rows have
    a partition for ``TASK_ROWS``. Settings that are finer already stay.
    """
    sizes = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes")
    parts = "spark.sql.shuffle.partitions"
    before = {name: spark.conf.get(name) for name in (*sizes, parts)}
    wanted = {name: str(TASK_BYTES) for name in sizes if _bytes(before[name]) > TASK_BYTES}
    if math.ceil(rows / TASK_ROWS) > int(before[parts]):
        wanted[parts] = str(math.ceil(rows / TASK_ROWS))
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name in wanted:
            spark.conf.set(name, before[name])


def stage(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """Writes ``df`` once and reads it back.

    Used where several branches of a plan need the same expensive intermediate:
    it is computed once, pruned on read, and outlives lost executors. Where the caller counts the ``rows`` of
    its input, tasks are bounded by :func:`bounded_tasks`.
    """
    path = owned_dir(df.sparkSession, name)
    with bounded_tasks(df.sparkSession, rows) if rows else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
