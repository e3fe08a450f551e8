"""Derived tables shared by several registered queries, written once per application."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.session import stage

_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame],
           rows: Callable[[], int] = lambda: 0) -> DataFrame:
    """The table ``name`` of ``sf_dir``: built and written on first use, then read back. ``rows`` counts those of its input."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = stage(build(), name, rows())
    return _WRITTEN[key]
