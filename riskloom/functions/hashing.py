"""Deterministic hash buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canary_bucket(customer_id: Column) -> Column:
    """The 128-bit MD5 integer of the id, modulo 100.

    Spark has no 128-bit integers, so the hex digest is folded 32 bits at a
    time; 16^8 mod 100 = 96.
    """
    digest = F.md5(customer_id.cast("binary"))
    acc = F.lit(0).cast("bigint")
    for start in (1, 9, 17, 25):
        chunk = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
        acc = F.pmod(acc * F.lit(96) + chunk, F.lit(100).cast("bigint"))
    return acc


def shuffle_key(id_col: Column, seed: int) -> Column:
    """A reproducible pseudo-random sort key per id (hex text)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), id_col.cast("string")).cast("binary"))
