"""Exact running totals and ranks without sorting a whole group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.hashing import shuffle_key
from riskloom.session import stage


def stage_ordered(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Writes ``df`` range-partitioned by (group, value), each row with its range number.

    Ranges are balanced by sampling whatever the distribution, and a group that
    holds most rows is cut into many ranges. The numbers are stored with the rows:
    every later read, also after an executor is lost, sees the same cut. ``df`` has
    one row per (group, value), so it must be aggregated first.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *group, value)
    return stage(ranged.withColumn("_part", F.spark_partition_id()), "ordered")


def running_totals(ordered: DataFrame, group: Sequence[str], value: str, sums: Sequence[str],
                   descending: bool = False, with_next: bool = False) -> DataFrame:
    """Adds ``cum_<s>``, totals over values up to and including the row's.

    Two-phase prefix sum over a table from :func:`stage_ordered`: totals of the
    ranges before mine (a table of one row per range and group) plus a window
    inside my range. ``with_next`` adds the following distinct value.
    """
    group = list(group)
    ends = F.max if descending else F.min
    order = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    ranges = ordered.groupBy(*group, "_part").agg(
        *[F.sum(s).alias(f"_t_{s}") for s in sums], ends(value).alias("_edge"))
    # One row per range here: the constant key of an ungrouped run is bounded by the range count.
    across = Window.partitionBy(*(group or [F.lit(0)])).orderBy(order("_part"))
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = ranges.select(
        *group, "_part",
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_c_{s}") for s in sums],
        F.lead("_edge").over(across).alias("_next"))
    mine = Window.partitionBy(*group, "_part").orderBy(order(value))
    inside = mine.rowsBetween(Window.unboundedPreceding, 0)
    columns = [(F.col(f"_c_{s}") + F.sum(s).over(inside)).alias(f"cum_{s}") for s in sums]
    if with_next:
        columns.append(F.coalesce(F.lead(value).over(mine), F.col("_next")).alias("next_value"))
    kept = [c for c in ordered.columns if c != "_part"]
    return ordered.join(carry, [*group, "_part"]).select(*kept, *columns)


def _prefix_ranks(df: DataFrame, label: str | None, id_col: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows with ``_key`` and ``_prefix``, per label and prefix: its size, the rows before it, the label's size)."""
    keys = [label] if label else []
    rows = df.withColumn("_key", shuffle_key(F.col(id_col), seed)).withColumn(
        "_prefix", F.substring("_key", 1, 4))
    sizes = rows.groupBy(*keys, "_prefix").agg(F.count(F.lit(1)).alias("_m"))
    if keys:
        per_label = Window.partitionBy(*keys)
    else:
        per_label = Window.partitionBy(F.lit(0))  # at most 65,536 prefix rows
    before = per_label.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, -1)
    return rows, sizes.select(*keys, "_prefix", "_m",
                              F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"),
                              F.sum("_m").over(per_label).alias("_n"))


def hash_rank(df: DataFrame, label: str | None, id_col: str, seed: int) -> DataFrame:
    """Adds ``_rank`` (1-based, hash order within the label) and ``_n`` (label size).

    Ranks come from a two-step sum: sizes of 2^16 hash prefixes per label, then a
    window inside each prefix. Even one label that holds every row is ranked by
    65,536 independent groups, and the order is reproducible from id and seed.
    """
    keys = [label] if label else []
    rows, carry = _prefix_ranks(df, label, id_col, seed)
    inside = Window.partitionBy(*keys, "_prefix").orderBy("_key", id_col)
    return (rows.join(carry.drop("_m"), [*keys, "_prefix"])
            .withColumn("_rank", F.col("_before") + F.row_number().over(inside))
            .drop("_key", "_prefix", "_before"))


def hash_edges(df: DataFrame, label: str, id_col: str, seed: int, cuts: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows at given ranks in the order of :func:`hash_rank`: per label one struct (key, id) for each of ``names``.

    ``cuts``: the label and a rank in each column of ``names``; no row has rank 0, so its struct is null. Only the
    prefixes that hold a wanted rank are sorted, and only label and id are read.
    """
    rows, carry = _prefix_ranks(df.select(label, id_col).where(F.col(id_col).isNotNull()), label, id_col, seed)
    at = F.inline(F.array(*[F.struct(F.lit(n).alias("_name"), F.col(n).cast("bigint").alias("_at")) for n in names]))
    wanted = (cuts.select(label, at).join(carry, label)
              .where((F.col("_at") > F.col("_before")) & (F.col("_at") <= F.col("_before") + F.col("_m"))))
    inside = Window.partitionBy(label, "_name").orderBy("_key", id_col)
    found = (rows.join(F.broadcast(wanted), [label, "_prefix"]).withColumn("_r", F.row_number().over(inside))
             .where(F.col("_before") + F.col("_r") == F.col("_at")))
    edges = found.groupBy(label).agg(*[F.max(F.when(F.col("_name") == n, F.struct("_key", id_col))).alias(n) for n in names])
    return cuts.select(label).join(edges, label, "left")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last by ``order``.

    ``max_by`` over a struct combines before the shuffle, so a key with very many
    versions sends one row per map task.
    """
    rest = [c for c in df.columns if c not in keys]
    folded = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return folded.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
           salt: Column, salts: int = 64) -> DataFrame:
    """The last ``n`` rows per key: first per (key, salt), then over the survivors."""
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
            .withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= n)
            .withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= n)
            .drop("_salt", "_r"))
