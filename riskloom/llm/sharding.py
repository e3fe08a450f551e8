"""Sharding by balanced label propagation.

Documents are linked through hubs (a hub is anything that several documents share, such as equal text). A hub
stands for all links among its members, so links are never written out. Rounds of Spark joins move each linked
document towards the shard in which most of its neighbours are, as far as the shard's quota of rows allows; in the
end a rank per shard moves the few rows that are still over the quota, unlinked ones first, and numbers the slots.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.staging import stage


@dataclass(frozen=True)
class ShardParams:
    """``rows_per_bucket`` bounds the rows that one task ranks; more rows make more buckets."""

    shards: int = 8
    max_rounds: int = 10
    rows_per_bucket: int = 100_000
    least_buckets: int = 64
    seed: int = 3


def _table(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("bigint") for v in values])


def _by_shard(df: DataFrame, shards: int) -> list[int]:
    """Rows per shard: one number each."""
    got = {r["shard"]: r["n"] for r in df.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    return [int(got.get(s, 0)) for s in range(shards)]


def quotas(rows: int, shards: int) -> list[int]:
    """Row counts at most one apart."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def propose(members: DataFrame, free: list[int], p: ShardParams) -> DataFrame:
    """Rows that would rather be elsewhere: row, shard, target, the hub that draws them most.

    ``members`` has row, hub and the row's shard. A row's votes are the members of its hubs in each shard. Only shards
    with room are targets. A row moves to a shard with more votes, or as many and a lower number, so that two halves of
    a group do not change places for ever.
    """
    # Written first: a join whose sides are both plain exchanges can be split where a hub holds very many rows.
    counts = stage(members.groupBy("hub").agg(
        F.array(*[F.sum((F.col("shard") == s).cast("bigint")) for s in range(p.shards)]).alias("votes")), "votes")
    seen = members.join(counts, "hub").groupBy("row").agg(
        F.first("shard").alias("shard"),
        F.max(F.struct(F.array_max("votes").alias("n"), F.col("hub"))).getField("hub").alias("hub"),
        F.array(*[F.sum(F.col("votes")[s]) for s in range(p.shards)]).alias("votes"))
    own = F.get("votes", F.col("shard"))
    best = F.array_max(F.transform(F.col("votes"), lambda v, s: F.struct(
        F.when(F.get(_table(free), s) > 0, v).otherwise(F.lit(-1)).alias("n"), (-s).alias("minus"))))
    return (seen.withColumn("_best", best).withColumn("target", (-F.col("_best.minus")).cast("int"))
            .where((F.col("target") != F.col("shard")) & ((F.col("_best.n") > own) | (
                (F.col("_best.n") == own) & (F.col("target") < F.col("shard")))))
            .select("row", "shard", "target", "hub"))


def admit(movers: DataFrame, free: list[int], buckets: int, turn: int) -> DataFrame:
    """The movers for whom their target has room; a hub is admitted as a whole where possible.

    Hubs queue by size (in powers of two, largest first), then by hash: a large group needs most of a shard, small
    ones fit anywhere later. The place in the queue is a sum over buckets (few rows per target) and one inside each
    bucket; the hub at which the room ends sends a share of its rows, chosen by a hash of row and round.
    """
    hubs = movers.groupBy("hub", "target").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "b", (F.lit(64) - F.floor(F.log2("n"))) * buckets + F.pmod(F.xxhash64("hub"), F.lit(buckets)))
    sums = hubs.groupBy("target", "b").agg(F.sum("n").alias("m"))
    ahead = sums.select("target", "b", F.coalesce(F.sum("m").over(
        Window.partitionBy("target").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("target", "b").orderBy("hub").rowsBetween(Window.unboundedPreceding, -1)
    queue = hubs.join(ahead, ["target", "b"]).select(
        "hub", "target",
        ((F.get(_table(free), F.col("target")) - F.col("ahead") - F.coalesce(F.sum("n").over(inside), F.lit(0))) / F.col("n")).alias("share"))
    draw = F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return (movers.join(queue.where("share > 0"), ["hub", "target"]).where(draw < F.col("share"))
            .select("row", "target"))


def propagate(members: DataFrame, n_rows: int, p: ShardParams = ShardParams()) -> DataFrame:
    """Shards of the linked rows (row, shard) after the rounds; staged after each, so a lost executor costs one round.

    ``members`` has (row, hub), each pair once; a row may have several hubs. No members: an empty table.
    """
    buckets = max(p.least_buckets, n_rows // p.rows_per_bucket)
    labels = stage(members.select("row").distinct().select(
        "row", F.pmod(F.xxhash64("row", F.lit(p.seed)), F.lit(p.shards)).cast("int").alias("shard")), "labels")
    room = quotas(n_rows, p.shards)
    for turn in range(p.max_rounds):
        sizes = _by_shard(labels, p.shards)
        free = [max(q - s, 0) for q, s in zip(room, sizes)]
        movers = stage(propose(members.join(labels, "row"), free, p), "movers")
        moved = stage(admit(movers, free, buckets, turn), "moved")
        if not moved.take(1):
            break
        labels = stage(labels.join(moved, "row", "left").select(
            "row", F.coalesce("target", "shard").cast("int").alias("shard")), "labels")
    return labels


def fill(rows: DataFrame, labels: DataFrame, p: ShardParams = ShardParams()) -> DataFrame:
    """Adds ``shard`` and ``slot`` to all rows: linked rows keep their label, the others fill up to equal row counts.

    Slots run from 0 in each shard without gaps. Ranks come from counts per (shard, bucket) and a window inside each
    bucket; only numbers per shard reach the driver.
    """
    n = rows.count()
    buckets = max(p.least_buckets, n // p.rows_per_bucket)
    placed = rows.join(labels.withColumnRenamed("shard", "_label"), "row", "left").select(
        *rows.columns, F.col("_label").isNull().cast("int").alias("_single"),
        F.coalesce("_label", F.pmod(F.xxhash64("row", F.lit(p.seed)), F.lit(p.shards)).cast("int")).alias("shard"),
        F.pmod(F.xxhash64("row", F.lit(p.seed + 1)), F.lit(buckets)).alias("_b"))
    placed = stage(placed, "placed")
    sums = placed.groupBy("shard", "_single", "_b").agg(F.count(F.lit(1)).alias("_m"))
    ahead = sums.select("shard", "_single", "_b", F.coalesce(F.sum("_m").over(
        Window.partitionBy("shard").orderBy("_single", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inside = Window.partitionBy("shard", "_single", "_b").orderBy("row")
    ranked = placed.join(ahead, ["shard", "_single", "_b"]).withColumn(
        "_rank", F.col("_ahead") + F.row_number().over(inside) - 1)
    sizes, room = _by_shard(placed, p.shards), quotas(n, p.shards)
    over = [max(s - q, 0) for s, q in zip(sizes, room)]
    gaps = [max(q - s, 0) for s, q in zip(sizes, room)]
    over_before = [sum(over[:s]) for s in range(p.shards)]
    gap_before = [sum(gaps[:s]) for s in range(p.shards)]
    surplus = F.col("_rank") >= F.get(_table(room), F.col("shard"))
    place = F.get(_table(over_before), F.col("shard")) + F.col("_rank") - F.get(_table(room), F.col("shard"))
    new_shard = F.lit(None).cast("int")
    for s in range(p.shards):
        if gaps[s]:
            new_shard = F.when((place >= gap_before[s]) & (place < gap_before[s] + gaps[s]), s).otherwise(new_shard)
    shard = F.when(surplus, new_shard).otherwise(F.col("shard")).cast("int")
    slot = F.when(surplus, F.get(_table(sizes), new_shard) + place - F.get(_table(gap_before), new_shard)).otherwise(F.col("_rank"))
    return ranked.select(*rows.columns, shard.alias("shard"), slot.cast("bigint").alias("slot"))


def shard_documents(docs: DataFrame, p: ShardParams = ShardParams()) -> DataFrame:
    """Documents linked by equal text: doc_id, size, text_crc32, shard, slot, one row per row of ``docs``.

    ``size`` is the UTF-8 bytes of the text plus 1. A null text counts as empty; repeated rows and repeated or null ids
    are rows of their own. Counts per shard differ by one row at most. No rows: no rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = stage(docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("hub")), "rows")
    groups = rows.groupBy("hub").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("hub")
    members = stage(rows.select("row", "hub").join(groups, "hub"), "members")
    labels = propagate(members, rows.count(), p)
    return fill(rows.drop("hub"), labels, p).drop("row")
