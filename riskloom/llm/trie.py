"""Prefix trie of conversations, with subtree totals by a depth-band rollup.

A node is a distinct sequence of first turns. Its key is the exclusive-or of two 64-bit hashes of every (place, turn) on its path,
so keys of prefixes are running totals: they are made band by band, ``height`` places each, and the bands of a long
conversation are put together by the same rule, one level higher. Each node knows the keys of its own band only.

Rollup: every node explodes to its ancestors within its band and to the node that the band hangs from, never further. Those
band roots form a trie of their own, lower by the factor ``height``, which is rolled up in the same way; its completed
totals go back to the ancestors inside the band that a band root closes. Rounds grow with the logarithm of the depth, and
no row explodes to more than ``height`` + 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm.staging import stage

HEIGHT = 4
#: Ends of one node are joined in groups of ids that differ in the low bits only.
CHUNK_BITS = 12
SEEDS = (17, 71)
KEY = ["k1", "k2"]


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def order_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 0), content (digest of role and text) and n_bytes (of the text) of every turn.

    Order: turn, null first, then digest; null role or text counts as empty. Rows without conv_id belong to no conversation
    and take no part. A conversation may hold most rows: turns are ranked inside ranges of (conversation, turn), and
    at most one conversation per range continues from the range before, so the table of offsets is as short as the
    number of ranges.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("content"),
        F.octet_length(text).cast("bigint").alias("n_bytes"))
    ranges = rows.repartitionByRange(_parts(rows), "conv_id", F.col("turn").asc_nulls_first(), "content")
    rows = stage(ranges.withColumn("part", F.spark_partition_id()), "turns")
    counts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    several = counts.groupBy("conv_id").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("conv_id")
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (counts.join(several, "conv_id").withColumn("offset", F.sum("n").over(before))
               .where("offset is not null").select("conv_id", "part", "offset"))
    inside = W.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), "content")
    placed = rows.withColumn("rank", F.row_number().over(inside).cast("bigint"))
    return placed.join(F.broadcast(offsets), ["conv_id", "part"], "left").select(  # a row per range at most
        "conv_id", (F.col("rank") - 1 + F.coalesce("offset", F.lit(0))).alias("pos"), "content", "n_bytes")


def share_heads(turns: DataFrame, family: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Paths whose first turns come from the family's first conversation; and (conv_id, n_turns) of every conversation.

    Conversation c takes the first h turns of conversation c - c % family (the remainder has the sign of c), h = crc32
    of its decimal id modulo ``heads``, then its own turns after its first h. Paths: conv_id, i (from 1), content,
    n_bytes, n_turns. Of a family's first conversation no more than ``heads`` - 1 turns are copied, to its few members.
    """
    turns = stage(turns, "ordered")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_own"))
    own = stage(own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % family, "h": h}), "conversations")
    bases = own.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    head = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = stage(own.join(bases, "base", "left").select("conv_id", "base", head.alias("n_head"), (
        head + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns")), "conversations")
    first = turns.where((F.col("conv_id") % family == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv_id", "base")
    shared = first.join(convs, "base").where("pos < n_head").select(
        "conv_id", (F.col("pos") + 1).alias("i"), "content", "n_bytes", "n_turns")
    rest = turns.where(F.col("pos") >= h).join(convs, "conv_id").select(
        "conv_id", (F.col("n_head") + F.col("pos") - h + 1).alias("i"), "content", "n_bytes", "n_turns")
    return shared.unionByName(rest), convs.select("conv_id", "n_turns")


def _levels(rows: DataFrame, height: int) -> list[DataFrame]:
    """Keys of all prefixes, then of those that end a band, then of those that end a band of bands, and so on.

    ``rows`` has conv_id, i, x1 and x2 (hashes of the place and the turn there) and may have more. Each level adds k1, k2 and path:
    the keys of the node that the band hangs from, and of all nodes of the band down to the row's own.
    """
    band = F.expr(f"(i - 1) div {height}")
    w = W.partitionBy("conv_id", "band").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    inner = rows.withColumn("band", band).withColumns(
        {"k1": F.bit_xor("x1").over(w), "k2": F.bit_xor("x2").over(w)}).withColumn(
        "path", F.collect_list(F.struct(*KEY)).over(w)).drop("x1", "x2")
    none = F.lit(0).cast("bigint")
    if not rows.where(F.col("i") > height).take(1):
        root = F.array(F.struct(none.alias("k1"), none.alias("k2")))
        return [stage(inner.withColumn("path", F.concat(root, "path")).drop("band"), "prefixes")]
    whole = rows.groupBy("conv_id", band.alias("band")).agg(
        F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"), F.count(F.lit(1)).alias("n")).where(F.col("n") == height)
    above = _levels(stage(whole.select("conv_id", (F.col("band") + 1).alias("i"), "x1", "x2"), "bands"), height)
    start = above[0].select("conv_id", F.col("i").alias("band"), F.col("k1").alias("o1"), F.col("k2").alias("o2"))
    o1, o2 = F.coalesce("o1", none), F.coalesce("o2", none)
    shifted = F.transform("path", lambda p: F.struct(p["k1"].bitwiseXOR(o1).alias("k1"), p["k2"].bitwiseXOR(o2).alias("k2")))
    keyed = inner.join(start, ["conv_id", "band"], "left").withColumns({
        "path": F.concat(F.array(F.struct(o1.alias("k1"), o2.alias("k2"))), shifted),
        "k1": F.col("k1").bitwiseXOR(o1), "k2": F.col("k2").bitwiseXOR(o2)})
    return [stage(keyed.drop("band", "o1", "o2"), "prefixes"), *above]


def _is_root() -> Column:
    return (F.col("k1") == 0) & (F.col("k2") == 0)


def _subtree(values: DataFrame, above: list[DataFrame], height: int, totals: list[str]) -> DataFrame:
    """k1, k2 and ``totals`` summed over the subtree of every node, and for the root over all nodes.

    ``values`` has the nodes of one level (k1, k2, i, path and the values to sum), ``above`` the prefixes of the levels
    over it.
    """
    sums = [F.sum(c).alias(c) for c in totals]
    reached = values.select(F.posexplode("path").alias("at", "to"), *totals)
    local = stage(reached.groupBy("to.k1", "to.k2", (F.col("at") == 0).alias("hangs")).agg(*sums), "band-sums")
    if not above:
        return local.groupBy(*KEY).agg(*sums)
    under = local.where("hangs").select(*KEY, *totals)
    roots = above[0].groupBy("i", *KEY).agg(F.first("path").alias("path")).join(under, KEY, "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in totals}
    complete = stage(_subtree(roots.withColumns(zero), above[1:], height, totals), "band-roots")
    closing = values.where(F.col("i") % height == 0).select(*KEY, "path").join(complete, KEY)
    lifted = closing.select(F.posexplode("path").alias("at", "to"), *totals).where("at > 0").select("to.*", *totals)
    inside = local.where(~F.col("hangs") | _is_root()).select(*KEY, *totals)
    return inside.unionByName(lifted).unionByName(complete.where(_is_root())).groupBy(*KEY).agg(*sums)


def _ends(ends: DataFrame) -> DataFrame:
    """k1, k2 and the SHA-256 of the ids in ``ends`` (k1, k2, conv_id), ascending, joined by commas.

    Ids that share their high bits are joined first, at most 2**CHUNK_BITS of them; a task then feeds a node's groups to
    the digest one after another, so a node with very many ends needs no list of them.
    """
    chunk = F.shiftright("conv_id", CHUNK_BITS)
    joined = ends.groupBy(*KEY, chunk.alias("chunk")).agg(
        F.concat_ws(",", F.array_sort(F.collect_list("conv_id")).cast("array<string>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            k1, k2, out = [], [], []
            for *own, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if own != key:
                    if key is not None:
                        k1.append(key[0]), k2.append(key[1]), out.append(digest.hexdigest())
                    key, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(out, pa.string())],
                                             names=[*KEY, "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_pydict({"k1": [key[0]], "k2": [key[1]], "ends_sha256": [digest.hexdigest()]})

    return joined.repartition(_parts(ends), *KEY).sortWithinPartitions(*KEY, "chunk").mapInArrow(
        run, "k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(paths: DataFrame, convs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The nodes of the trie of ``paths`` (conv_id, i, content, n_bytes, n_turns), with totals of their subtrees.

    ``convs`` names every conversation (conv_id, n_turns), also those without turns, which are members of the root alone. Per node:
    conv_id (its least member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves,
    saved_tokens (bytes of the last text times members but one, summed over the subtree) and ends_sha256 (of the ids of the
    members that end there). No conversations: no nodes. Equal paths share their nodes; a node with a great part of all
    members is a group that adds up before it is shuffled.
    """
    hashed = [F.xxhash64(F.lit(seed), "i", "content").alias(f"x{k}") for k, seed in enumerate(SEEDS, 1)]
    paths = stage(paths.select("conv_id", "i", "n_bytes", "n_turns", *hashed), "paths")
    levels = _levels(paths, height)
    none, end = F.lit(0).cast("bigint"), levels[0].where("i = n_turns").select(*KEY, "conv_id")
    nodes = levels[0].groupBy("i", *KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"),
                                             F.first("n_bytes").alias("n_bytes"), F.first("path").alias("path"))
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(
        none.alias("i"), none.alias("k1"), none.alias("k2"), "n_convs", "conv_id", none.alias("n_bytes"),
        F.lit(None).cast("array<struct<k1:bigint,k2:bigint>>").alias("path"))
    parent = F.get("path", F.size("path") - 2)
    nodes = stage(root.unionByName(nodes).withColumns({"p1": parent["k1"], "p2": parent["k2"]}), "nodes")
    children = nodes.where("path is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = stage(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", none)).withColumns({
        "leaf": (F.col("n_children") == 0).cast("bigint"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes")}), "counted")
    below = _subtree(nodes.where("path is not null").select(*KEY, "i", "path", "leaf", "saved"), levels[1:], height, ["leaf", "saved"])
    below = stage(below.withColumnsRenamed({"leaf": "leaves", "saved": "all_saved"}), "totals")
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    ends = _ends(end.unionByName(convs.where("n_turns = 0").select(none.alias("k1"), none.alias("k2"), "conv_id")))
    total = nodes.join(below, KEY, "left").join(parents, ["p1", "p2"], "left").join(ends, KEY, "left")
    return total.select(
        "conv_id", F.col("i").alias("depth"), "parent_conv_id", "n_convs", "n_children",
        # A root without turns below is its only node, and a leaf.
        F.coalesce("leaves", "leaf").alias("n_leaves"), F.coalesce("all_saved", none).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
