"""Embedding near-duplicates by collision counting over sorted one-dimensional projections.

Vectors are scaled to length one and projected on orthonormal random directions. The first projection's order is cut
into blocks of about ``block`` vectors; a vector meets the blocks that its window of that projection reaches, two blocks
a task. There each query's windows in the other projections are counted per pair, and pairs with enough collisions are
verified by their cosine in double precision. Window and count follow from the recall wanted of a pair at the threshold:
its difference projects on each direction as a normal value of known variance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.components import connected_components
from riskloom.llm.staging import bounded_collect, stage


@dataclass(frozen=True)
class CollisionParams:
    """``order_recall``: share of pairs at the threshold inside each other's window of the sorted projection;
    ``count_recall``: share of those that reach the count of collisions."""

    threshold: float = 0.9
    projections: int = 16
    width: float = 1.7  # half window of the counted projections, in standard deviations of a pair at the threshold
    order_recall: float = 0.99
    count_recall: float = 0.998
    block: int = 4096
    max_lengths: int = 1000
    seed: int = 17

    @property
    def spread(self) -> float:
        """Length of the difference of two unit vectors at the threshold."""
        return math.sqrt(max(2 - 2 * self.threshold, 1e-12))

    @property
    def order_window(self) -> float:
        """Half window of the sorted projection, from ``order_recall`` by bisection."""
        low, high = 0.0, 10.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if math.erf(mid / math.sqrt(2)) < self.order_recall else (low, mid)
        return high * self.spread

    def least_count(self, counted: int) -> int:
        """The largest count that a pair at the threshold reaches with ``count_recall``."""
        hit = math.erf(self.width / math.sqrt(2))
        below = 0.0
        for k in range(counted + 1):
            below += math.comb(counted, k) * hit**k * (1 - hit)**(counted - k)
            if below > 1 - self.count_recall:
                return k
        return counted


#: Steps into which a half window of a counted projection is cut; values are compared as 16-bit integers.
STEPS = 100


def directions(length: int, p: CollisionParams) -> np.ndarray:
    """Orthonormal directions, scaled so that a random unit vector projects with variance one."""
    draw = np.random.default_rng(p.seed).standard_normal((length, length if length < p.projections else p.projections))
    return np.linalg.qr(draw)[0] * math.sqrt(length)


def _project(nodes: DataFrame, p: CollisionParams) -> DataFrame:
    """node, copies, length, unit vector, sorted projection and the counted ones as integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array(batch.column("length").to_pylist(), np.int64)
            order, units, first, rest = [], [], [], []
            flat = batch.column("embedding").to_pylist()
            for n in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == n)
                x = np.array([flat[i] for i in at], np.float64)
                x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                y = x @ directions(n, p)
                step = p.width * p.spread / STEPS
                counted = np.clip(np.rint(y[:, 1:] / step), -32000, 32000).astype("<i2")
                order += at.tolist()
                units += [v.tobytes() for v in x]
                first += y[:, 0].tolist()
                rest += [v.tobytes() for v in counted]
            rows = batch.take(pa.array(order, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("node"), rows.column("copies"), rows.column("length"), pa.array(units, pa.binary()),
                 pa.array(first, pa.float64()), pa.array(rest, pa.binary())],
                names=["node", "copies", "length", "unit", "place", "counted"])

    return nodes.select("node", "copies", "length", "embedding").mapInArrow(
        run, "node bigint, copies bigint, length int, unit binary, place double, counted binary")


def _block_pairs(rows: DataFrame, p: CollisionParams) -> DataFrame:
    """Every row once for each pair of blocks (low, high) in which it takes part."""
    sizes = bounded_collect(rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")), p.max_lengths)
    bounds = {}
    for r in sizes:
        blocks = math.ceil(r.n / p.block)
        cuts = [k / blocks for k in range(1, blocks)]
        bounds[r.length] = sorted(rows.where(F.col("length") == r.length).approxQuantile("place", cuts, 0.1 / blocks)) if cuts else []
    window = p.order_window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            at, low, high, side = [], [], [], []
            for i, n in enumerate(batch.column("length").to_pylist()):
                cuts = bounds[n]
                own = int(np.searchsorted(cuts, place[i], "right"))
                # As the later vector: blocks that reach up to it. As the earlier one: blocks its window reaches.
                first = int(np.searchsorted(cuts, place[i] - window, "right"))
                last = int(np.searchsorted(cuts, place[i] + window, "right"))
                for b in range(first, own):
                    at.append(i), low.append(b), high.append(own), side.append(1)
                for b in range(own, last + 1):
                    at.append(i), low.append(own), high.append(b), side.append(0)
            for s in range(0, len(at), 20_000):
                part = batch.take(pa.array(at[s:s + 20_000], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(x[s:s + 20_000], pa.int32()) for x in (low, high, side))],
                    names=[*part.schema.names, "low", "high", "side"])

    return rows.mapInArrow(run, "node bigint, copies bigint, length int, unit binary, place double, counted binary, low int, high int, side int")


def _join_roots(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merges the trees that the pairs connect; ``root`` stays flat, a root being its tree's least place."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def _count_pairs(table: pa.Table, p: CollisionParams) -> pa.Table:
    """Links of one pair of blocks: per node its links here (copies counted) and a node it is connected with.

    Vectors of the lower block are the queries and those of the higher one their partners; in a block with itself the
    partners are the later vectors.
    """
    low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
    place = table.column("place").to_numpy()
    side = table.column("side").to_numpy()
    order = np.lexsort((table.column("node").to_numpy(), place, side))
    place, side = place[order], side[order]
    node, copies = table.column("node").to_numpy()[order], table.column("copies").to_numpy()[order]
    unit = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(len(order), -1)[order]
    raw = b"".join(table.column("counted").to_pylist())
    # As unsigned numbers, a gap within the half window on either side is a single comparison.
    counted = np.ascontiguousarray(np.frombuffer(raw, "<i2").reshape(len(order), -1)[order].T).view(np.uint16)
    half, least = np.uint16(STEPS + 1), p.least_count(len(counted))
    links, root = np.zeros(len(node), np.int64), np.arange(len(node))
    queries = len(node) if low == high else int((side == 0).sum())
    base = 0 if low == high else queries
    ends = base + np.searchsorted(place[base:], place[:queries] + p.order_window, "right")
    for at in range(0, queries, 64):
        stop = min(at + 64, queries)
        begin, end = at + 1 if low == high else base, int(ends[stop - 1])
        if begin >= end:
            continue
        hits = np.zeros((stop - at, end - begin), np.uint8)
        gap, near = np.empty(hits.shape, np.uint16), np.empty(hits.shape, bool)
        for row in counted:
            np.subtract(row[None, begin:end] + half, row[at:stop, None], out=gap)
            np.less_equal(gap, 2 * half, out=near)
            np.add(hits, near.view(np.uint8), out=hits)
        np.greater_equal(hits, least, out=near)
        i, j = np.nonzero(near)
        i, j = i + at, j + begin
        inside = (j < ends[i]) & ((j > i) if low == high else True)
        i, j = i[inside], j[inside]
        if not len(i):
            continue
        if len(i) * 8 > near.size:
            cosine = (unit[at:stop] @ unit[begin:end].T)[i - at, j - begin]
        else:
            cosine = np.einsum("ij,ij->i", unit[i], unit[j])
        i, j = i[cosine >= p.threshold], j[cosine >= p.threshold]
        if len(i):
            links += np.bincount(i, copies[j], len(node)).astype(np.int64) + np.bincount(j, copies[i], len(node)).astype(np.int64)
            root = _join_roots(root, i, j)
    on = np.flatnonzero(links)
    return pa.table({"node": pa.array(node[on], pa.int64()), "links": pa.array(links[on]), "other": pa.array(node[root[on]], pa.int64())})


def link_vectors(vectors: DataFrame, p: CollisionParams = CollisionParams()) -> DataFrame:
    """vec_id, n_links, component_id (least vec_id reachable) and kept (vec_id = component_id), one row per vector.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; neither do vectors of
    different lengths. Equal vectors are one node that counts with its copies, so repeated rows link with each other.
    A null vec_id takes part but is never the least. Every link found is verified; the share of links found is at least
    order_recall * count_recall at the threshold and rises quickly above it.
    """
    sound = (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) \
        & F.exists("embedding", lambda x: x != 0)
    rows = stage(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).select(
        "vec_id", "embedding", F.monotonically_increasing_id().alias("row"), F.coalesce(sound, F.lit(False)).alias("sound"),
        F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2")), "vectors")
    groups = stage(rows.where("sound").groupBy("k1", "k2").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"),
        F.first("embedding").alias("embedding")), "groups")
    projected = stage(_project(groups.withColumn("length", F.size("embedding")), p), "projected")
    found = stage(_block_pairs(projected, p).groupBy("length", "low", "high").applyInArrow(
        lambda t: _count_pairs(t, p), "node bigint, links bigint, other bigint"), "links")
    component = connected_components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    nodes = (groups.select("k1", "k2", "node", "copies", "least")
             .join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
             .join(component.withColumnRenamed("id", "node"), "node", "left")
             .select("k1", "k2", "least", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                     F.coalesce("component", "node").alias("root")))
    nodes = stage(nodes, "nodes")
    least = stage(nodes.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = stage(nodes.join(least, "root").select("k1", "k2", "n_links", "component_id"), "named")
    linked = rows.where("sound").select("vec_id", "k1", "k2").join(named, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    apart = rows.where("NOT sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(apart).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
