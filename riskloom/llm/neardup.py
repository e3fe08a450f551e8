"""MinHash near-duplicates with an LSH forest.

Every distinct shingle set is one node. A node's signature is cut into several trees, each an order of the nodes by
its own hashes. Nodes that share a prefix of a tree are a region; a region with too many nodes is cut at the next hash,
deeper and deeper in steps, so the depth follows the crowd. Candidates are a region's nodes and, where a region was cut, one
node of each part. Signatures then drop pairs that are far from the threshold, and whole texts confirm the rest.

Links come in two rounds. The first confirms a spanning forest of each region, best pairs first, which joins a family
of copies with one pair per member. The second looks at the undivided regions of the least depth whose nodes are still
in different components and compares every remaining pair between components inside bounded blocks, so no pair of a
region goes unseen, whatever cuts and chunks came between, and only confirmed links leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.components import connected_components
from riskloom.llm.staging import own_exchange, set_aside, stage
from riskloom.llm.textops import Slice, kind_table, lower_ascii, ngrams, run_hashes, runs, slices

#: Words are what stands between spaces and the bytes 0x09 to 0x0D, after lower-casing A-Z.
KINDS = kind_table([0x20, *range(0x09, 0x0E)])


@dataclass(frozen=True)
class ForestParams:
    """Links are sets with 100 * intersection >= percent * union.

    ``slack`` is how far below the threshold a signature's estimate may fall before a pair is dropped: 0.12 is almost
    four standard deviations of the estimate at 128 hashes.
    """

    shingle: int = 5
    percent: int = 80
    trees: int = 16
    depth: int = 8
    least_depth: int = 4
    step: int = 2
    region: int = 64
    block: int = 512
    slack: float = 0.12
    seed: int = 5

    @property
    def hashes(self) -> int:
        return self.trees * self.depth


def shingle_sets(part: Slice, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every row; no words, no shingles."""
    data = lower_ascii(part.data)
    words = runs(part, KINDS[data])
    grams, row = ngrams(run_hashes(data, words), words, size, short=True)
    bounds = np.searchsorted(row, np.arange(part.rows + 1))
    return [np.unique(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


def fingerprint(shingles: np.ndarray) -> bytes | None:
    """128 bits that stand for a set; None for the empty one."""
    if not len(shingles):
        return None
    with np.errstate(over="ignore"):
        a = np.bitwise_xor.reduce(shingles * np.uint64(0xD6E8FEB86659FD93))
        b = np.add.reduce((shingles ^ (shingles >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F))
    return a.tobytes() + b.tobytes()


def signatures(sets: list[np.ndarray], p: ForestParams) -> list[bytes | None]:
    """Minima of ``hashes`` hash functions over each set, 32 bits each."""
    draw = np.random.default_rng(p.seed)
    factor = draw.integers(0, 2**64, p.hashes, np.uint64) | np.uint64(1)
    shift = draw.integers(0, 2**64, p.hashes, np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    out: list[bytes | None] = [None] * len(sets)
    if not full:
        return out
    values = np.concatenate([sets[i] for i in full])
    starts = np.cumsum([0, *[len(sets[i]) for i in full[:-1]]])
    lowest = np.empty((len(full), p.hashes), "<u4")
    for k in range(p.hashes):
        lowest[:, k] = np.minimum.reduceat(values * factor[k] + shift[k], starts) >> np.uint64(32)
    for i, row in zip(full, lowest):
        out[i] = row.tobytes()
    return out


def sign(docs: DataFrame, p: ForestParams) -> DataFrame:
    """doc_id, text_key, n_shingles, node (fingerprint of the set) and signature; the last two null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                sets = shingle_sets(part, p.shingle)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(part.first, part.rows), batch.column("text_key").slice(part.first, part.rows),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array(signatures(sets, p), pa.binary())],
                    names=["doc_id", "text_key", "n_shingles", "node", "signature"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_key().alias("text_key"), "text").mapInArrow(
        run, "doc_id bigint, text_key bigint, n_shingles bigint, node binary, signature binary")


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _prefixes(nodes: DataFrame, p: ForestParams) -> DataFrame:
    """node, region (tree and least prefix) and the hashes below it, for every tree."""
    below = p.depth - p.least_depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from riskloom.llm.textops import mix

        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sig = np.frombuffer(b"".join(part.column("signature").to_pylist()), "<u4").reshape(-1, p.trees, p.depth)
                region = np.tile(np.arange(1, p.trees + 1, dtype=np.uint64), (len(sig), 1))
                for d in range(p.least_depth):
                    region = mix(region * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, d])
                rest = sig[:, :, p.least_depth:].astype(np.int64).reshape(-1)
                n = len(sig) * p.trees
                yield pa.RecordBatch.from_arrays(
                    [part.column("node").take(pa.array(np.repeat(np.arange(len(sig)), p.trees))),
                     pa.array(region.reshape(-1).view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, n * below + 1, below, dtype=np.int32)),
                                              pa.array(rest.astype(np.uint32).view(np.int32)))],
                    names=["node", "region", "rest"])

    return nodes.select("node", "signature").mapInArrow(run, "node binary, region bigint, rest array<int>")


def regions(nodes: DataFrame, p: ForestParams) -> tuple[DataFrame, DataFrame]:
    """(region, chunk, chunks, node): the nodes that are candidates for each other; and (region, node) at the least depth.

    Depth is adaptive: a prefix with more than ``region`` nodes is cut at the next ``step`` hashes. One node of each part stays in
    a region of the undivided prefix, so neighbours across a cut still meet. At full depth, or where a prefix has that
    many parts, a crowd is dealt into chunks of about ``region`` nodes that all hold the crowd's least node. A pair that a
    cut or a chunk separates is still one of the undivided region.
    """
    rows = _prefixes(nodes, p)
    shared = rows.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("region")
    open_ = rows.join(own_exchange(shared, "region"), "region", "left_semi")
    done, whole = [], None
    for d in range(0, p.depth - p.least_depth + 1, p.step):
        # The crowd's table is read by its count, its parts and the next depth.
        open_ = stage(open_, "prefixes")
        counts = open_.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"))
        counted = stage(open_.join(own_exchange(counts, "region"), "region").where("n > 1"), "regions")
        whole = counted.select("region", "node") if whole is None else whole
        last = d + p.step > p.depth - p.least_depth
        done.append(counted.where(F.lit(last) | (F.col("n") <= p.region)).select("region", "node", "n", "least"))
        crowd = counted.where(F.col("n") > p.region)
        if last or not crowd.take(1):
            break
        deeper = crowd.select("node", "rest", F.col("region").alias("above"), F.xxhash64(
            "region", *[F.get("rest", F.lit(d + k)) for k in range(p.step)]).alias("region"))
        spine = deeper.groupBy("above", "region").agg(F.min("node").alias("node")).select(
            F.xxhash64("above", F.lit("spine")).alias("region"), "node")
        sizes = spine.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least"))
        done.append(spine.join(own_exchange(sizes, "region"), "region").where("n > 1").select("region", "node", "n", "least"))
        open_ = deeper.drop("above")
    every = done[0]
    for more in done[1:]:
        every = every.unionByName(more)
    chunks = F.ceil(F.col("n") / p.region).cast("int")
    dealt = every.select("region", "node", chunks.alias("chunks"), F.when(
        F.col("node") == F.col("least"), F.sequence(F.lit(0), chunks - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("node"), chunks).cast("int"))).alias("chunk"))
    return stage(dealt.select("region", "chunks", "node", F.explode("chunk").alias("chunk")), "chunks"), whole


def _estimates(sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.empty(len(i))
    for at in range(0, len(i), 20_000):
        s = slice(at, at + 20_000)
        out[s] = (sketch[i[s]] == sketch[j[s]]).mean(axis=1)
    return out


def _forest(i: np.ndarray, j: np.ndarray, score: np.ndarray) -> list[int]:
    """Positions of a spanning forest's pairs, best first."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    kept = []
    for k in np.lexsort((j, i, -score)):
        a, b = root(int(i[k])), root(int(j[k]))
        if a != b:
            up[max(a, b)] = min(a, b)
            kept.append(int(k))
    return kept


def _forest_pairs(rows: DataFrame, p: ForestParams) -> DataFrame:
    """Pairs (a < b) that span each group (region, chunk), best estimates first, none far below the threshold.

    ``rows`` has region, chunk, node and sketch; a group holds about ``region`` nodes.
    """
    least = p.percent / 100 - p.slack

    def pairs(keys: list, nodes: list, sketch: np.ndarray) -> Iterator[tuple]:
        bounds = [0, *[k for k in range(1, len(keys)) if keys[k] != keys[k - 1]], len(keys)]
        pair_i, pair_j = [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a == 2:
                pair_i.append(np.array([a]))
                pair_j.append(np.array([a + 1]))
            elif b - a > 2:
                for i in range(a, b - 1):
                    pair_i.append(np.full(b - i - 1, i))
                    pair_j.append(np.arange(i + 1, b))
        if not pair_i:
            return
        i, j = np.concatenate(pair_i), np.concatenate(pair_j)
        score = _estimates(sketch, i, j)
        near = score >= least
        i, j, score = i[near], j[near], score[near]
        group = np.searchsorted(bounds, i, "right")
        keep, cuts = [], np.searchsorted(group, np.arange(1, len(bounds) + 1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            keep += [a] if b - a == 1 else [a + k for k in _forest(i[a:b], j[a:b], score[a:b])] if b > a else []
        i, j = i[keep], j[keep]
        for x, y in zip(i.tolist(), j.tolist()):
            if nodes[x] != nodes[y]:
                yield min(nodes[x], nodes[y]), max(nodes[x], nodes[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            sketch = np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), -1)
            found = list(pairs([r[0] for r in rows], [r[1] for r in rows], sketch)) if rows else []
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()),
                                               pa.array([f[1] for f in found], pa.binary())], names=["a", "b"])

        for batch in batches:
            held += zip(zip(batch.column("region").to_pylist(), batch.column("chunk").to_pylist()),
                        batch.column("node").to_pylist(), batch.column("sketch").to_pylist())
            if len(held) < 4000:
                continue
            cut = len(held)
            while cut and held[cut - 1][0] == held[-1][0]:
                cut -= 1
            if cut:
                yield flush(held[:cut])
                held = held[cut:]
        yield flush(held)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (rows.select("region", "chunk", "node", "sketch").repartition(parts, "region", "chunk")
            .sortWithinPartitions("region", "chunk", "node").mapInArrow(run, "a binary, b binary").distinct())


def _blocks(placed: DataFrame, p: ForestParams) -> DataFrame:
    """The regions whose nodes are in several components, as blocks in which every pair between components meets.

    ``placed`` has region, node, comp. Of two components at least one is not the region's main one, so each block sets
    some of all nodes (side 0) against some of those outside the main component (side 1), about ``block`` of each.
    """
    members = placed.select("region", "node", "comp").distinct()
    shares = members.groupBy("region", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = shares.groupBy("region").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"),
                                        F.max("n").alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
    rows = members.join(own_exchange(main, "region"), "region").withColumn("outside", F.col("comp") != F.col("main"))
    here, there = F.ceil(F.col("n") / p.block).cast("int"), F.ceil((F.col("n") - F.col("most")) / p.block).cast("int")
    own = F.xxhash64("node")
    sides = F.concat(
        F.transform(F.sequence(F.lit(0), there - 1), lambda j: F.struct(
            F.pmod(own, here).cast("int").alias("i"), j.alias("j"), F.lit(0).alias("side"))),
        F.when(F.col("outside"), F.transform(F.sequence(F.lit(0), here - 1), lambda i: F.struct(
            i.alias("i"), F.pmod(own, there).cast("int").alias("j"), F.lit(1).alias("side")))).otherwise(
            F.array().cast("array<struct<i:int,j:int,side:int>>")))
    return rows.select("region", "node", "comp", "outside", F.explode(sides).alias("at")).select(
        "region", "at.i", "at.j", "at.side", "node", "comp", "outside")


def _near(rows: list[dict], p: ForestParams) -> tuple[np.ndarray, np.ndarray]:
    """Places of side 0 and side 1 rows of one block in different components that may reach the threshold, best first."""
    a = [k for k, r in enumerate(rows) if r["side"] == 0]
    b = [k for k, r in enumerate(rows) if r["side"] == 1]
    none = np.zeros(0, np.int32)
    if not a or not b:
        return none, none
    sketch = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), -1)
    comp = np.unique([r["comp"] for r in rows], return_inverse=True)[1]
    outside = np.array([r["outside"] for r in rows])
    node = np.unique([r["node"] for r in rows], return_inverse=True)[1]
    left, found, scores, right = [], [], [], np.array(b)
    for i in a:
        j = right[(comp[right] != comp[i]) & (~outside[i] | (node[right] > node[i]))]
        if len(j):
            score = (sketch[j] == sketch[i]).mean(axis=1)
            close = score >= p.percent / 100 - p.slack
            if close.any():
                found.append(j[close].astype(np.int32))
                left.append(np.full(len(found[-1]), i, np.int32))
                scores.append(score[close].astype(np.float32))
    if not found:
        return none, none
    i, j = np.concatenate(left), np.concatenate(found)
    order = np.lexsort((j, i, -np.concatenate(scores)))
    return i[order], j[order]


_BLOCK = "region bigint, i int, j int, side int, node binary, comp binary, outside boolean, sketch binary"


def _block_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one block after another; the rows come sorted by block."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["region"], row["i"], row["j"])
            if own != key and held:
                yield held
                held = []
            key = own
            held.append(row)
    if held:
        yield held


def _dealt(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "region", "i", "j").sortWithinPartitions("region", "i", "j", "side", "node")


def _block_candidates(rows: DataFrame, p: ForestParams) -> DataFrame:
    """The rows of the blocks that have a near partner there; pairs stay inside the task."""
    names = [x.split()[0] for x in _BLOCK.split(", ")]

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _block_groups(batches):
            used = np.unique(np.concatenate(_near(group, p))).tolist()
            if used:
                yield pa.RecordBatch.from_pydict({c: [group[k][c] for k in used] for c in names}, schema=_block_schema())

    return _dealt(rows.select(*names)).mapInArrow(select, _BLOCK)


def _block_schema() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in _BLOCK.split(", "))])


def _block_links(rows: DataFrame, p: ForestParams) -> DataFrame:
    """Confirmed pairs of the blocks' candidates (with their text) that join components not yet joined in the block."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _block_groups(batches):
            sets = [s for part in slices(pa.array([r["text"] for r in group], pa.string())) for s in shingle_sets(part, p.shingle)]
            up: dict[bytes, bytes] = {}

            def root(x: bytes) -> bytes:
                while x in up:
                    x = up[x]
                return x

            found = []
            for i, j in zip(*_near(group, p)):
                a, b = root(group[i]["comp"]), root(group[j]["comp"])
                if a != b:
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * common >= p.percent * (len(sets[i]) + len(sets[j]) - common):
                        up[max(a, b)] = min(a, b)
                        found.append((group[i]["node"], group[j]["node"]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()),
                                                  pa.array([y for _, y in found], pa.binary())], names=["a", "b"])

    return _dealt(rows).mapInArrow(links, "a binary, b binary")


def _texts(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, p: ForestParams) -> DataFrame:
    """(node, text) of the wanted nodes; where an id comes with several texts, the one whose set is the node's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                rows = batch.slice(part.first, part.rows)
                own = [fingerprint(s) for s in shingle_sets(part, p.shingle)]
                keep = [k for k, x in enumerate(rows.column("node").to_pylist()) if own[k] == x]
                yield rows.select(["node", "text"]).take(pa.array(keep, pa.int64()))

    ids = nodes.select("node", "doc_id").join(wanted, "node")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(ids, "doc_id").select("node", "text")
    return stage(rows.mapInArrow(run, "node binary, text string").groupBy("node").agg(F.first("text").alias("text")), "texts")


def confirm(pairs: DataFrame, texts: DataFrame, p: ForestParams) -> DataFrame:
    """The pairs whose whole sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            found = []
            for part in slices(batch.column("text")):
                rows = batch.slice(part.first, part.rows)
                keys = zip(rows.column("a").to_pylist(), rows.column("b").to_pylist())
                for key, own in zip(keys, shingle_sets(part, p.shingle)):
                    if held is not None and held[0] == key:
                        both = np.sort(np.concatenate([held[1], own]))
                        common = int((both[1:] == both[:-1]).sum())
                        if 100 * common >= p.percent * (len(both) - common):
                            found.append(key)
                        held = None
                    else:
                        held = (key, own)
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()),
                                              pa.array([f[1] for f in found], pa.binary())], names=["a", "b"])

    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("node")).join(texts, "node")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ends.select("a", "b", "text").repartition(parts, "a", "b").sortWithinPartitions("a", "b").mapInArrow(
        run, "a binary, b binary")


def near_duplicates(docs: DataFrame, p: ForestParams = ForestParams()) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) and kept (doc_id = component_id) per row.

    A set is the distinct shingles of ``shingle`` words; a text of fewer words is one shingle. Null texts and texts
    without words have the empty set, are linked with nothing and are kept. Equal sets are one node, so repeated rows
    and copies cost one row each. Rows without an id belong to the component of their set and are never kept; the
    component of a set that only such rows have is null. Links are exact; a pair is missed only where no tree brings it
    into one region (below 1 in 1000 at the threshold, less above it).
    """
    signed = stage(sign(docs, p), "signed")
    nodes = stage(signed.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")), "nodes")
    dealt, whole = regions(nodes, p)
    sketches = _sketches(nodes.join(whole.select("node").distinct(), "node", "left_semi"))
    first = stage(_forest_pairs(dealt.join(sketches, "node"), p), "pairs")
    texts = _texts(docs, nodes, first.select(F.explode(F.array("a", "b")).alias("node")).distinct(), p)
    links = stage(confirm(first, texts, p), "confirmed")
    found = connected_components(links)

    placed = stage(whole.join(found.select(F.col("id").alias("node"), "component"), "node", "left").select(
        "region", "node", F.coalesce("component", "node").alias("comp")), "placed")
    second = stage(_block_candidates(_blocks(placed, p).join(sketches, "node"), p), "blocks")
    if second.take(1):
        missing = second.select("node").distinct().join(texts.select("node"), "node", "left_anti")
        texts = texts.unionByName(_texts(docs, nodes, missing, p))
        more = stage(_block_links(second.join(texts, "node"), p), "confirmed")
        found = connected_components(links.unionByName(more))

    roots = nodes.select("node", "doc_id").join(found.withColumnRenamed("id", "node"), "node", "left").select(
        "node", "doc_id", F.coalesce("component", "node").alias("root"))
    least = own_exchange(roots.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root")
    named = roots.join(least, "root").select("node", "root", "component_id")
    columns = ["doc_id", "n_shingles", "component_id", "text_key", "root"]
    linked = signed.where(F.col("node").isNotNull()).join(named, "node", "left").withColumn(
        "root", F.coalesce("root", "node")).select(columns)
    empty = signed.where(F.col("node").isNull()).select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_key", F.lit(None).cast("binary").alias("root"))
    return linked.unionByName(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame, p: ForestParams = ForestParams()) -> DataFrame:
    """One document of each component, with its own columns: the least id, then the least text hash.

    Texts without words are linked with nothing and stay, all of them. A document without an id stays only where no
    document with an id is in its component. Of rows equal in id and text one stays.
    """
    docs, own = set_aside(docs, ["_key", "_copies", "_doc_id", "_text_key"])
    found = stage(near_duplicates(docs, p), "components")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    chosen = found.where(F.col("root").isNotNull()).groupBy("root").agg(F.min(rank).alias("k")).select("k.doc_id", "k.text_key")
    again = found.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("_copies"))
    same = (F.col("doc_id").eqNullSafe(F.col("_doc_id"))) & (F.col("text_key") == F.col("_text_key"))
    rename = lambda df: df.withColumnsRenamed({"doc_id": "_doc_id", "text_key": "_text_key"})
    keepers = stage(chosen.join(rename(again), same).select("_doc_id", "_text_key", "_copies"), "keepers")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(worded).withColumn("_key", _text_key()).join(
        keepers, F.col("doc_id").cast("bigint").eqNullSafe(F.col("_doc_id")) & (F.col("_key") == F.col("_text_key")))
    once = rows.where("_copies = 1").select(docs.columns)
    several = rows.where("_copies > 1").dropDuplicates(["_doc_id", "_key"]).select(docs.columns)
    return once.unionByName(several).unionByName(docs.where(~worded)).select(own)


def _sketches(nodes: DataFrame) -> DataFrame:
    """The low byte of each of a node's minima; equal bytes of unequal minima add 1/256 to an estimate at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [x[::4] for x in batch.column("signature").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(low, pa.binary())], names=["node", "sketch"])

    return nodes.select("node", "signature").mapInArrow(run, "node binary, sketch binary")
