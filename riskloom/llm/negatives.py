"""Hard negatives by threshold joins with an inverted index cut short by norms.

A threshold join finds all pairs of an anchor and a row whose inner product reaches the anchor's threshold. Inside a block,
dimensions are taken in bands, those in which the anchors are largest first. A row is indexed only for as many leading bands
as its norm beyond them could still carry a pair over a threshold: what is left of it is covered by the product of norms.
The index accumulates partial products; a pair is dropped when its partial product and the norms of what remains
of both vectors stay below the threshold, and the pairs left are completed band by band under the same bound.

Anchors want their best rows in windows of scores. Thresholds start high, each round joins the anchors whose windows are
not full with a lower one, and the last threshold is the window's own lower end. So the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.llm.staging import stage


@dataclass(frozen=True)
class MiningParams:
    """Shares are thresholds relative to a window's upper end, round by round; after them comes the window's lower end."""

    scale: int = 256
    positives: int = 5
    negatives: int = 3
    low_percent: int = 50
    high_percent: int = 95
    positive_shares: tuple[float, ...] = (0.6, 0.3, 0.1)
    negative_shares: tuple[float, ...] = (0.85, 0.7)
    band: int = 8
    anchor_block: int = 2048
    row_block: int = 8192


#: Sums below this are exact in doubles.
EXACT = 2.0 ** 53


def usable_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and v (components times ``scale``, rounded down) of the rows that take part.

    Those with a null id, label, vector or component, or a component that is not finite, take none. Of rows with one
    id, the least (label, vector) does.
    """
    x = lambda c: c.cast("double")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    whole = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    scaled = F.transform("embedding", lambda c: F.floor(x(c) * scale))
    once = whole.groupBy(F.col("vec_id").cast("bigint").alias("vec_id")).agg(
        F.min(F.struct(F.col("label").cast("bigint").alias("label"), scaled.alias("v"))).alias("r"))
    return once.select("vec_id", "r.label", "r.v")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of doubles, or of Python integers where doubles may not be exact; short ones end in zeros."""
    offsets = np.asarray(column.offsets)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = values
    return out


def _joint(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both matrices of one width, and of a kind in which their products are exact."""
    width = max(a.shape[1], x.shape[1])
    a, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, x))
    largest = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(x.astype(float)).max(initial=0)) * max(width, 1)
    kind = np.float64 if largest < EXACT else object
    return a.astype(kind), x.astype(kind)


def _suffix_norms(m: np.ndarray, band: int) -> np.ndarray:
    """Norms of what each row has from every band on; the last column is 0."""
    squares = m.astype(float) ** 2
    per_band = np.add.reduceat(squares, np.arange(0, m.shape[1], band), axis=1) if m.shape[1] else np.zeros((len(m), 0))
    tail = np.cumsum(per_band[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.hstack([tail, np.zeros((len(m), 1))]))


def threshold_join(a: np.ndarray, x: np.ndarray, t: np.ndarray, allowed: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, product) of all allowed pairs whose product reaches the anchor's threshold."""
    a, x = _joint(a, x)
    order = np.argsort(-(a.astype(float) ** 2).sum(axis=0), kind="stable")
    a, x = a[:, order], x[:, order]
    rest_a, rest_x = _suffix_norms(a, band), _suffix_norms(x, band)
    bands = rest_a.shape[1] - 1
    slack = 1e-9 * (1 + np.abs(t) + rest_a[:, 0] * float(rest_x[:, 0].max(initial=0)))
    floor = t - slack
    norm = rest_a[:, 0]
    # Below this length of its rest no row reaches any anchor's threshold by the rest alone.
    least = np.where(norm > 0, floor / np.where(norm > 0, norm, 1), np.where(floor > 0, np.inf, -np.inf)).min(initial=np.inf)
    indexed = (rest_x[:, :bands] >= least).sum(axis=1) if bands else np.full(len(x), 0 if least > 0 else 1)
    rows = np.argsort(-indexed, kind="stable")
    rows = rows[indexed[rows] > 0]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def complete(i: np.ndarray, j: np.ndarray, partial: np.ndarray, b: int) -> None:
        for k in range(b, bands):
            near = (partial + rest_a[i, k] * rest_x[j, k]).astype(float) >= floor[i]
            i, j, partial = i[near], j[near], partial[near]
            if not len(i):
                return
            part = slice(k * band, (k + 1) * band)
            partial = partial + (a[i, part] * x[j, part]).sum(axis=1)
        reach = partial >= t[i]
        found.append((i[reach], j[reach], partial[reach]))

    sums = np.zeros((len(a), len(rows)), a.dtype)
    open_ = allowed[:, rows]
    for b in range(bands + 1):
        ends = indexed[rows] <= b
        left = open_.sum()
        if b and b < bands and left * 8 < open_.size:
            ends[:] = True  # few pairs are left: they are completed one by one
        if b == bands:
            ends[:] = True
        if ends.any():
            i, j = np.nonzero(open_[:, ends])
            complete(i, rows[ends][j], sums[:, ends][i, j], b)
            rows, sums, open_ = rows[~ends], sums[:, ~ends], open_[:, ~ends]
        if not len(rows):
            break
        part = slice(b * band, (b + 1) * band)
        sums += a[:, part] @ x[rows, part].T
        open_ &= (sums + rest_a[:, b + 1:b + 2] * rest_x[rows, b + 1]).astype(float) >= floor[:, None]
        some = open_.any(axis=0)
        if some.mean() < 0.5:
            rows, sums, open_ = rows[some], sums[:, some], open_[:, some]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    i, j, s = (np.concatenate(parts) for parts in zip(*found))
    return i, j, np.array([int(v) for v in s], np.int64) if s.dtype == object else s.astype(np.int64)


class Block:
    """The anchors of one block with their open windows, and the best rows seen for each."""

    def __init__(self, batch: pa.Table, same: bool, k: int, band: int):
        self.ids = batch.column("id").to_numpy()
        self.labels = batch.column("label").to_numpy()
        self.v = _matrix(batch.column("v").combine_chunks(), 0)
        self.same, self.k, self.band = same, k, band
        wants = batch.column("wants").to_pylist()
        self.counts = np.array([len(w) for w in wants])
        flat = [x for w in wants for x in w]
        self.want = np.array([x["want"] for x in flat], np.int64)
        self.low = np.array([x["t"] for x in flat], np.int64)
        self.high = np.array([x["hi"] for x in flat], np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.t = np.minimum.reduceat(self.low, self.first)
        self.best = tuple(np.zeros(0, np.int64) for _ in range(3))  # window, score, row id

    def add(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray) -> None:
        allowed = ((self.labels[:, None] == labels) == self.same) & (self.ids[:, None] != ids)
        i, j, score = threshold_join(self.v, v, self.t, allowed, self.band)
        n = self.counts[i]
        pair = np.repeat(np.arange(len(i)), n)
        window = self.first[i][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        inside = (score[pair] >= self.low[window]) & (score[pair] <= self.high[window])
        pair, window = pair[inside], window[inside]
        window, score, row = (np.concatenate(x) for x in zip(self.best, (window, score[pair], ids[j][pair])))
        order = np.lexsort((row, -score, window))
        window, score, row = window[order], score[order], row[order]
        place = np.arange(len(window)) - np.searchsorted(window, window)
        self.best = tuple(x[place < self.k] for x in (window, score, row))

    def rows(self) -> pa.RecordBatch:
        window, score, row = self.best
        anchor = np.repeat(self.ids, self.counts)[window]
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(self.want[window]), pa.array(row), pa.array(score)],
                                          names=["anchor_id", "want", "vec_id", "score"])


def _join_blocks(anchors: DataFrame, rows: DataFrame, same: bool, k: int, sizes: tuple[int, int], p: MiningParams) -> DataFrame:
    """The best ``k`` rows per window and block of rows: anchor_id, want, vec_id, score.

    ``anchors`` has anchor_id, label, v, wants (want, t, lo, hi). Every block of anchors meets every block of rows in a group
    of its own; a task holds one block of anchors and one batch of rows, and at most ``k`` rows of a window leave it.
    """
    a_blocks, r_blocks = (max(1, -(-n // size)) for n, size in zip(sizes, (p.anchor_block, p.row_block)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    wants = "array<struct<want:bigint,t:bigint,lo:bigint,hi:bigint>>"
    left = anchors.select(numbers(r_blocks).alias("i"), own("anchor_id", a_blocks).alias("j"), F.lit(0).alias("side"),
                          F.col("anchor_id").alias("id"), "label", "v", F.col("wants").cast(wants).alias("wants"))
    right = rows.select(own("vec_id", r_blocks).alias("i"), numbers(a_blocks).alias("j"), F.lit(1).alias("side"),
                        F.col("vec_id").alias("id"), "label", "v", F.lit(None).cast(wants).alias("wants"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("i", "j", "side")], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                i, j, side = marks[a].tolist()
                if (i, j) != key:
                    if block is not None:
                        yield block.rows()
                    key, held, block = (i, j), [], None
                if side == 0:
                    held.append(part)
                elif held:
                    if block is None:
                        block = Block(pa.Table.from_batches(held), same, k, p.band)
                    block.add(part.column("id").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("v"), 0))
        if block is not None:
            yield block.rows()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.unionByName(right).repartition(parts, "i", "j").sortWithinPartitions("i", "j", "side").mapInArrow(
        run, "anchor_id bigint, want bigint, vec_id bigint, score bigint")


def fill_windows(anchors: DataFrame, wants: DataFrame, rows: DataFrame, same: bool, k: int, shares: Sequence[float],
                 n_rows: int, p: MiningParams) -> DataFrame:
    """anchor_id, want, rank (from 1), vec_id, score: the best ``k`` rows with scores from lo to hi for each wanted window.

    ``wants`` has anchor_id, want, lo, hi. Rows have the anchor's label (``same``) or another one, and never its id. Higher
    scores come first, equal ones by smaller id. A window is full with ``k`` rows, or when the threshold is its lo.
    """
    done: list[DataFrame] = []
    per_window = W.partitionBy("anchor_id", "want").orderBy(F.col("score").desc(), "vec_id")
    for share in (*shares, None):
        t = F.col("lo") if share is None else F.greatest("lo", F.floor(F.col("hi") * F.lit(share)).cast("bigint"))
        current = stage(wants.withColumn("t", t), "windows")
        listed = current.groupBy("anchor_id").agg(F.collect_list(F.struct("want", "t", "lo", "hi")).alias("wants"))
        n = listed.count()
        if not n:
            break
        found = _join_blocks(anchors.join(listed, "anchor_id"), rows, same, k, (n, n_rows), p)
        ranked = stage(found.withColumn("rank", F.row_number().over(per_window)).where(F.col("rank") <= k), "found")
        full = ranked.where(F.col("rank") == k).select("anchor_id", "want")
        closed = current.where("t <= lo").select("anchor_id", "want").unionByName(full).distinct()
        done.append(ranked.join(closed, ["anchor_id", "want"], "left_semi"))
        wants = current.drop("t").join(closed, ["anchor_id", "want"], "left_anti")
    out = done[0] if done else None
    for more in done[1:]:
        out = out.unionByName(more)
    columns = "anchor_id bigint, want bigint, rank int, vec_id bigint, score bigint"
    return out.select("anchor_id", "want", "rank", "vec_id", "score") if done else anchors.sparkSession.createDataFrame([], columns)


def hard_negatives(vectors: DataFrame, is_anchor: Column, p: MiningParams = MiningParams()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors`` has vec_id, embedding and label; other columns are not read. The score of two rows is the inner product of
    their scaled components, as whole numbers; missing components of a shorter vector count as 0, and a score beyond 64
    bits is an error. For the anchors, rows for which ``is_anchor`` holds, the first ``positives`` rows of their
    label are taken, and for each of these the first ``negatives`` rows of other labels whose score is between
    ``low_percent`` and ``high_percent`` of the positive's. Higher scores come first, then smaller ids; fewer rows give
    fewer results, an empty table none.
    """
    rows = stage(usable_vectors(vectors.select("vec_id", "embedding", "label"), p.scale), "vectors")
    anchors = stage(rows.where(is_anchor).withColumnRenamed("vec_id", "anchor_id"), "anchors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")))
    most = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("norm")).head()
    if not most["n"]:
        return anchors.select(*[F.lit(None).cast(t).alias(c) for c, t in (
            ("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"),
            ("positive_score", "bigint"), ("negative_score", "bigint"))])
    top = F.ceil(norm * F.lit(float(most["norm"]) * (1 + 1e-9))).cast("bigint") + 1  # no product is beyond those of norms
    every = anchors.select("anchor_id", F.col("anchor_id").alias("want"), (-top).alias("lo"), top.alias("hi"))
    positives = stage(fill_windows(anchors, every, rows, True, p.positives, p.positive_shares, most["n"], p).select(
        "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    low, high = (F.col("positive_score") * n for n in (p.low_percent, p.high_percent))
    hundred = F.lit(100).cast("bigint")
    windows = positives.select(
        "anchor_id", F.col("positive_id").alias("want"),
        F.call_function("div", low + F.pmod(-low, hundred), hundred).alias("lo"),
        F.call_function("div", high - F.pmod(high, hundred), hundred).alias("hi")).where("lo <= hi")
    found = fill_windows(anchors, windows, rows, False, p.negatives, p.negative_shares, most["n"], p)
    named = found.select("anchor_id", F.col("want").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
                         F.col("score").alias("negative_score"))
    return named.join(positives, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
