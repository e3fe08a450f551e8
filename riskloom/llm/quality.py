"""Document quality: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.staging import stage
from riskloom.llm.textops import Slice, ngrams, run_hashes, runs, slices


def _kinds() -> np.ndarray:
    """Bytes by kind: white space 0, letters (and all beyond ASCII) 1, digits 2, marks 3."""
    table = np.full(256, 3, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[128:] = 1
    table[65:91] = table[97:123] = 1
    table[48:58] = 2
    return table


KINDS = _kinds()
#: Stands for a word that repeats the one before it, whichever word that is.
REPEAT = np.uint64(0x5DEECE66D1234567)


@dataclass
class FtrlParams:
    """``max_train`` labelled rows and ``max_train_chars`` characters are expected in the sample; scoring covers every row."""

    bits: int = 18
    orders: tuple[int, ...] = (1, 2)
    scale: float = 12.0
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.5
    epochs: int = 3
    max_train: int = 6000
    max_train_chars: int = 24_000_000
    seed: int = 7


@dataclass
class QualityModel:
    bias: float
    weights: np.ndarray
    params: FtrlParams = field(default_factory=FtrlParams)

    def score(self, part: Slice) -> np.ndarray:
        """Probability of label 1 per row; a row without words gets the bias alone."""
        total = np.zeros(part.rows)
        count = np.zeros(part.rows)
        for index, row in hashed_grams(part, self.params):
            total += np.bincount(row, self.weights[index], part.rows)
            count += np.bincount(row, minlength=part.rows)
        return 1 / (1 + np.exp(-(self.bias + self.params.scale * total / np.sqrt(np.maximum(count, 1)) / 4)))


def hashed_grams(part: Slice, p: FtrlParams) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(slot, row) of every word n-gram of the slice, order by order."""
    words = runs(part, KINDS[part.data])
    hashes = run_hashes(part.data, words)
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (words.row[1:] == words.row[:-1])) + 1
    hashes[again] = REPEAT
    for n in p.orders:
        grams, row = (hashes, words.row) if n == 1 else ngrams(hashes, words, n)
        yield (grams >> np.uint64(64 - p.bits)).astype(np.int64), row


def sparse_rows(part: Slice, p: FtrlParams) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, counts) of the n-grams of every row of a slice, 32 bits each."""
    grams = list(hashed_grams(part, p))
    index = np.concatenate([g for g, _ in grams])
    row = np.concatenate([r for _, r in grams])
    keys, counts = np.unique(row * (1 << p.bits) + index, return_counts=True)
    bounds = np.searchsorted(keys, np.arange(part.rows + 1) << p.bits)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        out.append(((keys[a:b] & ((1 << p.bits) - 1)).astype(np.int32), counts[a:b].astype(np.int32)))
    return out


def values(counts: np.ndarray, p: FtrlParams) -> np.ndarray:
    """What ``QualityModel.score`` multiplies the weights by."""
    return p.scale / 4 * counts / np.sqrt(max(counts.sum(), 1))


def examples(texts: list[str | None], p: FtrlParams) -> list[tuple[np.ndarray, np.ndarray]]:
    """(slots, values) of each text."""
    return [(slot, values(c, p)) for slot, c in _sparse_texts(texts, p)]


def _sparse_texts(texts: list[str | None], p: FtrlParams) -> list[tuple[np.ndarray, np.ndarray]]:
    return [row for part in slices(pa.array(texts, pa.string())) for row in sparse_rows(part, p)] if texts else []


def fit(texts: list[str | None], labels: list[int], p: FtrlParams | None = None) -> QualityModel:
    """The model of a few texts; ``train_quality`` fits one of tables."""
    p = p or FtrlParams()
    return fit_sparse(_sparse_texts(texts, p), labels, p)


def fit_sparse(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], p: FtrlParams) -> QualityModel:
    """Per-coordinate FTRL-proximal over sparse rows (slots, counts) in a seeded order. No rows: every score is 0.5."""
    size = 1 << p.bits
    z, n = np.zeros(size), np.zeros(size)
    zb = nb = 0.0
    order = np.random.default_rng(p.seed)

    def weights(zi, ni):
        return np.where(np.abs(zi) <= p.l1, 0.0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(ni)) / p.alpha + p.l2))

    def bias():
        return -zb / ((p.beta + np.sqrt(nb)) / p.alpha)

    for _ in range(p.epochs):
        for i in order.permutation(len(rows)):
            slot, value = rows[i][0], values(rows[i][1], p)
            w = weights(z[slot], n[slot])
            g = 1 / (1 + np.exp(-(bias() + w @ value))) - labels[i]
            step = g * value
            sigma = (np.sqrt(n[slot] + step * step) - np.sqrt(n[slot])) / p.alpha
            z[slot] += step - sigma * w
            n[slot] += step * step
            b = bias()
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / p.alpha * b
            nb += g * g
    return QualityModel(float(bias()), weights(z, n), p)


def _sparse(sample: DataFrame, p: FtrlParams) -> DataFrame:
    """doc_id, label, and slots and counts of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                rows, own = sparse_rows(part, p), batch.slice(part.first, part.rows)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("label"), pa.array([s.tobytes() for s, _ in rows], pa.binary()),
                     pa.array([c.tobytes() for _, c in rows], pa.binary())], names=["doc_id", "label", "slots", "counts"])

    return sample.select(F.col("doc_id").cast("string").alias("doc_id"), "label", "text").mapInArrow(
        run, "doc_id string, label int, slots binary, counts binary")


def train_quality(docs: DataFrame, labels: DataFrame, train_on: Column, label_col: str = "quality",
                  p: FtrlParams | None = None) -> QualityModel:
    """Fits on labelled rows for which ``train_on`` (over the labels) holds.

    A share of them is drawn by a hash of the id, whatever the length of their texts, such that ``max_train`` rows are
    expected; where these have more than ``max_train_chars`` in all, a share of them is drawn by a second hash. Texts are
    hashed where they lie; the driver receives sparse rows, partition by partition. Null or missing labels and ids are left
    out; of repeated ids, which row is used is fixed by the text. Only id, text and label are read.
    """
    p = p or FtrlParams()
    usable = (labels.where(train_on & F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
              .groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label")))
    draw = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    wanted = usable.where(draw(p.seed) < min(1.0, p.max_train / max(usable.count(), 1)))
    sample = stage(docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")  # about max_train ids
                   .groupBy("doc_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label")), "sample")
    chars = sample.agg(F.sum(F.length("text"))).head()[0] or 0
    drawn = sample.where(draw(p.seed + 1) < min(1.0, p.max_train_chars / max(chars, 1)))
    rows = sorted(_sparse(drawn, p).toLocalIterator(), key=lambda r: r.doc_id)
    sparse = [(np.frombuffer(r.slots, np.int32), np.frombuffer(r.counts, np.int32)) for r in rows]
    return fit_sparse(sparse, [r.label for r in rows], p)


def score_quality(docs: DataFrame, model: QualityModel, threshold: float, score_col: str = "score",
                  predicted_col: str = "predicted") -> DataFrame:
    """Adds the score (0 to 1) of every whole text and 1 where it reaches ``threshold``.

    Scores are sparse dot products over hashed n-grams, row by row; nothing is shuffled. Null and empty texts
    score as texts without words. Existing columns of the two names are replaced; all others stay.
    """
    kept = [c for c in docs.columns if c not in (score_col, predicted_col)]
    schema = T.StructType([docs.schema[c] for c in kept] + [
        T.StructField(score_col, T.DoubleType(), False), T.StructField(predicted_col, T.IntegerType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB: 2**bits weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            parts = [model.score(part) for part in slices(batch.column("text"))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                names=[*kept, score_col, predicted_col])

    return docs.select(*kept).mapInArrow(run, schema)
