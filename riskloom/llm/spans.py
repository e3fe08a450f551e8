"""Substring deduplication by sliding sentence spans.

A text is cut into sentences, and these again after words whose hash is the least of a window of words, so that the
cuts follow the words and not their place. Every run of several consecutive pieces is hashed, runs are joined globally,
and the pieces that any repeated run covers are removed everywhere but where the run comes first.

Two copies agree on a cut that is ``window`` words inside the passage, and no piece is longer than ``window``. So a passage
of 6 * window - 2 words (46) holds a common run whatever stands around it and however it is punctuated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.staging import stage
from riskloom.llm.textops import Slice, kind_table, lower_ascii, mix, run_hashes, runs, slices

KINDS = kind_table([0x20, *range(0x09, 0x0E)])
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class SpanParams:
    """A run has ``least_sentences`` sentences, or as many more as it takes to have ``least_words`` words."""

    least_sentences: int = 3
    least_words: int = 15
    window: int = 8  # of so many consecutive words of a row, at least one ends a piece


@dataclass
class Sentences:
    """Pieces of the rows of a slice: first word, hash, and each row's first piece; ``byte`` is where a piece begins."""

    first: np.ndarray
    words: np.ndarray
    hashes: np.ndarray
    byte: np.ndarray
    row_starts: np.ndarray


def _least(hashes: np.ndarray, row: np.ndarray, window: int) -> np.ndarray:
    """Words that are the least, the last of equal ones, of some ``window`` consecutive words of their row."""
    n = len(hashes)
    before, after = np.zeros(n, np.int8), np.zeros(n, np.int8)
    down, up = np.ones(n, bool), np.ones(n, bool)
    for k in range(1, window):
        same, greater = row[k:] == row[:-k], hashes[k:] > hashes[:-k]
        up[:-k] &= same & greater
        up[-k:] = False
        down[k:] &= same & ~greater
        down[:k] = False
        after += up
        before += down
    return before + after + 1 >= window


def sentences(part: Slice, p: SpanParams) -> Sentences:
    """Pieces end with a word that ends in a full stop, exclamation or question mark, before a line feed, or with a least word."""
    data = lower_ascii(part.data)
    words = runs(part, KINDS[data])
    n = len(words)
    if not n:
        none = np.zeros(0, np.int64)
        return Sentences(none, none, np.zeros(0, np.uint64), none, np.zeros(part.rows + 1, np.int64))
    hashes = run_hashes(data, words)
    last = data[words.ends - 1]
    stop = (last == 46) | (last == 33) | (last == 63)
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    stop[:-1] |= feeds[words.starts[1:]] > feeds[words.ends[:-1]]
    stop |= _least(hashes, words.row, p.window)
    begins = np.concatenate([[True], stop[:-1]])
    begins[words.row_starts[:-1][np.diff(words.row_starts) > 0]] = True
    first = np.flatnonzero(begins)
    place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    total = np.add.reduceat(mix(hashes + (place + 1).astype(np.uint64) * _STEP), first)
    return Sentences(first, np.diff(np.append(first, n)), mix(total), words.starts[first],
                     np.searchsorted(first, words.row_starts))


def spans(s: Sentences, p: SpanParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, from, to) of every run, sentences counted from 0 in their row, ``to`` exclusive.

    From each sentence the shortest run forward; and where a sentence is the last of none of them, the shortest run
    that ends with it, so the sentences of a repeated passage are covered up to its end.
    """
    m = len(s.first)
    row = np.repeat(np.arange(len(s.row_starts) - 1), np.diff(s.row_starts))
    if not m:
        return np.zeros(0, np.uint64), row, row, row
    ends, starts = s.row_starts[1:][row], s.row_starts[:-1][row]
    total = np.concatenate([[0], np.cumsum(s.words)])
    i = np.arange(m)
    to = np.maximum(i + p.least_sentences, np.searchsorted(total, total[:-1] + p.least_words))
    good = to <= ends
    covered = np.zeros(m + 1, bool)
    covered[to[good]] = True
    j = np.flatnonzero(~covered[1:]) + 1
    back = np.minimum(j - p.least_sentences, np.searchsorted(total, total[j] - p.least_words, "right") - 1)
    fits = back >= starts[j - 1]
    a, b = np.concatenate([i[good], back[fits]]), np.concatenate([to[good], j[fits]])
    # A hash of the run from prefix sums of rolled hashes: sum of h[k] * base**(k - a), in 64-bit arithmetic.
    out = np.zeros(len(a), np.uint64)
    size = b - a
    for k in range(int(size.max()) if len(size) else 0):
        on = np.flatnonzero(size > k)
        out[on] = mix(out[on] * np.uint64(0x100000001B3) + s.hashes[a[on] + k])
    return mix(out + size.astype(np.uint64) * _STEP), row[a], a - starts[a], b - starts[a]


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by id and text hash; a null id comes before all others."""
    return docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))).withColumn(
        "_key", F.xxhash64(F.coalesce("text", F.lit(""))))


def span_table(docs: DataFrame, p: SpanParams = SpanParams()) -> DataFrame:
    """hash, _id, _key, from, to of every run of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                value, row, a, b = spans(sentences(part, p), p)
                at = pa.array(row + part.first, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), batch.column("_id").take(at), batch.column("_key").take(at),
                     pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["hash", "_id", "_key", "from", "to"])

    return _keyed(docs).select("_id", "_key", "text").mapInArrow(run, "hash bigint, _id bigint, _key bigint, from int, to int")


def repeated_spans(docs: DataFrame, p: SpanParams = SpanParams()) -> DataFrame:
    """The runs that are not the first of their hash by (id, text hash, place): _id, _key, from, to.

    Counting sends bare hashes, which combine before the shuffle; only runs whose hash comes again are joined with
    their place. A passage in very many documents is a hot key of joins between written tables and of minima.
    """
    every = span_table(docs, p)
    again = stage(every.select("hash").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash"), "again")
    rows = stage(every.join(again, "hash", "left_semi"), "repeated")
    firsts = stage(rows.groupBy("hash").agg(F.min(F.struct("_id", "_key", "from")).alias("first")), "firsts")
    return rows.join(firsts, "hash").where(F.struct("_id", "_key", "from") != F.col("first")).select("_id", "_key", "from", "to")


def remove_repeats(docs: DataFrame, p: SpanParams = SpanParams()) -> DataFrame:
    """The documents with repeated passages removed, and n_sentences, n_removed and removed (from:to, ...).

    ``removed`` has the byte spans of the old text that went, comma-joined. Null, empty and short texts have no run and
    stay as they are; a text that goes as a whole becomes empty, its row stays. Rows equal in id and text are treated as
    one, so they lose the same passages. Columns of the three names are replaced, all others stay.
    """
    new = ["n_sentences", "n_removed", "removed"]
    kept = [c for c in docs.columns if c not in new]
    drops = stage(repeated_spans(docs.select("doc_id", "text"), p).groupBy("_id", "_key").agg(
        F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("from"), F.col("to") - 1)))).alias("_drop")), "drops")
    rows = _keyed(docs.select(*kept)).join(drops, ["_id", "_key"], "left").select(*kept, "_drop")
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
                       + ["n_sentences bigint", "n_removed bigint", "removed string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                own = batch.slice(part.first, part.rows)
                s = sentences(part, p)
                texts, drop = own.column("text").to_pylist(), own.column("_drop").to_pylist()
                counts, gone = np.diff(s.row_starts), []
                for i, places in enumerate(drop):
                    if not places:
                        gone.append("")
                        continue
                    raw = part.data[part.starts[i]:part.starts[i + 1]].tobytes()
                    cuts = np.append(s.byte[s.row_starts[i]:s.row_starts[i + 1]] - part.starts[i], len(raw))
                    flag = np.zeros(len(cuts) + 1, np.int8)
                    flag[np.array(places) + 1] = 1
                    edge = np.flatnonzero(np.diff(flag))
                    pairs = [(int(cuts[a]), int(cuts[b])) for a, b in zip(edge[::2], edge[1::2])]
                    left, at = [], 0
                    for a, b in pairs:
                        left.append(raw[at:a])
                        at = b
                    texts[i] = b"".join([*left, raw[at:]]).decode()
                    gone.append(",".join(f"{a}:{b}" for a, b in pairs))
                columns = [pa.array(texts, pa.string()) if c == "text" else own.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(counts, pa.int64()), pa.array([len(x or []) for x in drop], pa.int64()),
                     pa.array(gone, pa.string())], names=[*kept, *new])

    return rows.mapInArrow(run, schema)
