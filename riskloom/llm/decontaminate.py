"""Benchmark decontamination: suffix arrays over the training text, searched with every test suffix.

Each task reads slices of documents, builds the suffix array of a slice over word numbers and binary-searches
all suffixes of the test items in it. That yields, per test suffix, its longest verbatim match and all places
where its window occurs. Documents are never shuffled and no array outlives its slice.

Only words of the items have numbers; a suffix enters the array only where at least one window's worth of
numbered words follows, because no other can match a window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.staging import set_aside, stage
from riskloom.llm.textops import Slice, kind_table, lower_ascii, run_hashes, runs, slices

#: Bytes between words (after lower-casing): 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F.
KINDS = kind_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
WINDOW = 10
#: The items go to the tasks in blocks of at most so many bytes of text; each block is one pass over the documents.
BLOCK_BYTES = 4 << 20


@dataclass
class TestBlock:
    """Items as word numbers 1..V, one after another; ``vocab`` holds the sorted hashes of the words."""

    vocab: np.ndarray
    words: np.ndarray  # items joined, a 0 after each
    item_of: np.ndarray  # item index by place, -1 at a 0
    left: np.ndarray  # words of the item from this place on
    window: np.ndarray  # by item: words of its windows
    items: list


def test_block(items: list, texts: list[str | None], window: int = WINDOW) -> TestBlock:
    """Numbers the words of some items; items without words take no part."""
    pieces, ids, of = [], [], []
    for part in slices(pa.array(texts, pa.string())):
        data = lower_ascii(part.data)
        words = runs(part, KINDS[data])
        hashes = run_hashes(data, words)
        for i in range(part.rows):
            own = hashes[words.row_starts[i]:words.row_starts[i + 1]]
            if len(own):
                pieces.append(own)
                ids.append(items[part.first + i])
    vocab = np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, np.uint64)
    joined, left = [], []
    for k, own in enumerate(pieces):
        joined += [np.searchsorted(vocab, own) + 1, [0]]
        of += [np.full(len(own), k), [-1]]
        left += [np.arange(len(own), 0, -1), [0]]
    cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return TestBlock(vocab, cat(joined), cat(of), cat(left),
                     np.array([min(window, len(p)) for p in pieces], np.int64), ids)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` in the order of their first ``depth`` numbers (prefix doubling)."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        after = np.full(n, -1, np.int64)
        after[:max(n - k, 0)] = rank[k:]
        key = rank * (n + 2) + after + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]])) if n else 0
        rank, k = new, 2 * k
        if k >= depth or not n or rank[order[-1]] == n - 1:
            return order


def common_prefix(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Equal numbers of a[i:] and b[j:], up to ``limit`` each; both arrays end with a 0 that equals nothing."""
    out = np.zeros(len(i), np.int64)
    on = np.flatnonzero(limit > 0)
    step = 0
    while len(on):
        x = a[np.minimum(i[on] + step, len(a) - 1)]
        same = (x != 0) & (x == b[np.minimum(j[on] + step, len(b) - 1)])
        on = on[same]
        step += 1
        out[on] = step
        on = on[limit[on] > step]
    return out


def search(text: np.ndarray, order: np.ndarray, test: np.ndarray, at: np.ndarray, depth: np.ndarray,
           after: bool) -> np.ndarray:
    """For each test suffix: how many suffixes sort before it (``after``: or equal it) on ``depth`` words."""
    low = np.zeros(len(at), np.int64)
    high = np.full(len(at), len(order), np.int64)
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) // 2
        there = order[mid]
        same = common_prefix(test, at[open_], text, there, depth[open_])
        x = test[np.minimum(at[open_] + same, len(test) - 1)]
        y = text[np.minimum(there + same, len(text) - 1)]
        whole = same >= depth[open_]
        right = np.where(whole, after, y < x)
        low[open_] = np.where(right, mid + 1, low[open_])
        high[open_] = np.where(right, high[open_], mid)
    return low


def _places(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each run."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts) + np.repeat(firsts, counts)


def match_slice(part: Slice, block: TestBlock) -> dict[str, list]:
    """Per row of the slice: words, hit words, items found, and the longest match with its item and place."""
    data = lower_ascii(part.data)
    words = runs(part, KINDS[data])
    hits = np.zeros(len(words) + 1, np.int64)
    longest = np.zeros(part.rows, np.int64)
    longest_item = np.full(part.rows, -1, np.int64)
    longest_at = np.full(part.rows, -1, np.int64)
    found: list[list] = [[] for _ in range(part.rows)]
    if len(words) and len(block.words):
        hashes = run_hashes(data, words)
        slot = np.minimum(np.searchsorted(block.vocab, hashes), len(block.vocab) - 1)
        number = np.where(block.vocab[slot] == hashes, slot + 1, 0)
        # Maximal runs of numbered words within a row that are as long as the shortest window.
        cut = np.ones(len(number) + 1, bool)
        cut[1:-1] = (number[1:] == 0) | (number[:-1] == 0) | (words.row[1:] != words.row[:-1])
        edges = np.flatnonzero(cut)
        keep = (number[edges[:-1]] > 0) & (np.diff(edges) >= block.window.min())
        firsts, counts = edges[:-1][keep], np.diff(edges)[keep]
        if len(firsts):
            place = _places(firsts, counts)
            ends = np.cumsum(counts)
            text = np.insert(number[place], ends, 0)
            origin = np.insert(place, ends, -1)
            _match(text, origin, words, block, hits, longest, longest_item, longest_at, found)
    covered = np.concatenate([[0], np.cumsum(hits[:-1]) > 0, [0]]).astype(np.int8)
    # Hits never cross a row, but hits of neighbouring rows may touch: each row is cut out on its own.
    spans: list[list[int]] = [[] for _ in range(part.rows)]
    for i in np.flatnonzero([bool(x) for x in found]):
        a, b = words.row_starts[i], words.row_starts[i + 1]
        own = np.concatenate([[0], covered[a + 1:b + 1], [0]])
        spans[i] = np.flatnonzero(np.diff(own)).tolist()
    return {"n_words": np.diff(words.row_starts), "items": found, "spans": spans, "longest": longest,
            "longest_name": [block.items[k] if k >= 0 else None for k in longest_item], "longest_at": longest_at}


def _match(text, origin, words, block, hits, longest, longest_item, longest_at, found) -> None:
    order = suffix_array(text, int(block.left.max()))
    at = np.flatnonzero((block.item_of >= 0) & np.isin(block.words, text))
    window = block.window[block.item_of[at]]
    at, window = at[block.left[at] >= window], window[block.left[at] >= window]
    low = search(text, order, block.words, at, window, after=False)
    high = search(text, order, block.words, at, window, after=True)
    at, window, low, high = (x[low < high] for x in (at, window, low, high))
    if not len(at):
        return
    # One window that several items share is expanded once for each item that has it.
    count = high - low
    which = np.repeat(np.arange(len(at)), count)
    spot = order[_places(low, count)]
    word = origin[spot]
    np.add.at(hits, word, 1)
    np.add.at(hits, word + window[which], -1)
    row, item = words.row[word], block.item_of[at][which]
    for r, i in np.unique(np.stack([row, item], 1), axis=0):
        found[r].append(block.items[i])
    # The longest match: the whole rest of the item may follow the window.
    length = common_prefix(block.words, at[which], text, spot, block.left[at][which])
    best = np.lexsort((word, -length, row))
    first = best[np.concatenate([[True], row[best][1:] != row[best][:-1]])]
    longest[row[first]], longest_item[row[first]] = length[first], item[first]
    longest_at[row[first]] = word[first] - words.row_starts[row[first]]


MATCH_FIELDS = [
    T.StructField("n_words", T.LongType(), False), T.StructField("n_hit", T.LongType(), False),
    T.StructField("items", T.ArrayType(T.StringType(), False), False),
    T.StructField("longest_words", T.LongType(), False), T.StructField("longest_item", T.StringType(), True),
    T.StructField("longest_at", T.LongType(), False),
    T.StructField("hit_spans", T.ArrayType(T.LongType(), False), False)]
MATCH_NAMES = [f.name for f in MATCH_FIELDS]


def _blocks(benchmark: DataFrame, window: int) -> Iterator[TestBlock]:
    """The items in blocks of a bounded size; rows stream to the driver, which holds one block at a time."""
    items, texts, size = [], [], 0
    rows = (benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
            .select(F.col("item_id").cast("string").alias("item_id"), "text").distinct())
    for row in rows.toLocalIterator():
        items.append(row.item_id)
        texts.append(row.text)
        size += len(row.text)
        if size >= BLOCK_BYTES:
            yield test_block(items, texts, window)
            items, texts, size = [], [], 0
    if items:
        yield test_block(items, texts, window)


def match_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds to every document what it shares with the items, by whole texts.

    ``n_words``, ``n_hit`` (words inside an occurrence of a window of ``window`` consecutive item words; an item of
    fewer words is one window), ``items`` (sorted, as strings), ``longest_words`` with ``longest_item`` and
    ``longest_at`` (first word of the longest verbatim match; 0, null and -1 without one) and ``hit_spans``
    (begin, end, begin, end, ... of the hit words). Null texts have no words, null items and item ids are skipped,
    repeated items count once. Columns of these names are replaced, all others stay. Each block of items is one
    pass over the documents, which adds to what the passes before it found; one block is the usual case.
    """
    kept = [c for c in docs.columns if c not in MATCH_NAMES]
    blocks = _blocks(benchmark, window)
    block = next(blocks, None) or test_block([], [], window)
    rows = _match_pass(docs.select(*kept), block, first=True)
    for block in blocks:
        rows = _match_pass(stage(rows, "matches"), block, first=False)
    return rows


def _match_pass(docs: DataFrame, block: TestBlock, first: bool) -> DataFrame:
    kept = [c for c in docs.columns if c not in MATCH_NAMES]
    schema = T.StructType([docs.schema[c] for c in kept] + MATCH_FIELDS)
    shared = docs.sparkSession.sparkContext.broadcast(block)  # bounded by BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column("text")):
                rows = batch.slice(part.first, part.rows)
                before = None if first else rows.select(MATCH_NAMES).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [rows.column(c) for c in kept] + _columns(match_slice(part, shared.value), before),
                    names=[*kept, *MATCH_NAMES])

    return docs.mapInArrow(run, schema)


def _merged(spans: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _columns(got: dict, before: list[dict] | None) -> list[pa.Array]:
    items = [sorted(set(x)) for x in got["items"]]
    spans, longest, name, at = got["spans"], got["longest"].tolist(), got["longest_name"], got["longest_at"].tolist()
    for i, old in enumerate(before or []):
        items[i] = sorted({*items[i], *old["items"]})
        spans[i] = _merged(spans[i] + old["hit_spans"])
        if old["longest_words"] >= longest[i]:
            longest[i], name[i], at[i] = old["longest_words"], old["longest_item"], old["longest_at"]
    n_hit = [sum(x[1::2]) - sum(x[::2]) for x in spans]
    return [pa.array(got["n_words"], pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())),
            pa.array(longest, pa.int64()), pa.array(name, pa.string()), pa.array(at, pa.int64()),
            pa.array(spans, pa.list_(pa.int64()))]


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that share no window with any item, with their own columns."""
    rows, own = set_aside(docs, MATCH_NAMES)
    return match_documents(rows, benchmark, window).where("n_hit = 0").select(own)
