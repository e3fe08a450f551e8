"""Vectorised text helpers for Arrow tasks: slices of bounded bytes, words, word and n-gram hashes.

Every function works on the UTF-8 bytes of several rows at once, so a task never loops over words in
Python and never holds more than one slice of intermediate arrays (one row, where a row is longer).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Bytes of runs that are hashed at once.
HASH_BYTES = 1 << 21

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x100000001B3)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a finaliser of xor-shifts and multiplications)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


@dataclass
class Slice:
    """Rows ``first`` to ``last`` of a batch: their bytes one after another and where each row starts."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray  # last - first + 1 offsets into data

    @property
    def rows(self) -> int:
        return self.last - self.first


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a text column (null counts as empty) into slices of about ``max_bytes``, whole rows each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1
        end = min(max(end, at + 1), len(column))
        yield Slice(at, end, data[offsets[at]:offsets[end]], (offsets[at:end + 1] - offsets[at]).astype(np.int64))
        at = end


@dataclass
class Words:
    """Runs of word bytes: where each begins and ends in the slice, its row, and each row's first word."""

    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    row_starts: np.ndarray  # rows + 1 offsets into the words

    def __len__(self) -> int:
        return len(self.starts)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def runs(part: Slice, kind: np.ndarray) -> Words:
    """Maximal runs of bytes of one kind (0: between words); a run ends where its row ends."""
    n = len(part.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(part.rows + 1, np.int64))
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    cut[part.starts] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    keep = kind[starts] > 0
    starts, ends = starts[keep], ends[keep]
    row_starts = np.searchsorted(starts, part.starts)
    row = np.repeat(np.arange(part.rows), np.diff(row_starts))
    return Words(starts, ends, row, row_starts)


def _powers(n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = _BASE
        np.cumprod(out, out=out)
    return out


def run_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """A 64-bit hash of the bytes of each run; long inputs in parts, so the work arrays stay small."""
    lengths = words.ends - words.starts
    ends = np.cumsum(lengths)
    cuts = np.searchsorted(ends, np.arange(HASH_BYTES, int(ends[-1]) if len(ends) else 0, HASH_BYTES))
    bounds = np.unique([0, *cuts.tolist(), len(lengths)])
    parts = [_hash_part(data, words.starts[i:j], lengths[i:j]) for i, j in zip(bounds[:-1], bounds[1:])]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _hash_part(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    offsets = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(offsets, lengths)
    index = place + np.repeat(starts, lengths)
    terms = (data[index].astype(np.uint64) + np.uint64(1)) * _powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(terms, offsets) + lengths.astype(np.uint64) * _STEP)


def ngrams(hashes: np.ndarray, words: Words, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words of a row, and each one's row.

    With ``short``, a row of fewer words (but not none) gives its whole sequence as one.
    """
    count = np.diff(words.row_starts)
    row = words.row
    last = words.row_starts[1:][row] if len(row) else row
    size = np.minimum(n, count[row]) if short else np.full(len(row), n)
    at = np.flatnonzero(np.arange(len(row)) + size <= last)
    if short and len(at):
        at = at[(count[row[at]] >= n) | (at == words.row_starts[:-1][row[at]])]
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        inside = at + k < last[at] if short else slice(None)
        step = mix(hashes[np.minimum(at + k, max(len(hashes) - 1, 0))] + np.uint64((k + 1) * int(_STEP) % 2**64))
        if short:
            out[inside] = mix(out[inside] * _BASE + step[inside])
        else:
            out = mix(out * _BASE + step)
    return out, row[at]


def kind_table(separators: str | list[int]) -> np.ndarray:
    """A byte-to-kind table: 0 for the given byte values, 1 for all others."""
    table = np.ones(256, np.uint8)
    table[[ord(c) if isinstance(c, str) else c for c in separators]] = 0
    return table
