"""SentencePiece encoding of merge-type (BPE) vocabularies by a score-ordered agenda, and decoding.

The agenda holds every pair of adjacent symbols that together are a piece of the vocabulary. The pair of the highest score
(the leftmost of equals) is merged, and the pairs that the new symbol forms with its neighbours join the agenda. Where no
piece runs across the beginning of a word, words merge independently, so a task merges a word that it
remembers only once, and the agendas of all short words of a slice advance together in arrays.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskloom.llm.textops import Slice, slices

SPACE = "▁"
SLICE_BYTES = 1 << 22
#: Texts that are decoded at once.
CALL_ROWS = 200
#: Words of up to so many characters are merged side by side, one merge of each per step; longer ones by a heap of their own.
SHORT = 48
#: Words whose ids a worker remembers, and at most 16 times as many ids.
MEMORY_WORDS = 500_000
NONE = np.int64(1) << 30
#: Places of the table in which pairs are looked up first, for each pair.
SPARSE = 16
_HASHES = {1: np.uint64(0x9E3779B97F4A7C15), 2: np.uint64(0xC2B2AE3D27D4EB4F)}


def slots(keys: np.ndarray, bits: int, which: int) -> np.ndarray:
    """A place below 2 ** ``bits`` for each key, by one of two multiplicative hashes."""
    return ((keys.astype(np.uint64) * _HASHES[which]) >> np.uint64(64 - bits)).astype(np.int64)


class MergeVocabulary:
    """Pieces and scores of a model file; the library reads the file and normalises, the agenda encodes.

    A symbol is a number: pieces and the characters that pieces are made of count from 0, any other character is -1 minus
    its code point. ``merges`` holds left * size + right of all pairs that form a piece, in order, with the piece and its
    place in the order of scores; equal scores share a place.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=model_file)
        ids = range(lib.get_piece_size())
        plain = [i for i in ids if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        if any(lib.is_unused(i) for i in plain):
            raise ValueError("a vocabulary with unused pieces is not supported")
        pieces = {lib.id_to_piece(i): i for i in plain}
        names = [*pieces, *sorted({c for piece in pieces for c in piece} - set(pieces))]
        number = {name: k for k, name in enumerate(names)}
        scores = np.array([lib.get_score(pieces[name]) for name in pieces])
        place = np.unique(-scores, return_inverse=True)[1]
        found = sorted((number[piece[:k]] * len(names) + number[piece[k:]], n)
                       for n, piece in enumerate(pieces) for k in range(1, len(piece))
                       if piece[:k] in number and piece[k:] in number)
        self.size = len(names)
        self.merges = np.array([key for key, _ in found], np.int64)
        self.merged = np.array([n for _, n in found], np.int64)
        self.place = place[self.merged].astype(np.int64)
        self.first, self.second = self._places()
        self.of_char = -1 - np.arange(0x110000, dtype=np.int32)
        for name, k in number.items():
            if len(name) == 1:
                self.of_char[ord(name)] = k
        self.names = names
        self.token = np.array([pieces.get(name, -1) for name in names], np.int32)
        self.unknown = lib.unk_id()
        as_bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = as_bytes if all(lib.is_byte(i) for i in as_bytes) else None
        #: Whether every piece has spaces at its beginning only; else a text is one word.
        self.by_words = not any(SPACE in piece.lstrip(SPACE) for piece in pieces)
        self.forget()

    @cached_property
    def by_pair(self) -> dict[int, tuple[int, int]]:
        """``merges`` as a dictionary, for one pair at a time."""
        return dict(zip(self.merges.tolist(), zip(self.place.tolist(), self.merged.tolist())))

    def _places(self) -> tuple[np.ndarray, np.ndarray]:
        """Where pairs are in ``merges``, by two hashes: the second table holds what meets another pair in the first."""
        bits = (SPARSE * len(self.merges)).bit_length()
        first = np.zeros(1 << bits, np.int32)
        at = np.arange(len(self.merges), dtype=np.int32)
        first[slots(self.merges, bits, 1)] = at
        rest = at[first[slots(self.merges, bits, 1)] != at]
        while True:  # larger until no two pairs meet
            found = slots(self.merges[rest], bits, 2)
            if len(np.unique(found)) == len(rest):
                break
            bits += 1
        second = np.zeros(1 << bits, np.int32)
        second[found] = rest
        return first, second

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, piece) of each pair of symbols; the place is NONE where they form no piece."""
        known = (left >= 0) & (right >= 0)
        keys = np.where(known, left.astype(np.int64) * self.size + right, -1)
        at = self.first[slots(keys, len(self.first).bit_length() - 1, 1)]
        hit = self.merges[at] == keys
        other = np.flatnonzero(~hit)
        if len(other):
            again = self.second[slots(keys[other], len(self.second).bit_length() - 1, 2)]
            found = self.merges[again] == keys[other]
            at[other[found]], hit[other[found]] = again[found], True
        return np.where(hit, self.place[at], NONE), self.merged[at]

    def merge_short(self, symbol: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, lengths) of words without a pair left; every step merges the best pair of each open word."""
        word = np.arange(len(lengths))
        place, piece = self.pairs(symbol[:-1], symbol[1:])
        place, piece = np.append(place, NONE), np.append(piece, 0)
        starts = np.cumsum(lengths) - lengths
        place[starts[1:] - 1] = NONE  # no pair runs from one word into the next
        done_word, done_symbol, done_length = [], [], []
        while True:
            best = np.minimum.reduceat((place << 32) | np.arange(len(place)), starts) if len(word) else np.zeros(0, np.int64)
            open_ = best < NONE << 32
            if not open_.all():
                rows = np.repeat(open_, lengths)
                done_word.append(word[~open_])
                done_symbol.append(symbol[~rows])
                done_length.append(lengths[~open_])
                at = (best & 0xFFFFFFFF)[open_]
                at -= np.cumsum(~rows)[at]
                symbol, place, piece = symbol[rows], place[rows], piece[rows]
                word, lengths = word[open_], lengths[open_]
            else:
                at = best & 0xFFFFFFFF
            if not len(word):
                break
            symbol[at] = piece[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            symbol, place, piece = symbol[keep], place[keep], piece[keep]
            lengths = lengths - 1
            starts = np.cumsum(lengths) - lengths
            at = at - np.arange(len(at))
            place[at] = NONE
            behind, ahead = at[at + 1 < starts + lengths], at[at > starts] - 1
            for left in (behind, ahead):
                place[left], piece[left] = self.pairs(symbol[left], symbol[left + 1])
        word, length = np.concatenate(done_word), np.concatenate(done_length)
        order = np.argsort(word, kind="stable")
        begin = (np.cumsum(length) - length)[order]
        length = length[order]
        inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        return np.concatenate(done_symbol)[np.repeat(begin, length) + inside], length

    def merge_long(self, symbol: np.ndarray) -> np.ndarray:
        """The symbols of one word without a pair left; the agenda is a heap, outdated entries are passed over."""
        n = len(symbol)
        places, pieces = self.pairs(symbol[:-1], symbol[1:])
        at = np.flatnonzero(places < NONE)
        own, after, before = symbol.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(p, i, i + 1, own[i], own[i + 1], m) for p, i, m in zip(places[at].tolist(), at.tolist(), pieces[at].tolist())]
        heapq.heapify(agenda)
        gone = None

        def add(i: int, j: int) -> None:
            a, b = own[i], own[j]
            found = self.by_pair.get(a * self.size + b) if a >= 0 and b >= 0 else None
            if found:
                heapq.heappush(agenda, (found[0], i, j, a, b, found[1]))

        while agenda:
            _, i, j, a, b, piece = heapq.heappop(agenda)
            if own[i] != a or own[j] != b or after[i] != j:
                continue
            own[i], own[j] = piece, gone
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                add(i, k)
            if before[i] >= 0:
                add(before[i], i)
        return np.array([s for s in own if s is not gone], np.int64)

    def forget(self) -> None:
        """Empties the memory of words: each one's row, and per row where its ids begin, how many they are, whether it came again."""
        self.rows: dict[bytes, int] = {}
        self.known = np.zeros(0, np.int32)
        self.begin = self.count = np.zeros(0, np.int64)
        self.again = np.zeros(0, bool)

    def _make_room(self) -> None:
        """Keeps the words that came again since the last time; forgets all if those fill half of the memory."""
        kept = np.flatnonzero(self.again)
        counts = self.count[kept]
        size = int(counts.sum())
        if len(kept) > MEMORY_WORDS // 2 or size > 8 * MEMORY_WORDS:
            return self.forget()
        names = list(self.rows)  # in the order of their rows
        self.rows = {names[i]: n for n, i in enumerate(kept.tolist())}
        begin = np.cumsum(counts) - counts
        self.known = self.known[np.repeat(self.begin[kept] - begin, counts) + np.arange(size)]
        self.begin, self.count, self.again = begin, counts, np.zeros(len(kept), bool)

    def remembered(self, words: pa.Array) -> np.ndarray:
        """The rows of distinct words; new ones are merged first."""
        if len(self.rows) > MEMORY_WORDS or len(self.known) > 16 * MEMORY_WORDS:
            self._make_room()
        keys = words.to_numpy(zero_copy_only=False).tolist()  # bytes at once, not a scalar of Arrow for each
        row = np.array(list(map(self.rows.get, keys, repeat(-1))), np.int64)
        self.again[row[row >= 0]] = True
        new = np.flatnonzero(row < 0)
        if len(new):
            fresh = [keys[i] for i in new.tolist()]
            ids, counts = self.words_ids(fresh)
            row[new] = len(self.begin) + np.arange(len(new))
            self.rows.update(zip(fresh, row[new].tolist()))
            self.begin = np.append(self.begin, len(self.known) + np.cumsum(counts) - counts)
            self.count = np.append(self.count, counts)
            self.known = np.append(self.known, ids)
            self.again = np.append(self.again, np.zeros(len(new), bool))
        return row

    def words_ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words, one after another; a symbol outside the vocabulary becomes its bytes or the unknown id."""
        text = b"".join(words)
        symbol = self.of_char[np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)].astype(np.int64)
        data = np.frombuffer(text, np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))
        lengths = np.diff(np.append(0, chars[ends]))
        long = lengths > SHORT
        of_long = np.repeat(long, lengths)
        short_symbols, counts_short = self.merge_short(symbol[~of_long], lengths[~long]) if not long.all() else (symbol[:0], lengths[:0])
        if not long.any():
            return self._tokens(short_symbols, counts_short)
        starts = np.cumsum(lengths) - lengths
        merged = [self.merge_long(symbol[a:a + n]) for a, n in zip(starts[long], lengths[long])]
        counts = np.empty(len(lengths), np.int64)
        counts[~long], counts[long] = counts_short, [len(m) for m in merged]
        out = np.empty(int(counts.sum()), np.int64)
        rows = np.repeat(long, counts)
        out[~rows], out[rows] = short_symbols, np.concatenate(merged)
        return self._tokens(out, counts)

    def _tokens(self, symbol: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.where(symbol >= 0, self.token[np.maximum(symbol, 0)], -1)
        strange = np.flatnonzero(ids < 0)
        if not len(strange):
            return ids.astype(np.int32), counts
        spelled = [self._spelled(int(s)) for s in symbol[strange]]
        sizes = np.ones(len(ids), np.int64)
        sizes[strange] = [len(x) for x in spelled]
        out = np.repeat(ids, sizes)
        out[np.repeat(ids < 0, sizes)] = [i for x in spelled for i in x]
        word = np.repeat(np.arange(len(counts)), counts)
        return out.astype(np.int32), np.bincount(np.repeat(word, sizes), minlength=len(counts))

    def _spelled(self, symbol: int) -> list[int]:
        if not self.bytes:
            return [self.unknown]
        char = self.names[symbol] if symbol >= 0 else chr(-1 - symbol)
        return [self.bytes[b] for b in char.encode("utf-8")]

    def encode_slice(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the normalised texts of a slice, row after row."""
        starts = word_starts(part) if self.by_words else part.starts[:-1][np.diff(part.starts) > 0]
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(part.rows + 1, np.int64)
        bounds = np.append(starts, len(part.data)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(part.data)])
        coded = words.dictionary_encode()
        row = self.remembered(coded.dictionary)[coded.indices.to_numpy()]
        lengths = self.count[row]
        ends = np.cumsum(lengths)
        ids = self.known[np.repeat(self.begin[row] - (ends - lengths), lengths) + np.arange(int(ends[-1]))]
        offsets = np.append(0, ends)[np.searchsorted(starts, part.starts)]
        return (ids, offsets) if self.bytes else self._merge_unknown(ids, offsets)

    def _merge_unknown(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without pieces for bytes, a run of unknown ids of one row is one id."""
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        again[offsets[:-1][offsets[:-1] < len(ids)]] = False
        return ids[~again], offsets - np.append(0, np.cumsum(again))[offsets]


def word_starts(part: Slice) -> np.ndarray:
    """Where words begin: at every row's first byte and at every run of space marks."""
    data, first, second, third = part.data, *SPACE.encode("utf-8")
    mark = np.zeros(len(data) + 3, bool)  # whether the three bytes from here are a space mark; three places in front
    if len(data) > 2:
        mark[3:-2] = (data[:-2] == first) & (data[1:-1] == second) & (data[2:] == third)
    begins = mark[3:] & ~mark[:-3]
    begins[part.starts[:-1][np.diff(part.starts) > 0]] = True
    return np.flatnonzero(begins)


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> MergeVocabulary:
    return MergeVocabulary(model_file)


def encode_texts(vocab: MergeVocabulary, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of the texts; null counts as empty, and an empty text has no ids."""
    plain = pa.array(vocab.library.normalize([t or "" for t in texts]), pa.large_string())
    parts = [vocab.encode_slice(part) for part in slices(plain, 2 * SLICE_BYTES)]  # space marks make it longer
    sizes = np.concatenate([np.zeros(0, np.int64), *[np.diff(offsets) for _, offsets in parts]])
    return np.concatenate([np.zeros(0, np.int32), *[ids for ids, _ in parts]]), np.append(0, np.cumsum(sizes))


def check_texts(vocab: MergeVocabulary, texts: list[str | None], ids: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """The ids of each text as the library encodes the whole of it; raises where they are others than ``ids``."""
    lists = []
    for k, text in enumerate(texts):
        lists.append(vocab.library.encode(text or "", out_type=int))
        if lists[-1] != ids[offsets[k]:offsets[k + 1]].tolist():
            raise ValueError(f"the library encodes this text otherwise: {(text or str())[:200]!r}")
    return lists


def encode(docs: DataFrame, model_file: str, text_col: str = "text", out: str = "ids", check_every: int = 1,
           decoded: str | None = None) -> DataFrame:
    """Adds the ids of every whole text as an array column ``out``; no begin or end ids, no sampling.

    The library encodes every whole text too, slice by slice (4 MB), and other ids are an error. A caller may set
    ``check_every`` to check one slice in so many of a task, from the first one on, or 0 for none. Null and empty texts get an empty array. All other
    columns stay; a column named as ``out`` is replaced. ``decoded`` names a further column with the text that the library
    decodes the ids to, as :func:`decode` does, without sending them to a second worker. Rows are independent: nothing is shuffled, and a lost task is
    run again. ``model_file`` must be readable at the same place on every executor.
    """
    kept = [c for c in docs.columns if c not in (out, decoded)]
    added = [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)]
    added += [T.StructField(decoded, T.StringType(), False)] if decoded else []
    schema = T.StructType([docs.schema[c] for c in kept] + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, n = vocabulary(model_file), 0
        for batch in batches:
            for piece in slices(batch.column(text_col), SLICE_BYTES):
                part = batch.slice(piece.first, piece.rows)
                texts = part.column(text_col).to_pylist()
                ids, offsets = encode_texts(vocab, texts)
                lists = None
                if check_every and n % check_every == 0:
                    lists = check_texts(vocab, texts, ids, offsets)
                n += 1
                made = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                columns = [*[part.column(c) for c in kept], made]
                if decoded:
                    columns.append(decode_lists(vocab.library, id_lists(made) if lists is None else lists))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*kept).mapInArrow(run, schema)


def id_lists(column: pa.ListArray) -> list[list[int]]:
    """The ids of each row, converted all at once; none for null."""
    flat = column.flatten().to_numpy(zero_copy_only=False).tolist()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy()).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def decode_lists(library, lists: list[list[int]]) -> pa.Array:
    return pa.array([library.decode(ids) if ids else "" for ids in lists], pa.string())


def decode(rows: DataFrame, model_file: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the text that the library decodes the ids to; a null array decodes to an empty text."""
    kept = [c for c in rows.columns if c != out]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = vocabulary(model_file).library
        for batch in batches:
            for at in range(0, batch.num_rows, CALL_ROWS):
                part = batch.slice(at, CALL_ROWS)
                texts = decode_lists(library, id_lists(part.column(ids_col)))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [texts], names=[*kept, out])

    return rows.select(*kept).mapInArrow(run, schema)
