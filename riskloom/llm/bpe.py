"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Texts beyond this many characters are cut at safe boundaries before they are encoded.
PIECE_CHARS = 1 << 16


@lru_cache(maxsize=2)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file; no special tokens."""
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cuts ``text`` before single spaces, about every ``size`` characters.

    A space that stands between two characters that are no white space begins a match of the pattern: no match
    of the pattern runs across it, and none looks back. So the ids of the pieces, one after another, are the
    ids of the text. Where no such space follows, the rest stays one piece.
    """
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut != -1 and (cut + 1 >= len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut == -1:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def encode_text(enc, text: str) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for piece in safe_pieces(text):
        out.extend(enc.encode_ordinary(piece))
    return out


def encode(docs: DataFrame, rank_file: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """Adds the token ids of every whole text as an array column ``out``.

    Null and empty texts get an empty array. All other columns stay as they are; a column named as ``out`` is
    replaced. Rows are independent, so nothing is shuffled, and a lost task is simply run again.
    """
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            texts = batch.column(text_col)
            for at in range(0, max(batch.num_rows, 1), 500):  # bounds the Python lists alive at once
                ids = [np.asarray(encode_text(enc, t) if t else [], np.int32) for t in texts.slice(at, 500).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + [column], names=[*kept, out])

    return docs.select(*kept).mapInArrow(run, schema)


def decode(rows: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for; raw bytes, so ids that cut a character in two lose nothing.

    A null array decodes to no bytes.
    """
    kept = [c for c in rows.columns if c != out]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(out, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), 500):
                part = batch.slice(at, 500)
                data = [enc.decode_bytes(x) if x else b"" for x in part.column(ids_col).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in kept] + [pa.array(data, pa.binary())], names=[*kept, out])

    return rows.select(*kept).mapInArrow(run, schema)


def ids_digest(ids: list[int]) -> str:
    return hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
