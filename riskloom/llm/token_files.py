"""Token-id files: every document compressed on its own with one shared zstandard dictionary.

A shard file is ``MAGIC``, the SHA-256 of the dictionary, one zstandard frame per document, then the index: per
document its id, the offset and length of its frame and its number of ids, and at last the index's offset, the
number of documents and ``MAGIC`` again. A reader finds one short document with two small reads. Ids are stored as
little-endian 16-bit integers where the vocabulary allows, else 32-bit. Shards follow each other in ascending order
of doc_id, and so do the documents in each.

Files are written through ``pyarrow.fs``, so the folder may be on any store that it knows; a task writes under a
name of its own attempt and then renames, and the same rows give the same bytes, so a task that runs again replaces
its files by equal ones. Reading goes through Spark's ``binaryFile`` source.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.staging import bounded_collect, fresh_dir, stage

MAGIC = b"RLTOKENS"
ENTRY = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("length", "<u8"), ("tokens", "<u8")])
TRAILER = "<QQ8s"
TRAILER_BYTES = struct.calcsize(TRAILER)
#: Words whose ids a worker remembers, besides those of the batch; the memory is dropped when it is full.
REMEMBERED = 1_000_000
REMEMBERED_CHARS = 48


@dataclass(frozen=True)
class TokenFileParams:
    """``sample_docs`` is the expected number of documents from which the dictionary is trained."""

    end_id: int = 2
    dictionary_bytes: int = 64 << 10
    sample_docs: int = 1000
    sample_chars: int = 20_000
    level: int = 3
    shard_bytes: int = 24 << 20
    seed: int = 11


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the others
    for the letters from U+0100 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in printable)
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + k) for k, b in enumerate(rest)}}


_LETTERS = _byte_letters()


class ChunkedTokenizer:
    """The tokenizers library over whole texts, asked only once for words that come again.

    With byte-level pre-tokenisation by its pattern and no normaliser, a single space or line feed between two
    characters that are no white space begins a pre-token, and so does a mark after a letter. The ids of the chunks
    between such places, one after another, are the ids of the text. Other tokenizers are given whole texts, and
    texts with other white space longer pieces.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.chunked = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                        and not spec.get("normalizer") and not spec.get("post_processor"))
        self.model = self.tok.model
        self.dtype = np.dtype("<u2") if self.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"  # Arrow hosts are little-endian
        self.known: dict[str, bytes | None] = {}
        self.marks: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, lead: str, word: str) -> bytes:
        """Ids of one Latin word with a space or line feed before it."""
        letters = word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)
        if lead == " ":
            return array(self.code, [t.id for t in self.model.tokenize("\u0120" + letters)]).tobytes()
        return self._mark(lead) + array(self.code, [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _mark(self, mark: str) -> bytes:
        if mark not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {}
            self.marks[mark] = self._whole(mark)
        return self.marks[mark]

    def _learn(self, part: str) -> bytes | None:
        """Ids of a chunk and the space or line feed before it; None where the chunk has other white space."""
        lead, word = ("\n", part[1:]) if part[:1] == "\n" else (" ", part)
        if word.split() != [word]:
            return None
        core = word.rstrip(".,;:!?")
        if core.isalpha() and (core.isascii() or max(core) < "\u0250"):
            ids = self.known.get(core) if lead == " " else None
            if ids is None:
                ids = self._word(lead, core)
                if lead == " " and len(core) <= REMEMBERED_CHARS:
                    self.known[core] = ids
            return ids + self._mark(word[len(core):]) if len(core) < len(word) else ids
        return self._whole(lead + word)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Serialized ids of each text; null and empty texts have none."""
        if not self.chunked:
            return [self._whole(t) if t else b"" for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        return [self._text(t) if t else b"" for t in texts]

    def _text(self, text: str) -> bytes:
        first, *parts = text.replace("\n", " \n").split(" ")
        known = self.known
        missing = set(parts).difference(known)
        for p in missing:
            known[p] = self._learn(p)
        ids = [known[p] for p in parts]
        for p in missing:
            if len(p) > REMEMBERED_CHARS:
                del known[p]
        if None in ids or not first or first[0].isspace() or first[-1].isspace():
            return self._spaced(text)
        return self._whole(first) + b"".join(ids)

    def _spaced(self, text: str) -> bytes:
        """A text with runs of spaces: cut into lines of bounded length where a cut is safe, else whole."""
        from riskloom.llm.bpe import safe_pieces

        return b"".join(self._whole(p) for p in safe_pieces(text, 4096))


@lru_cache(maxsize=1)
def tokenizer(path: str) -> ChunkedTokenizer:
    return ChunkedTokenizer(path)


def train_dictionary(docs: DataFrame, tokenizer_file: str, p: TokenFileParams = TokenFileParams()) -> bytes:
    """A zstandard dictionary from the serialized ids of a sample of short documents; empty if they are too few.

    The sample is every document up to ``sample_chars`` whose hashed id falls below a share that makes about
    ``sample_docs`` of them. Only they reach the driver.
    """
    import zstandard

    short = docs.where(F.length("text") <= p.sample_chars)
    share = min(1.0, p.sample_docs / max(docs.count(), 1))
    chosen = short.where(F.pmod(F.xxhash64("doc_id", F.lit(p.seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    rows = bounded_collect(chosen.select("doc_id", "text"), 4 * p.sample_docs + 1000)
    rows.sort(key=lambda r: (r.doc_id is not None, r.doc_id, r.text))
    end = np.array([p.end_id], tokenizer(tokenizer_file).dtype).tobytes()
    samples = [x + end for x in tokenizer(tokenizer_file).encode([r.text for r in rows])]
    try:
        return zstandard.train_dictionary(p.dictionary_bytes, samples, threads=1).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:  # samples too few or too alike
        return b""


class _ShardWriter:
    """Builds one shard in memory, up to ``shard_bytes`` and one document."""

    def __init__(self, dictionary: bytes):
        self.parts = [MAGIC, hashlib.sha256(dictionary).digest()]
        self.size = sum(map(len, self.parts))
        self.entries: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int, frame: bytes, tokens: int) -> None:
        self.entries.append((doc_id, self.size, len(frame), tokens))
        self.parts.append(frame)
        self.size += len(frame)

    def save(self, folder: str, name: str) -> None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{os.path.abspath(folder)}")
        index = np.array(self.entries, ENTRY).tobytes()
        trial = f"{path}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(trial) as out:
            for part in self.parts:
                out.write(part)
            out.write(index)
            out.write(struct.pack(TRAILER, self.size, len(self.entries), MAGIC))
        store.move(trial, f"{path}/{name}")


def write_token_files(docs: DataFrame, tokenizer_file: str, p: TokenFileParams = TokenFileParams()) -> tuple[DataFrame, str, bytes]:
    """Writes every document with its end id in ascending doc_id order: (shard table, folder, dictionary).

    ``docs`` needs doc_id and text. Null texts hold the end id alone; rows with equal ids stay beside each other, in
    order of their text's hash; a null doc_id comes first, stored as the least 64-bit integer. The shard table has
    one row per file: its name, documents and ids; only named files count, so leftovers of lost attempts do no harm.
    """
    import zstandard

    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer_file, p)
    folder = _qualified(spark, fresh_dir(spark, "tokens"))
    _make_folder(spark, folder)
    schema = "shard string, docs bigint, tokens bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = tokenizer(tokenizer_file)
        end = np.array([p.end_id], tok.dtype).tobytes()
        pressed = zstandard.ZstdCompressor(level=p.level, dict_data=zstandard.ZstdCompressionDict(dictionary)) \
            if dictionary else zstandard.ZstdCompressor(level=p.level)
        done: list[tuple[str, int, int]] = []
        part, shard = TaskContext.get().partitionId(), _ShardWriter(dictionary)

        def close() -> None:
            name = f"shard-{part:06d}-{len(done):06d}.tokens"
            shard.save(folder, name)
            done.append((name, len(shard.entries), sum(e[3] for e in shard.entries)))

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                ids = some.column("doc_id").fill_null(np.iinfo(np.int64).min).to_pylist()
                for doc_id, x in zip(ids, tok.encode(some.column("text").to_pylist())):
                    shard.add(doc_id, pressed.compress(x + end), (len(x) + len(end)) // len(end))
                    if shard.size >= p.shard_bytes:
                        close()
                        shard = _ShardWriter(dictionary)
        if shard.entries:
            close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()),
             pa.array([d[2] for d in done], pa.int64())], names=["shard", "docs", "tokens"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("_h", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h").drop("_h")
    return stage(ordered.mapInArrow(run, schema), "shards"), folder, dictionary


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of the store that Spark takes it from, so that workers write to the same one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath()}"


def _make_folder(spark: SparkSession, folder: str) -> None:
    """An empty table file makes the folder on whatever store Spark writes to."""
    spark.createDataFrame([(0,)], "version int").write.mode("append").json(f"{folder}/_about")


def read_document(data: bytes, position: int, dictionary: bytes, dtype: np.dtype) -> np.ndarray:
    """The ids of the document at ``position`` of a shard, by its index alone."""
    import zstandard

    at, count, _ = struct.unpack(TRAILER, data[-TRAILER_BYTES:])
    entry = np.frombuffer(data, ENTRY, count, at)[position]
    opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary \
        else zstandard.ZstdDecompressor()
    frame = data[int(entry["offset"]):int(entry["offset"]) + int(entry["length"])]
    return np.frombuffer(opened.decompress(frame), dtype)


def read_token_files(spark: SparkSession, shards: DataFrame, folder: str, dictionary: bytes,
                     dtype: np.dtype, with_ids: bool = False) -> DataFrame:
    """Reads the files back: doc_id, start (ids before the document), n_tokens, ids_crc32 and, if asked, ids.

    ``ids_crc32`` covers the ids as little-endian unsigned 32-bit integers. A file that is cut short, of another
    dictionary or with an entry that doesn't fit its frame is an error, and so is a shard of the table whose file is gone. ``start`` adds the ids of the shards before
    (a running sum over one row per file) to the place within the file.
    """
    import zstandard

    digest = hashlib.sha256(dictionary).digest()
    fields = "doc_id bigint, shard string, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary \
            else zstandard.ZstdDecompressor()
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                at, count, magic = struct.unpack(TRAILER, data[-TRAILER_BYTES:])
                if magic != MAGIC or data[:8] != MAGIC or data[8:40] != digest:
                    raise ValueError(f"{path}: not a whole shard of this dictionary")
                index = np.frombuffer(data, ENTRY, count, at)
                starts = np.cumsum(index["tokens"]) - index["tokens"]
                crc, arrays = [], []
                for e in index:
                    ids = np.frombuffer(opened.decompress(data[int(e["offset"]):int(e["offset"]) + int(e["length"])]), dtype)
                    if len(ids) != e["tokens"]:
                        raise ValueError(f"{path}: document {e['doc_id']} has {len(ids)} ids")
                    crc.append(crc32(ids.astype("<u4").tobytes()))
                    if with_ids:
                        arrays.append(ids.astype(np.int64))
                least = np.iinfo(np.int64).min
                columns = [pa.array(index["doc_id"], pa.int64(), mask=index["doc_id"] == least),
                           pa.array([path.rsplit("/", 1)[-1]] * count, pa.string()), pa.array(starts.astype(np.int64)),
                           pa.array(index["tokens"].astype(np.int64)), pa.array(crc, pa.int64())]
                names = ["doc_id", "shard", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(arrays, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    files = (spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
             .option("pathGlobFilter", "shard-*.tokens").load(folder).select("path", "content"))
    there = files.select(F.element_at(F.split("path", "/"), -1).alias("shard"))
    gone = shards.select("shard").join(there, "shard", "left_anti").take(1)
    if gone:
        raise FileNotFoundError(f"{folder}/{gone[0].shard} is named in the shard table and is not there")
    # One row per file; the ungrouped window is bounded by the number of files.
    before = shards.select("shard", F.coalesce(F.sum("tokens").over(
        Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = files.mapInArrow(run, fields).join(before, "shard")
    return rows.select("doc_id", (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32",
                       *["ids"] * with_ids)
