import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from riskloom.llm import bpe, token_files

from .helpers import awkward, awkward_rows, empty

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
JSON = public_tokenizers.path("byte_bpe_50k.json")


def test_bpe_equals_the_library_and_decodes_to_the_bytes(spark):
    enc = bpe.encoding(RANKS, PATTERN)
    got = bpe.decode(bpe.encode(awkward(spark), RANKS, PATTERN), RANKS, PATTERN).collect()
    assert len(got) == len(awkward_rows())
    for r in got:
        assert r.ids == enc.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert got[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars", "ids", "decoded"]


def test_bpe_pieces_are_safe():
    enc = bpe.encoding(RANKS, PATTERN)
    text = "It's a  test,\n of 12 3 pieces ; that's\tall   x 's y " * 400
    for size in (1, 7, 64, 1000):
        pieces = list(bpe.safe_pieces(text, size))
        assert "".join(pieces) == text
        assert [i for p in pieces for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
    assert list(bpe.safe_pieces("x" * 500, 10)) == ["x" * 500]


def test_bpe_replaces_clashing_columns_and_takes_empty_tables(spark):
    docs = awkward(spark).withColumn("ids", F.lit("old")).withColumn("decoded", F.lit(1))
    out = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN)
    assert dict(out.dtypes)["ids"] == "array<int>" and out.count() == len(awkward_rows())
    assert bpe.encode(empty(spark), RANKS, PATTERN).collect() == []


def test_special_token_text_is_ordinary(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id bigint, text string")
    row = bpe.encode(docs, RANKS, PATTERN).first()
    assert 50256 not in row.ids
    shards, folder, dictionary = token_files.write_token_files(docs, JSON)
    got = token_files.read_token_files(spark, shards, folder, dictionary, np.dtype("<u2"), with_ids=True).first()
    assert got.ids == row.ids + [2]


@pytest.mark.parametrize("limit", [24 << 20, 2000])
def test_token_files_round_trip(spark, limit):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    tok.encode_special_tokens = True
    p = token_files.TokenFileParams(shard_bytes=limit)
    docs = awkward(spark)
    shards, folder, dictionary = token_files.write_token_files(docs, JSON, p)
    dtype = token_files.tokenizer(JSON).dtype
    got = token_files.read_token_files(spark, shards, folder, dictionary, dtype, with_ids=True).orderBy("start").collect()
    assert len(got) == len(awkward_rows()) and (limit > 2000 or shards.count() > 4)
    at, last = 0, None
    for r in got:
        assert r.start == at and (last is None or r.doc_id is None or r.doc_id >= last)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids)
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else last
    want = sorted(tok.encode(t or "", add_special_tokens=False).ids + [2] for _, t, *_ in awkward_rows())
    assert sorted(r.ids for r in got) == want


def test_short_document_access_by_the_index(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("short text number "), "id").alias("text"))
    shards, folder, dictionary = token_files.write_token_files(docs, JSON)
    content = {r.path.rsplit("/", 1)[-1]: bytes(r.content) for r in
               spark.read.format("binaryFile").option("pathGlobFilter", "shard-*").load(folder).collect()}
    name = shards.orderBy("shard").first()["shard"]
    tok = token_files.tokenizer(JSON)
    ids = token_files.read_document(content[name], 3, dictionary, tok.dtype)
    assert ids.tolist() == tok.tok.encode("short text number 3", add_special_tokens=False).ids + [2]
    assert content[name][8:40] == hashlib.sha256(dictionary).digest()


def test_damaged_file_is_an_error(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id bigint, text string")
    shards, folder, dictionary = token_files.write_token_files(docs, JSON)
    with pytest.raises(Exception, match="not a whole shard"):
        token_files.read_token_files(spark, shards, folder, b"another dictionary", np.dtype("<u2")).collect()


def test_token_files_of_no_documents(spark):
    shards, folder, dictionary = token_files.write_token_files(empty(spark), JSON)
    assert token_files.read_token_files(spark, shards, folder, dictionary, np.dtype("<u2")).collect() == []


def test_other_tokenizers_take_whole_texts():
    tok = token_files.ChunkedTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert not tok.chunked
    text = "Some Words,  and more."
    got = np.frombuffer(tok.encode([text])[0], tok.dtype).tolist()
    assert got == tok.tok.encode(text, add_special_tokens=False).ids
