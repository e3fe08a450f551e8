"""SentencePiece: the agenda against the library."""

import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import pieces, queries

from .helpers import awkward, awkward_rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "   ", "▁", "▁▁a▁", "a▁b", " 　x", "\x00a\x00", "�", "<s> </s> <unk> <0x41>", "é" * 1000, "x" * 100_000,
       " " * 20_000, "日本語 テキスト", "😀 😀😀", "á", "\r\n\t", "ab " * 20_000, "▁▁" * 300, "a﻿b", "ab" * 30]


def ids_of(texts):
    vocab = pieces.vocabulary(MODEL)
    ids, at = pieces.encode_texts(vocab, texts)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_agenda_equals_library_on_odd_texts():
    draw = random.Random(3)
    texts = ODD + ["".join(draw.choice(" ▁ab\n日é😀.txe1") for _ in range(draw.randint(0, 60))) for _ in range(3000)]
    assert ids_of(texts) == pieces.vocabulary(MODEL).library.encode(texts)


def test_long_words_merge_as_short_ones(monkeypatch):
    texts = ["unbelievable internationalisation", "aaaa aaaaa aaaaaa", "the theatre " * 20]
    short = ids_of(texts)
    monkeypatch.setattr(pieces, "SHORT", 1)
    pieces.vocabulary(MODEL).forget()
    assert ids_of(texts) == short
    pieces.vocabulary(MODEL).forget()


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY_WORDS", 5)
    texts = [f"word{i} other{i} third{i}" for i in range(50)]
    got = [ids_of([t])[0] for t in texts]
    assert got == pieces.vocabulary(MODEL).library.encode(texts)
    assert len(pieces.vocabulary(MODEL).rows) <= 8


def test_ids_that_the_library_does_not_give_are_an_error(spark, monkeypatch):
    vocab = pieces.MergeVocabulary(MODEL)
    vocab.token = vocab.token.copy()
    vocab.token[vocab.names.index("▁the")] = 7
    texts = ["see an end", "see the end"]
    with pytest.raises(ValueError, match="see the end"):
        pieces.check_texts(vocab, texts, *pieces.encode_texts(vocab, texts))
    pieces.check_texts(vocab, texts[:1], *pieces.encode_texts(vocab, texts[:1]))


def test_without_byte_pieces_a_run_of_unknowns_is_one_id():
    vocab = pieces.MergeVocabulary(MODEL)
    vocab.bytes = None
    strange = chr(0x1F9FF)
    ids, at = pieces.encode_texts(vocab, [f"a{strange}{strange} b", strange])
    rows = [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    assert [r.count(vocab.unknown) for r in rows] == [1, 1]


def test_rows_nulls_ties_and_clashing_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world", "x"), (3, "Hello  world", "x"), (None, "é 日", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumn("decoded", F.lit(1))
    out = pieces.decode(pieces.encode(docs, MODEL, check_every=1), MODEL)
    assert set(out.columns) == set(docs.columns)
    found = [(r.text, list(r.ids), r.decoded) for r in out.orderBy("doc_id").collect() if r.text]
    library = pieces.vocabulary(MODEL).library
    assert [f[1] for f in found] == library.encode([f[0] for f in found])
    assert [f[2] for f in found] == [f[0] for f in found]
    assert [(list(r.ids), r.decoded) for r in out.where("coalesce(text, '') = ''").collect()] == [([], "")] * 2
    assert pieces.encode(docs.limit(0), MODEL).count() == 0
    assert pieces.encode(awkward(spark), MODEL, check_every=1).count() == len(awkward_rows())


def test_query_agrees_with_the_library_on_every_document(spark):
    sf_dir = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in queries.op11_agenda_pieces(spark, sf_dir).collect()}
    library = pieces.vocabulary(MODEL).library
    docs = queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()
    assert len(out) == len(docs)
    for doc in docs:
        ids = library.encode(doc.text or "")
        row = out[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_id_lists_skip_nulls_and_follow_slices():
    rows = pa.array([[1, 2], None, [], [3]], pa.list_(pa.int32()))
    assert pieces.id_lists(rows) == [[1, 2], [], [], [3]] and pieces.id_lists(rows.slice(1)) == [[], [], [3]]
    assert pieces.id_lists(rows.slice(0, 0)) == []
