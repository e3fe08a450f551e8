"""Ids and decoded text in one pass."""

from pyspark.sql import functions as F

from riskloom.llm import pieces, queries


def test_decoded_text_comes_with_the_ids(spark):
    model = queries.public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "a plain text"), (2, None), (3, ""), (4, "two  spaces é漢 " * 40)], "doc_id long, text string")
    for every in (1, 0):
        once = pieces.encode(docs, model, check_every=every, decoded="decoded")
        apart = pieces.decode(pieces.encode(docs, model, check_every=every), model)
        assert once.columns == apart.columns and sorted(map(str, once.collect())) == sorted(map(str, apart.collect()))
    query = queries.op11_agenda_pieces(spark, "/root/testdata/sf0.001")
    plan = query._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and query.where(F.col("n_tokens") > 0).count() > 0


def test_words_that_come_again_stay_in_a_full_memory(monkeypatch):
    monkeypatch.setattr(pieces, "MEMORY_WORDS", 8)
    vocab = pieces.MergeVocabulary(queries.public_tokenizers.path("piece_bpe_32k.model"))
    merged = []
    monkeypatch.setattr(vocab, "words_ids", lambda words, f=vocab.words_ids: merged.extend(words) or f(words))
    texts = [f"the theatre odd{i} rare{i}" for i in range(40)]
    for text in texts:
        ids, _ = pieces.encode_texts(vocab, [text])
        assert ids.tolist() == vocab.library.encode(text)
    assert len(vocab.rows) <= 12 and merged.count("▁theatre".encode()) == 1


def test_every_pair_is_found_by_its_hashes(monkeypatch):
    import numpy as np

    for sparse in (pieces.SPARSE, 4):  # with fewer places more pairs are in the second table
        monkeypatch.setattr(pieces, "SPARSE", sparse)
        vocab = pieces.MergeVocabulary(queries.public_tokenizers.path("piece_bpe_32k.model"))
        place, piece = vocab.pairs(vocab.merges // vocab.size, vocab.merges % vocab.size)
        assert (place == vocab.place).all() and (piece == vocab.merged).all()
        left, right = np.random.default_rng(1).integers(-5, vocab.size, (2, 50_000))
        known = [(a * vocab.size + b) in vocab.by_pair and a >= 0 and b >= 0 for a, b in zip(left.tolist(), right.tolist())]
        assert ((vocab.pairs(left, right)[0] < pieces.NONE) == known).all()
