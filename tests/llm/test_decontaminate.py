import random
import re

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import decontaminate as D

from .helpers import awkward, awkward_rows, empty

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=10):
    w, hit, found = split(text), set(), set()
    for item, own in items:
        v = split(own)
        k = min(window, len(v))
        if not k:
            continue
        wins = {tuple(v[i:i + k]) for i in range(len(v) - k + 1)}
        for i in range(len(w) - k + 1):
            if tuple(w[i:i + k]) in wins:
                found.add(str(item))
                hit |= set(range(i, i + k))
    return len(w), len(hit), sorted(found)


def case():
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randrange(1, 40))) for i in range(25)] + [(90, ""), (91, None), (None, "w1 w2"), (92, "solo"), (92, "Solo!")]
    items += [(93, items[0][1]), (94, items[1][1] + " " + text(5))]
    docs = []
    for i in range(150):
        parts = [text(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            v = split(rng.choice(items[:25])[1])
            a = rng.randrange(len(v))
            parts += [rng.choice([", ", " - ", "\n"]).join(v[a:a + rng.randrange(1, 30)]).upper(), text(rng.randrange(0, 9))]
        docs.append((i, " ".join(parts)))
    return docs + [(900, None), (901, ""), (902, "solo"), (902, "solo"), (None, items[0][1])], items


def test_hits_equal_a_window_search(spark):
    docs, items = case()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("items", F.lit(1)).withColumn("item_id", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    usable = [(i, t) for i, t in items if i is not None]
    got = D.match_documents(frame, bench).collect()
    assert len(got) == len(docs) and got[0].item_id == "x"
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == brute(r.text, usable)


def test_blocks_of_items_add_up(spark, monkeypatch):
    docs, items = case()
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(D, "BLOCK_BYTES", 600)
    usable = [(i, t) for i, t in items if i is not None]
    for r in D.match_documents(frame, bench).collect():
        assert (r.n_words, r.n_hit, r["items"]) == brute(r.text, usable)


def test_longest_match_and_place(spark):
    bench = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(30)))], "item_id bigint, text string")
    doc = "a b " + " ".join(f"q{i}" for i in range(5, 25)) + " c " + " ".join(f"q{i}" for i in range(12))
    r = D.match_documents(spark.createDataFrame([(1, doc)], "doc_id bigint, text string"), bench).first()
    assert (r.longest_words, r.longest_item, r.longest_at) == (20, "1", 2)
    assert r.hit_spans == [2, 22, 23, 35]


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x = np.append(rng.integers(0, 4, rng.integers(1, 60)), 0)
        order = D.suffix_array(x, len(x))
        assert [tuple(x[i:]) for i in order] == sorted(tuple(x[i:]) for i in range(len(x)))


def test_awkward_rows_and_empty_tables(spark):
    bench = spark.createDataFrame([("b", awkward_rows()[3][1][:200])], "item_id string, text string")
    got = D.match_documents(awkward(spark), bench).collect()
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == brute(r.text, [("b", awkward_rows()[3][1][:200])])
    none = spark.createDataFrame([], "item_id string, text string")
    assert D.drop_contaminated(awkward(spark), none).count() == len(awkward_rows())
    assert D.drop_contaminated(empty(spark), bench).collect() == []
    assert D.drop_contaminated(awkward(spark), bench).columns == awkward(spark).columns
