import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskloom.llm import quality, toxicity
from riskloom.llm.textops import slices

from .helpers import awkward, awkward_rows, empty, words

SMALL = toxicity.GruParams(epochs=3, word_bits=12, gram_bits=13)


def labelled(rng, n, mark):
    """Texts of label 1 hold one of a few words that ``mark`` makes; unseen forms of them share its letters."""
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        w = words(rng, rng.randrange(20, 120)).split()
        for _ in range(rng.randrange(1, 4) if y else 0):
            w.insert(rng.randrange(len(w)), mark(rng))
        rows.append((i, " ".join(w), y))
    return rows


def accuracy(score, rows, at=0.5):
    return np.mean([(s >= at) == bool(r[2]) for s, r in zip(score, rows)])


def test_quality_held_out_accuracy():
    rng = random.Random(1)
    rows = labelled(rng, 700, lambda r: r.choice(["fine*** ", "good%%%"]))
    model = quality.fit([r[1] for r in rows[:500]], [r[2] for r in rows[:500]])
    score = np.concatenate([model.score(s) for s in slices(pa.array([r[1] for r in rows[500:]]))])
    assert accuracy(score, rows[500:]) > 0.95


def test_quality_score_is_the_sparse_dot_product():
    rng = random.Random(2)
    rows = labelled(rng, 60, lambda r: "ok ok ok")
    model = quality.fit([r[1] for r in rows], [r[2] for r in rows])
    texts = [r[1] for r in rows] + ["", None, "one"]
    score = np.concatenate([model.score(s) for s in slices(pa.array(texts, pa.string()), 300)])
    for (slot, value), s in zip(quality.examples(texts, model.params), score):
        assert s == pytest.approx(1 / (1 + np.exp(-(model.bias + model.weights[slot] @ value))), abs=1e-12)


def test_toxicity_gradient_matches_differences():
    p = toxicity.GruParams(width=3, hidden=2, attention=3, word_bits=4, gram_bits=4, window=5)
    net = toxicity.ToxicityNet(p)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    g = np.random.default_rng(0)
    x, index = g.standard_normal((6, 3)), g.integers(0, 6, (4, 5))
    mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 0, 0, 0, 0], [1, 1, 1, 1, 0]], np.float64)
    error = g.standard_normal(4)
    _, saved = net.forward(x, index, mask, keep=True)
    grad, d_x = net.backward(x, index, mask, saved, error)

    def slope(array, at):
        old, out = array[at], []
        for step in (1e-3, -1e-3):  # states are kept in 32 bits
            array[at] = old + step
            out.append(float(error @ net.forward(x, index, mask)))
        array[at] = old
        return (out[0] - out[1]) / 2e-3

    for name in ("out", "out0", "att", "att0", "pick", "in_f", "in0_f", "re_f", "in_b", "in0_b", "re_b"):
        for at in list(np.ndindex(net.w[name].shape))[:6]:
            assert grad[name][at] == pytest.approx(slope(net.w[name], at), abs=2e-3), name
    for at in np.ndindex(x.shape):
        assert d_x[at] == pytest.approx(slope(x, at), abs=2e-3)


def test_windows_begin_at_every_word():
    p = toxicity.GruParams(window=8)
    starts = np.array([0, 0, 3, 11, 31, 32])
    first, row = toxicity.windows(starts, p)
    assert list(zip(first, row)) == [(0, 1), (3, 2)] + [(k, 3) for k in range(11, 24)] + [(31, 4)]


def test_runs_of_windows_equal_single_windows():
    net = toxicity.ToxicityNet(toxicity.GruParams(word_bits=8, gram_bits=8, window=5))
    starts = np.array([0, 3, 3, 60, 65, 66, 300])
    g = np.random.default_rng(4)
    none = np.zeros(0, np.int64)
    t = toxicity.WordTable(none, none, none, g.integers(0, 40, 300), starts)
    x = g.standard_normal((40, 8)).astype(np.float32)
    first, row = toxicity.windows(starts, net.p)
    one_by_one = net.forward(x, *net.window_words(t, first, row))
    for block in (7, 64, 10_000):
        assert np.allclose(net.window_logits(t, first, row, x, block), one_by_one, atol=1e-5)


def test_toxic_phrases_are_found_at_every_offset():
    """A text's logit is at least that of any window, so a phrase counts the same wherever it stands."""
    rng = random.Random(6)
    phrase = "you zonk of a blarg".split()
    net = toxicity.fit(*zip(*[(r[1], r[2]) for r in labelled(rng, 600, lambda r: r.choice(["zonk", "blarg"]))]), SMALL)
    clean = words(rng, 120).split()
    texts = [" ".join(clean[:k] + phrase + clean[k:]) for k in range(121)] + [" ".join(clean)]
    score = np.concatenate([net.score(s, toxicity.KnownWords(net)) for s in slices(pa.array(texts))])
    assert score[:-1].min() > 0.7 and score[-1] < 0.3


def test_toxicity_trains_on_long_texts_too(spark):
    """The draw is by hash whatever the length; a sample beyond the characters wanted is thinned, not cut by length."""
    rng = random.Random(9)
    rows = []
    for i in range(120):
        w = words(rng, 1500).split()
        w.insert(rng.randrange(len(w)), "zonk" if i % 2 else "plain")
        rows.append((i, " ".join(w), i % 2))
    assert min(len(r[1]) for r in rows) > 5000
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, y int")
    p = replace(SMALL, epochs=40, batch=16, max_train_chars=sum(len(r[1]) for r in rows) * 2 // 3)
    net = toxicity.train_toxicity(docs, labels, F.lit(True), "y", p)
    out = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, net, 0.5).collect()}
    assert sum(out[i] == y for i, _, y in rows) >= 110


def test_toxicity_learns_words_and_letters():
    rng = random.Random(3)
    ends = ["ade", "ick", "oom", "urn", "ast", "ent", "ilk", "ore"]
    rows = labelled(rng, 700, lambda r: r.choice(["zonk", "Blarg!", "qvex" + r.choice(ends)]))
    net = toxicity.fit([r[1] for r in rows], [r[2] for r in rows], SMALL)
    test = labelled(rng, 200, lambda r: r.choice(["zonk", "BLARG", "qvexum"]))  # an ending never seen
    score = np.concatenate([net.score(s, toxicity.KnownWords(net)) for s in slices(pa.array([r[1] for r in test]))])
    assert accuracy(score, test) > 0.93


def test_scores_do_not_depend_on_slices_or_known_words():
    net = toxicity.ToxicityNet(SMALL)
    texts = [r[1] for r in awkward_rows()]
    whole = np.concatenate([net.score(s, toxicity.KnownWords(net)) for s in slices(pa.array(texts, pa.string()), 1 << 30)])
    known = toxicity.KnownWords(net, most=20)
    parts = np.concatenate([net.score(s, known) for s in slices(pa.array(texts, pa.string()), 400)])
    assert np.allclose(whole, parts, atol=1e-5)


@pytest.mark.parametrize("kind", ["quality", "toxicity"])
def test_frames_of_awkward_rows(spark, kind):
    docs = awkward(spark).withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 140)] + [(None, 1), (3, None), (3, 1), (3, 0)], "doc_id bigint, y int")
    if kind == "quality":
        model = quality.train_quality(docs, labels, F.lit(True), "y")
        out = quality.score_quality(docs, model, 0.3)
        none = quality.score_quality(empty(spark), quality.train_quality(empty(spark), labels, F.lit(True), "y"), 0.3)
    else:
        model = toxicity.train_toxicity(docs, labels, F.lit(True), "y", SMALL)
        out = toxicity.score_toxicity(docs, model, 0.7)
        none = toxicity.score_toxicity(empty(spark), toxicity.train_toxicity(empty(spark), labels, F.lit(True), "y", SMALL), 0.7)
    rows = out.collect()
    assert len(rows) == len(awkward_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.3 if kind == "quality" else 0.7)) for r in rows)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "predicted"]
    assert none.collect() == []


def test_quality_trains_on_long_texts_too(spark):
    """The draw is by hash whatever the length; a sample beyond the characters wanted is thinned, not cut by length."""
    rng = random.Random(8)
    rows = [(i, words(rng, 4000 if i % 2 else 3) + (" zzz" if i % 2 else " qqq"), i % 2) for i in range(80)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, y int")
    p = quality.FtrlParams(max_train_chars=sum(len(r[1]) for r in rows) // 2)
    model = quality.train_quality(docs, labels, F.lit(True), "y", p)
    out = {r.doc_id: r.predicted for r in quality.score_quality(docs, model, 0.5).collect()}
    assert sum(out[i] == y for i, _, y in rows) >= 76
