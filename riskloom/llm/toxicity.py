"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A word's input is the sum of a word vector (hashed) and the mean vector of its character n-grams (hashed, with marks for
where a word begins and ends). Texts are scored by all their overlapping windows, one beginning at every word from which a
whole window fits (a text of fewer words is one window); a text's logit is its worst window's, calibrated with the number
of windows. Training follows the same rule: the gradient flows through the worst window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.quality import KINDS as BYTE_KINDS
from riskloom.llm.staging import bounded_collect, stage
from riskloom.llm.textops import Slice, Words, lower_ascii, mix, run_hashes, runs, slices

#: Only letters make words here.
KINDS = (BYTE_KINDS == 1).astype(np.uint8)


@dataclass(frozen=True)
class GruParams:
    """``max_positive`` and ``max_negative`` labelled rows, and ``max_train_chars`` characters of them, are expected in the
    sample for the fit; scoring covers every row and whole texts. ``window`` is a number of words."""

    width: int = 8
    hidden: int = 8
    attention: int = 8
    word_bits: int = 16
    gram_bits: int = 17
    grams: tuple[int, ...] = (3, 4, 5, 6)
    window: int = 8
    epochs: int = 4
    batch: int = 64
    rate: float = 0.01
    max_positive: int = 1500
    max_negative: int = 3000
    max_train_chars: int = 8_000_000
    seed: int = 23


@dataclass
class WordTable:
    """The distinct words of some rows: slots of their vectors, and every row as places in this table."""

    word: np.ndarray
    grams: np.ndarray
    gram_starts: np.ndarray
    place: np.ndarray
    row_starts: np.ndarray


def word_table(part: Slice, p: GruParams) -> WordTable:
    data = lower_ascii(part.data)
    words = runs(part, KINDS[data])
    distinct, first, place = np.unique(run_hashes(data, words), return_index=True, return_inverse=True)
    return gram_table(data, words, distinct, first, place, p)


def gram_table(data: np.ndarray, words: Words, distinct: np.ndarray, first: np.ndarray, place: np.ndarray, p: GruParams) -> WordTable:
    """Slots of the distinct words; ``first`` says where each is found."""
    starts, ends = words.starts[first], words.ends[first]
    # Bytes of the distinct words one after another, each between two marks.
    size = ends - starts + 2
    at = np.cumsum(size) - size
    total = int(size.sum())
    owner = np.repeat(np.arange(len(first)), size)
    inside = np.arange(total) - at[owner]
    text = np.zeros(total, np.uint64)
    letter = (inside > 0) & (inside < size[owner] - 1)
    text[letter] = data[(starts[owner] + inside - 1)[letter]]
    left = size[owner] - inside  # bytes up to the end of the word and its mark
    slots, owners = [], []
    rolled = np.zeros(total, np.uint64)
    for n in range(1, max(p.grams) + 1):
        if n > total:
            break
        rolled = rolled[:total - n + 1] * np.uint64(0x100000001B3) + text[n - 1:] + np.uint64(1)
        if n in p.grams:
            whole = np.flatnonzero(left[:total - n + 1] >= n)
            slots.append((mix(rolled[whole] + np.uint64(n)) >> np.uint64(64 - p.gram_bits)).astype(np.int64))
            owners.append(owner[whole])
    own = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(own, kind="stable")
    grams = np.concatenate(slots)[order] if slots else np.zeros(0, np.int64)
    return WordTable((distinct >> np.uint64(64 - p.word_bits)).astype(np.int64), grams,
                     np.searchsorted(own[order], np.arange(len(first) + 1)), place, words.row_starts)


class KnownWords:
    """Input vectors of words met before, by hash; dropped when full, so a task's memory stays bounded."""

    def __init__(self, net: ToxicityNet, most: int = 300_000):
        self.net, self.most = net, most
        self.keys, self.vectors = np.zeros(0, np.uint64), np.zeros((0, net.p.width), np.float32)

    def inputs(self, part: Slice) -> tuple[WordTable, np.ndarray]:
        """The rows as places in a table of vectors, and that table; slots are left out."""
        data = lower_ascii(part.data)
        words = runs(part, KINDS[data])
        distinct, first, place = np.unique(run_hashes(data, words), return_index=True, return_inverse=True)
        none = np.zeros(0, np.int64)
        if len(self.keys) > self.most:
            self.keys, self.vectors = self.keys[:0], self.vectors[:0]
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        if len(new):
            fresh = self.net.inputs(gram_table(data, words, distinct[new], first[new], none, self.net.p))
            self.keys = np.insert(self.keys, at[new], distinct[new])
            self.vectors = np.insert(self.vectors, at[new], fresh, axis=0)
            at = np.searchsorted(self.keys, distinct)
        return WordTable(none, none, none, place, words.row_starts), self.vectors[at]


def windows(row_starts: np.ndarray, p: GruParams) -> tuple[np.ndarray, np.ndarray]:
    """(first word, row) of all windows in the order of words: one from every word, as far as it fits into the row."""
    n = np.diff(row_starts)
    count = np.where(n == 0, 0, 1 + np.maximum(n - p.window, 0))
    row = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row_starts[row] + k, row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class ToxicityNet:
    """Parameters, forward pass and gradients; all arrays are 32-bit."""

    def __init__(self, p: GruParams):
        self.p = p
        draw = np.random.default_rng(p.seed)
        d, h, a = p.width, p.hidden, p.attention
        one = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"word": (0.05 * draw.standard_normal((1 << p.word_bits, d))).astype(np.float32),
                  "gram": (0.05 * draw.standard_normal((1 << p.gram_bits, d))).astype(np.float32),
                  "att": one(2 * h, a), "att0": np.zeros(a, np.float32), "pick": one(a),
                  "out": one(2 * h), "out0": np.full(1, -1.0, np.float32)}
        for side in "fb":
            self.w |= {f"in_{side}": one(d, 3 * h), f"in0_{side}": np.zeros(3 * h, np.float32), f"re_{side}": one(h, 3 * h)}
        self.platt = np.array([1.0, 0.0, 0.0])

    def inputs(self, t: WordTable) -> np.ndarray:
        """A vector per distinct word."""
        x = self.w["word"][t.word]
        if len(t.grams):
            size = np.diff(t.gram_starts)
            some = np.flatnonzero(size)
            sums = np.add.reduceat(self.w["gram"][t.grams], t.gram_starts[:-1][some])
            x[some] += sums / size[some, None]
        return x

    def forward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows (index: places in x, mask: 1 where there is a word); with ``keep``, what backward needs."""
        h, steps = self.p.hidden, index.shape[1]
        states, tape = [], {}
        for side in "fb":
            gates = x @ self.w[f"in_{side}"] + self.w[f"in0_{side}"]
            re = self.w[f"re_{side}"]
            state = np.zeros((len(index), h), np.float32)
            out = np.empty((steps, len(index), h), np.float32)
            saved = []
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                g, u = gates[index[:, t]], state @ re
                rz = _sigmoid(g[:, :2 * h] + u[:, :2 * h])
                r, z = rz[:, :h], rz[:, h:]
                n = np.tanh(g[:, 2 * h:] + r * u[:, 2 * h:])
                m = mask[:, t, None]
                new = state + m * (1 - z) * (n - state)
                if keep:
                    saved.append((t, state, r, z, n, u[:, 2 * h:]))
                state = out[t] = new
            states.append(out)
            tape[side] = saved
        both = np.concatenate(states, axis=2)  # steps, windows, 2h
        lit = np.tanh(both @ self.w["att"] + self.w["att0"])
        weight = lit @ self.w["pick"]
        weight = np.where(mask.T > 0, weight, -1e9)
        weight = np.exp(weight - weight.max(axis=0))
        weight *= mask.T
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        context = np.einsum("tb,tbh->bh", weight, both)
        logit = context @ self.w["out"] + self.w["out0"]
        return (logit, (both, lit, weight, context, tape)) if keep else logit

    def backward(self, x: np.ndarray, index: np.ndarray, mask: np.ndarray, saved: tuple, error: np.ndarray):
        """Gradients of sum(error * logit): of the shared weights, and of x."""
        h = self.p.hidden
        both, lit, weight, context, tape = saved
        grad = {"out": context.T @ error, "out0": error.sum(keepdims=True)}
        d_context = error[:, None] * self.w["out"]
        d_both = weight[:, :, None] * d_context
        d_weight = np.einsum("bh,tbh->tb", d_context, both)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
        grad["pick"] = np.einsum("tb,tba->a", d_score, lit)
        d_lit = d_score[:, :, None] * self.w["pick"] * (1 - lit * lit)
        grad["att"] = np.einsum("tbh,tba->ha", both, d_lit)
        grad["att0"] = d_lit.sum(axis=(0, 1))
        d_both = d_both + d_lit @ self.w["att"].T
        d_x = np.zeros_like(x)
        for k, side in enumerate("fb"):
            re = self.w[f"re_{side}"]
            d_re, d_gates = np.zeros_like(re), np.zeros((len(x), 3 * h), np.float32)
            d_state = np.zeros((len(index), h), np.float32)
            for t, state, r, z, n, un in reversed(tape[side]):
                d_new = d_state + d_both[t][:, k * h:(k + 1) * h]
                m = mask[:, t, None]
                d_n = d_new * m * (1 - z) * (1 - n * n)
                d_z = d_new * m * (state - n) * z * (1 - z)
                d_r = d_n * un * r * (1 - r)
                d_u = np.concatenate([d_r, d_z, d_n * r], axis=1)
                d_re += state.T @ d_u
                d_state = d_new * (1 - m * (1 - z)) + d_u @ re.T
                np.add.at(d_gates, index[:, t], np.concatenate([d_r, d_z, d_n], axis=1))
            grad |= {f"re_{side}": d_re, f"in_{side}": x.T @ d_gates, f"in0_{side}": d_gates.sum(axis=0)}
            d_x += d_gates @ self.w[f"in_{side}"].T
        return grad, d_x

    def window_logits(self, t: WordTable, first: np.ndarray, row: np.ndarray, x: np.ndarray, block: int = 2048) -> np.ndarray:
        """Logits of the windows of ``windows``, ``block`` at a time; only texts shorter than a window need a mask."""
        out = np.empty(len(first), np.float32)
        whole = t.row_starts[1:][row] - first >= self.p.window
        short = np.flatnonzero(~whole)
        for at in range(0, len(short), block):
            pick = short[at:at + block]
            out[pick] = self.forward(x, *self.window_words(t, first[pick], row[pick]))
        whole = np.flatnonzero(whole)
        gates = [x @ self.w[f"in_{side}"] + self.w[f"in0_{side}"] for side in "fb"]
        for at in range(0, len(whole), block):
            pick = whole[at:at + block]
            begin, end = first[pick[0]], first[pick[-1]] + self.p.window
            # Windows across the end of a row are computed along with the others and not used.
            place = t.place[begin:end]
            out[pick] = self.run_logits([np.ascontiguousarray(g[place].T) for g in gates])[first[pick] - begin]
        return out

    def run_logits(self, gates: list[np.ndarray]) -> np.ndarray:
        """Logits of the windows that begin at every word of a run; ``gates``: per side, 3h rows, a column per word.

        Step t of all windows is a slice of the gates, so the inputs are shared. sigmoid(v) = (1 + tanh(v / 2)) / 2.
        """
        h, steps = self.p.hidden, self.p.window
        n = gates[0].shape[1] - steps + 1
        states = {}
        for side, g in zip("fb", gates):
            half = np.repeat(np.array([0.5, 1], np.float32), [2 * h, h])
            g, re = g * half[:, None], np.ascontiguousarray((self.w[f"re_{side}"] * half).T)
            state = np.zeros((h, n), np.float32)
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                u = re @ state
                rz = np.add(g[:2 * h, t:t + n], u[:2 * h])
                np.tanh(rz, out=rz)
                rz += 1
                rz *= np.float32(0.5)
                new = np.multiply(rz[:h], u[2 * h:], out=u[2 * h:])
                new += g[2 * h:, t:t + n]
                np.tanh(new, out=new)
                state = state - new
                state *= rz[h:]
                state += new
                states[side, t] = state
        att, out = self.w["att"].T, self.w["out"]
        score, value = np.empty((steps, n), np.float32), np.empty((steps, n), np.float32)
        for t in range(steps):
            both = np.concatenate([states["f", t], states["b", t]])
            lit = att @ both
            lit += self.w["att0"][:, None]
            score[t] = self.w["pick"] @ np.tanh(lit, out=lit)
            value[t] = out @ both
        weight = np.exp(score - score.max(axis=0))
        return (weight * value).sum(axis=0) / weight.sum(axis=0) + self.w["out0"]

    def window_words(self, t: WordTable, first: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        word = first[:, None] + np.arange(self.p.window)
        mask = word < t.row_starts[1:][row][:, None]
        return t.place[np.minimum(word, len(t.place) - 1)], mask.astype(np.float32)

    def worst(self, part: Slice, known: KnownWords) -> tuple[np.ndarray, np.ndarray]:
        """Per row the largest window logit and the number of windows; a row without words has the bare bias."""
        t, x = known.inputs(part)
        first, row = windows(t.row_starts, self.p)
        count = np.bincount(row, minlength=part.rows)
        out = np.full(part.rows, float(self.w["out0"][0]) - 5.0)
        if len(first):
            logit = self.window_logits(t, first, row, x)
            some = np.flatnonzero(count)
            out[some] = np.maximum.reduceat(logit, (np.cumsum(count) - count)[some])
        return out, count

    def score(self, part: Slice, known: KnownWords) -> np.ndarray:
        logit, count = self.worst(part, known)
        a, b, c = self.platt
        return _sigmoid(a * logit + b + c * np.log1p(count))


def _odds(table_slots: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """Smoothed log-odds of rows that have a slot, clipped; the first coordinate of the vectors starts from it."""
    seen = np.zeros((2, size))
    for slots, label in zip(table_slots, labels):
        seen[int(label), slots] += 1
    share = max(labels.sum(), 1) / max((1 - labels).sum(), 1)
    return np.clip(np.log((seen[1] + 1) / (seen[0] * share + 1)), -3, 3)


def fit(texts: list[str | None], labels: list[int], p: GruParams = GruParams(), weights: tuple[float, float] = (1.0, 1.0)) -> ToxicityNet:
    """Trains with Adam; a fifth of the rows, by position, only calibrates the scores.

    ``weights`` are the rows that each gathered negative and positive stands for; they enter the calibration, so scores
    are probabilities over the corpus. Without rows of both labels the net stays untrained and scores the label's share.
    """
    net = ToxicityNet(p)
    y = np.array(labels, np.float64)
    if len(set(labels)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        net.platt = np.array([0.0, np.log(share / (1 - share)), 0.0])
        return net
    part = next(slices(pa.array(texts, pa.string()), 1 << 40))
    t = word_table(part, p)
    aside = np.arange(len(y)) % 5 == 4
    train = np.flatnonzero(~aside & (np.diff(t.row_starts) > 0))
    own = [np.unique(t.place[t.row_starts[i]:t.row_starts[i + 1]]) for i in range(len(y))]
    word_slots = [t.word[o] for o in own]
    gram_slots = [np.unique(np.concatenate([t.grams[t.gram_starts[k]:t.gram_starts[k + 1]] for k in o]))
                  if len(o) else np.zeros(0, np.int64) for o in own]
    net.w["word"][:, 0] = _odds([word_slots[i] for i in train], y[train], 1 << p.word_bits)
    net.w["gram"][:, 0] = _odds([gram_slots[i] for i in train], y[train], 1 << p.gram_bits)
    draw = np.random.default_rng(p.seed)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    turn = 0
    balance = np.where(y > 0, 0.5 / max(y[train].mean(), 1e-6), 0.5 / max(1 - y[train].mean(), 1e-6)).astype(np.float32)
    for epoch in range(p.epochs):
        order = draw.permutation(train)
        for at in range(0, len(order), p.batch):
            rows = order[at:at + p.batch]
            words, place = np.unique(np.concatenate([t.place[t.row_starts[i]:t.row_starts[i + 1]] for i in rows]), return_inverse=True)
            starts = np.append(0, np.cumsum((t.row_starts[1:] - t.row_starts[:-1])[rows]))
            small = _part_table(t, words, place, starts)
            x = net.inputs(small)
            first, row = windows(starts, p)
            logit = net.window_logits(small, first, row, x)
            bounds = np.searchsorted(row, np.arange(len(rows) + 1))
            worst = [a + int(np.argmax(logit[a:b])) for a, b in zip(bounds[:-1], bounds[1:])]
            index, mask = net.window_words(small, first[worst], row[worst])
            logit, saved = net.forward(x, index, mask, keep=True)
            error = ((_sigmoid(logit) - y[rows]) * balance[rows] / len(rows)).astype(np.float32)
            grad, d_x = net.backward(x, index, mask, saved, error)
            turn += 1
            grad["word"] = (small.word, d_x)
            size = np.diff(small.gram_starts)
            grad["gram"] = (small.grams, np.repeat(d_x / np.maximum(size, 1)[:, None], size, axis=0))
            _adam(net.w, moment, grad, turn, p.rate)
    logit, count = net.worst(part, KnownWords(net))
    _calibrate(net, logit[aside], count[aside], y[aside], weights)
    return net


def _part_table(t: WordTable, words: np.ndarray, place: np.ndarray, row_starts: np.ndarray) -> WordTable:
    """The table of some of the words, with rows of its own."""
    size = np.diff(t.gram_starts)[words]
    starts = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(starts[-1]) - np.repeat(starts[:-1], size) + np.repeat(t.gram_starts[words], size)
    return WordTable(t.word[words], t.grams[take], starts, place, row_starts)


def _adam(w: dict, moment: dict, grad: dict, turn: int, rate: float) -> None:
    """One step; of the two tables only the rows in use move."""
    for name, g in grad.items():
        m, v = moment[name]
        if isinstance(g, tuple):
            slots, back = np.unique(g[0], return_inverse=True)
            sums = np.stack([np.bincount(back, g[1][:, d], len(slots)) for d in range(g[1].shape[1])], axis=1).astype(np.float32)
            m[slots] = 0.9 * m[slots] + 0.1 * sums
            v[slots] = 0.999 * v[slots] + 0.001 * sums * sums
            w[name][slots] -= rate * (m[slots] / (1 - 0.9**turn)) / (np.sqrt(v[slots] / (1 - 0.999**turn)) + 1e-8)
        else:
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w[name] -= rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)


def _calibrate(net: ToxicityNet, logit: np.ndarray, count: np.ndarray, y: np.ndarray, weights: tuple[float, float]) -> None:
    """Logistic regression of the label on the logit and the logged number of windows (Newton steps, slightly ridged)."""
    x = np.stack([logit, np.ones_like(logit), np.log1p(count)], axis=1).astype(np.float64)
    k = np.where(y > 0, weights[1], weights[0])
    k = k * len(y) / max(k.sum(), 1e-9)
    prior = np.array([1.0, 0.0, 0.0])
    ridge = np.array([0.05, 0.05, 0.5])
    beta = prior.copy()
    for _ in range(50):
        q = _sigmoid(np.clip(x @ beta, -30, 30))
        slope = x.T @ (k * (q - y)) + ridge * (beta - prior)
        curve = (x * (k * q * (1 - q) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        beta = beta - np.clip(np.linalg.solve(curve, slope), -2, 2)
    net.platt = beta


def train_toxicity(docs: DataFrame, labels: DataFrame, train_on: Column, label_col: str = "toxic", p: GruParams = GruParams()) -> ToxicityNet:
    """Fits on labelled rows for which ``train_on`` (over the labels) holds.

    Of each class a share is drawn by a hash of the id, whatever the length of the texts, such that ``max_positive`` and
    ``max_negative`` rows are expected; where these have more than ``max_train_chars`` in all, a share of them is drawn by a
    second hash. The rows drawn are used as whole texts, all windows of them. Null labels, ids and texts are left out.
    """
    usable = (labels.where(train_on & F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
              .groupBy("doc_id").agg((F.max(label_col) > 0).cast("int").alias("_label")))
    sizes = {r["_label"]: r["n"] for r in usable.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    room = {0: p.max_negative, 1: p.max_positive}
    share = {c: min(1.0, room[c] / max(sizes.get(c, 0), 1)) for c in room}
    draw = lambda seed: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    wanted = usable.where(draw(p.seed) < F.when(F.col("_label") == 1, share[1]).otherwise(share[0]))
    sample = stage(docs.select("doc_id", "text").where("text IS NOT NULL")
                   .join(F.broadcast(wanted), "doc_id")  # about max_positive + max_negative ids
                   .groupBy("doc_id").agg(F.max("text").alias("text"), F.max("_label").alias("_label")), "toxic_sample")
    chars = sample.agg(F.sum(F.length("text"))).head()[0] or 0
    sample = sample.where(draw(p.seed + 1) < min(1.0, p.max_train_chars / max(chars, 1)))
    rows = bounded_collect(sample, 2 * (p.max_negative + p.max_positive) + 1000)
    rows.sort(key=lambda r: r.doc_id)
    got = [sum(r["_label"] == c for r in rows) for c in (0, 1)]
    stands = tuple(sizes.get(c, 0) / max(got[c], 1) for c in (0, 1))
    return fit([r.text for r in rows], [r["_label"] for r in rows], p, stands)


def score_toxicity(docs: DataFrame, net: ToxicityNet, threshold: float, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """Adds the score (0 to 1) of every whole text over all its windows, and 1 where it reaches ``threshold``.

    Null and empty texts, and texts without letters, have no window and get the score that belongs to none. Existing
    columns of the two names are replaced; all others stay. Nothing is shuffled.
    """
    kept = [c for c in docs.columns if c not in (score_col, predicted_col)]
    schema = T.StructType([docs.schema[c] for c in kept] + [
        T.StructField(score_col, T.DoubleType(), False), T.StructField(predicted_col, T.IntegerType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(net)  # 6 MB: the two tables of vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        known = KnownWords(net)
        for batch in batches:
            parts = [net.score(part, known) for part in slices(batch.column("text"))]
            score = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(score.astype(np.float64)), pa.array((score >= threshold).astype(np.int32))],
                names=[*kept, score_col, predicted_col])

    return docs.select(*kept).mapInArrow(run, schema)
