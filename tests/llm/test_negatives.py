"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import negatives
from riskloom.llm.negatives import MiningParams

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def plain(rows, every=5, p=MiningParams()):
    usable = {}
    for vec, e, label in rows:
        if vec is None or label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        own = (label, [math.floor(x * p.scale) for x in e])
        usable[vec] = min(usable.get(vec, own), own)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (la, ea) in usable.items():
        if a % every:
            continue
        score = sorted((-dot(ea, e), v, la == lb) for v, (lb, e) in usable.items() if v != a)
        for ps, pv, same in [s for s in score if s[2]][:p.positives]:
            fit = [(ns, nv) for ns, nv, s in score if not s and 50 * -ps <= 100 * -ns <= 95 * -ps]
            out += [(a, pv, r, nv, -ps, -ns) for r, (ns, nv) in enumerate(fit[:p.negatives], 1)]
    return sorted(out)


def mined(spark, rows, every=5, p=MiningParams()):
    made = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % every == 0, p)
    return sorted(tuple(r) for r in made.collect())


def some(seed, n, dims, labels):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(labels, dims))
    rows = []
    for i in range(n):
        label = int(draw.integers(labels))
        v = centres[label] * draw.uniform(0, 1.2) + draw.normal(size=dims) * draw.choice([0.1, 1.0, 3.0])
        rows.append((i, (v / (np.linalg.norm(v) if i % 3 else 1)).tolist(), label))
    return rows


@pytest.mark.parametrize("seed", range(40))
def test_threshold_join_finds_exactly_the_pairs(seed):
    draw = np.random.default_rng(seed)
    d, band = int(draw.integers(0, 40)), int(draw.integers(1, 9))
    scale = draw.uniform(0.01, 1, d) * 100
    a, x = ((draw.normal(size=(n, d)) * scale * draw.choice([0, 0.1, 1, 1], (n, 1))).astype(np.int64) for n in (13, 57))
    product = a @ x.T
    t = np.quantile(product, draw.uniform(0, 1, 13), axis=1).diagonal().astype(np.int64) if d else np.array([0, 1] * 6 + [0])
    allowed = draw.random((13, 57)) < 0.7
    i, j, s = negatives.threshold_join(a, x, t, allowed, band)
    assert sorted(zip(i.tolist(), j.tolist())) == [(i, j) for i in range(13) for j in range(57) if allowed[i, j] and product[i, j] >= t[i]]
    assert (product[i, j] == s).all()


def test_products_beyond_doubles_are_exact():
    a, x = np.array([[3 * 10**8, 1]]), np.array([[3 * 10**8, 1], [3 * 10**8, 0]])
    i, j, s = negatives.threshold_join(a, x, np.array([9 * 10**16 + 1]), np.ones((1, 2), bool), 1)
    assert (j.tolist(), s.tolist()) == ([0], [9 * 10**16 + 1])


def test_results_equal_all_pairs_in_small_blocks(spark):
    rows = some(1, 400, 20, 4)
    assert mined(spark, rows, p=MiningParams(anchor_block=30, row_block=64, band=4)) == plain(rows)


def test_hot_copies_ties_few_rows_and_nulls(spark):
    rows = some(2, 90, 6, 3) + [(1000 + i, [0.5] * 6, 1) for i in range(200)]  # most rows are copies of one vector
    rows += [(5000, None, 1), (5005, [0.5] * 6, None), (5010, [0.5, None, 0.1], 1), (5015, [0.5, float("nan")], 1), (None, [0.5] * 6, 1),
             (5020, [float("inf")], 2), (5025, [], 1), (5030, [0.0] * 6, 1), (5035, [0.3, 0.9], 2), (5040, [0.1] * 6, 77),
             (5045, [-0.5] * 6, 1), (20, [0.4] * 6, 1), (20, [0.4] * 6, 1)]
    got = mined(spark, rows)
    assert got == plain(rows) and got


def test_empty_tables_and_clashing_columns(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 0)]) == [] and mined(spark, [(0, [1.0], 0)]) == []
    rows = some(3, 60, 5, 2)
    more = spark.createDataFrame(rows, SCHEMA)
    for name in ("anchor_id", "want", "wants", "t", "lo", "hi", "i", "j", "side", "id", "v", "rank", "score"):
        more = more.withColumn(name, F.lit("own"))
    assert sorted(tuple(r) for r in negatives.hard_negatives(more, F.col("vec_id") % 5 == 0).collect()) == plain(rows)
