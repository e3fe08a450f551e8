import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from riskloom.llm import neardup, sharding, spans, vectors
from riskloom.llm.components import connected_components

from .helpers import awkward, awkward_rows, empty, words


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(1)
    path = list(range(1000, 1090))
    rng.shuffle(path)
    links = list(zip(path, path[1:])) + [(1, k) for k in range(2, 60)] + [(200, 201), (201, 202), (202, 200), (5, 5), (7, 1)]
    links += [(300 + rng.randrange(60), 300 + rng.randrange(60)) for _ in range(50)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    links = [x for x in links if x[0] != x[1]]
    assert got == components({x for pair in links for x in pair}, links)
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def shingles(text, n):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def near_case():
    rng = random.Random(3)
    rows, i = [], 0
    for _ in range(40):
        base = words(rng, rng.randrange(30, 160)).split()
        for _ in range(rng.randrange(1, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(9999)}"
            rows.append((i, " ".join(w)))
            i += 1
    hot = words(rng, 150).split()
    for _ in range(300):  # one large family, far and near
        w = list(hot)
        for _ in range(rng.randrange(0, 12)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
        i += 1
    rng.shuffle(rows)
    return rows


def check_near(rows, got, n, percent):
    sets = defaultdict(set)
    for i, t in rows:
        sets[shingles(t, n)].add(i)
    sets.pop(frozenset(), None)
    keys = list(sets)
    links = []
    for a in range(len(keys)):
        for b in range(a + 1, len(keys)):
            c = len(keys[a] & keys[b])
            if 100 * c >= percent * (len(keys[a]) + len(keys[b]) - c):
                links.append((a, b))
    root = components(range(len(keys)), links)
    least = defaultdict(list)
    for k, key in enumerate(keys):
        least[root[k]] += [i for i in sets[key] if i is not None]
    want = Counter()
    for i, t in rows:
        s = shingles(t, n)
        comp = i if not s else min(least[root[keys.index(s)]], default=None)
        want[(i, len(s), comp, i is not None and comp == i)] += 1
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want


def test_near_duplicates_equal_all_pairs(spark):
    rows = near_case()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for n, percent, region, block in ((3, 85, 64, 512), (5, 80, 8, 16)):
        p = neardup.ForestParams(shingle=n, percent=percent, region=region, block=block)
        check_near(rows, neardup.near_duplicates(docs, p).collect(), n, percent)


def test_pairs_of_a_crowd_below_the_threshold_meet(spark):
    rng = random.Random(9)
    core, rows = [f"c{k}" for k in range(154)], []
    for k in range(200):  # similarity 0.77 in the family, 0.806 within a pair
        shared = [f"s{k}_{j}" for j in range(4)]
        for c in (0, 1):
            w = core + shared + [f"o{k}_{c}_{j}" for j in range(19)]
            rng.shuffle(w)
            rows.append((2 * k + c, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    p = neardup.ForestParams(shingle=1, percent=80, trees=4, slack=0.3)  # few trees, so that every tree counts
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, p).collect()}
    assert all(got[i] in (i, i - i % 2) for i in got)
    missed = sum(got[2 * k] != got[2 * k + 1] for k in range(200))
    assert missed < 200 * 0.2, missed  # (1 - 0.806 ** 4) ** 4 is 0.11, (1 - 0.806 ** 8) ** 4 is 0.46


def test_near_duplicates_of_awkward_rows(spark):
    docs = awkward(spark).withColumn("node", F.lit(1)).withColumn("component_id", F.lit("x"))
    check_near([r[:2] for r in awkward_rows()], neardup.near_duplicates(docs).collect(), 5, 80)
    assert neardup.near_duplicates(empty(spark)).collect() == []


def test_one_of_each_group_stays(spark):
    docs = awkward(spark).withColumn("_key", F.lit(1))
    got = neardup.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in got.collect()]
    assert Counter(i for i, t in rows if t is None or not t.split()) == Counter([0, 1, 2, None])
    kept = [i for i, t in rows if t and t.split()]
    assert 3 in kept and not {4, 6, 8} & set(kept) and kept.count(5) == 1 and {7, 9, 10, 11, 12} <= set(kept)
    assert neardup.drop_near_duplicates(empty(spark)).collect() == []


def test_spans_remove_all_but_the_first(spark):
    rng = random.Random(8)
    passage = " ".join(words(rng, rng.randrange(6, 14)).capitalize() + "." for _ in range(7))
    rows = [(i, " ".join(words(rng, 12).capitalize() + "." for _ in range(rng.randrange(1, 8)))) for i in range(40)]
    clean = dict(rows[20:])
    for i in (3, 7, 11, 15):
        rows[i] = (i, rows[i][1] + "\n" + passage.upper() + "\n" + " ".join(words(rng, 9) + "." for _ in range(3)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("removed", F.lit(1)).withColumn("hash", F.lit("h"))
    got = {r.doc_id: r for r in spans.remove_repeats(docs).collect()}
    assert passage.upper() in got[3].text and got[3].n_removed == 0
    for i in (7, 11, 15):
        assert passage.upper()[:60] not in got[i].text and passage.upper()[-60:] not in got[i].text
        old = rows[i][1]
        assert got[i].text.startswith(old[:old.index("\n")]) and got[i].hash == "h"
        a, b = map(int, got[i].removed.split(":"))
        assert got[i].text.encode() == old.encode()[:a] + old.encode()[b:]
    assert all(got[i].text == t and got[i].removed == "" for i, t in clean.items())


def test_spans_of_awkward_rows(spark):
    got = spans.remove_repeats(awkward(spark)).collect()
    assert len(got) == len(awkward_rows())
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.text)
    base = awkward_rows()[3][1]
    assert by[0] == [None] and by[1] == [""] and by[7] == ["one"] and by[12] == ["x" * 200_000]
    assert by[None].count(base) == 1  # a null id comes first
    assert by[3] == [""] and by[4] == ["", ""]
    assert spans.remove_repeats(empty(spark)).collect() == []


def test_long_sentences_have_runs():
    import pyarrow as pa

    from riskloom.llm.textops import slices

    rng = random.Random(5)
    passage = " ".join(f"w{rng.randrange(9999)}" for _ in range(120))
    part = next(slices(pa.array([f"lead in {passage} and out", f"a quite other start {passage}"])))
    value, row, _, _ = spans.spans(spans.sentences(part, spans.SpanParams()), spans.SpanParams())
    assert set(value[row == 0]) & set(value[row == 1])


def test_passages_in_mid_sentence_have_runs():
    import pyarrow as pa

    from riskloom.llm.textops import slices

    p = spans.SpanParams()
    for seed in range(400):
        rng = random.Random(seed)
        size, every = rng.choice((46, 51, 60, 80)), rng.choice((7, 25, 999))
        draw = lambda k: [f"w{rng.randrange(rng.choice((12, 9999)))}" for _ in range(k)]
        passage = [w + "." * (k % every == every - 1) for k, w in enumerate(draw(size))]
        texts = [" ".join(draw(rng.randrange(60)) + passage + draw(rng.randrange(60))) for _ in range(2)]
        value, row, _, _ = spans.spans(spans.sentences(next(slices(pa.array(texts))), p), p)
        assert set(value[row == 0]) & set(value[row == 1]), (seed, size, every)


def test_a_passage_in_mid_sentence_is_removed(spark):
    rng = random.Random(6)
    draw = lambda k: [f"w{rng.randrange(9999)}" for _ in range(k)]
    for_seed = [(draw(51), draw(30), draw(30), draw(30), draw(30)) for _ in range(40)]
    rows = [(2 * k + c, " ".join([*t[1 + c], *t[0], *t[3 + c]])) for k, t in enumerate(for_seed) for c in (0, 1)]
    got = {r.doc_id: r for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k, t in enumerate(for_seed):
        left = got[2 * k + 1].text.split()
        assert got[2 * k].text == rows[2 * k][1] and len(left) <= 111 - 21
        assert left[:30] == t[2] and left[-30:] == t[4]


def check_shards(rows, shards=8):
    n = Counter(r.shard for r in rows)
    assert max(n.values()) - min(n.values() if len(n) == shards else [0]) <= 1
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))


def test_shards_are_even_and_keep_groups(spark):
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").when(
        F.col("id") % 7 < 3, F.concat(F.lit("g"), (F.col("id") % 20).cast("string"))).otherwise(F.concat(F.lit("é"), "id")).alias("text"))
    rows = sharding.shard_documents(docs).collect()
    check_shards(rows)
    groups = defaultdict(Counter)
    for r in rows:
        groups[(r.text_crc32, r.size)][r.shard] += 1
    small = [g for g in groups.values() if 1 < sum(g.values()) < 100]
    assert len(small) == 20 and sum(len(g) > 1 for g in small) <= 2
    hot = next(g for g in groups.values() if sum(g.values()) == 400)
    assert max(hot.values()) == 150  # a whole shard


def test_shards_of_awkward_rows(spark):
    rows = sharding.shard_documents(awkward(spark).withColumn("shard", F.lit(1))).collect()
    assert len(rows) == len(awkward_rows())
    check_shards(rows)
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len((t or "").encode()) + 1) for i, t, *_ in awkward_rows())
    assert sharding.shard_documents(empty(spark)).collect() == []


def test_rows_with_several_hubs_follow_most_neighbours(spark):
    members = [(i, f"a{i // 10}") for i in range(100)] + [(i, f"b{i % 2}") for i in range(0, 100, 9)]
    labels = sharding.propagate(spark.createDataFrame(members, "row bigint, hub string"), 1000)
    shard = {r.row: r.shard for r in labels.collect()}
    assert sum(len({shard[i] for i in range(g * 10, g * 10 + 10)}) == 1 for g in range(10)) >= 8


def vector_rows():
    g = np.random.default_rng(2)
    rows = []
    for i in range(60):
        base = g.standard_normal(16)
        for _ in range(1 + i % 5):
            rows.append((len(rows), (base + 0.18 * g.standard_normal(16)).tolist()))
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, [2 * x for x in rows[5][1]]), (1003, None), (1004, []), (1005, [0.0] * 16),
             (1006, [float("nan")] + [1.0] * 15), (1007, [float("inf")] * 16), (1008, [None] + [1.0] * 15), (1009, rows[0][1][:8]),
             (1010, [1e-200 * x for x in rows[7][1]]), (1011, [1e200 * x for x in rows[7][1]]), (1000, rows[9][1]), (None, rows[0][1])]
    return rows


def test_vector_links_equal_all_pairs(spark):
    rows = vector_rows()
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in good}
    unit = {k: u / np.linalg.norm(u) for k, u in unit.items()}
    links = [(a, b) for a in good for b in good if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    count, root = Counter(x for pair in links for x in pair), components(range(len(rows)), links)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[root[k]] += [i] if i is not None else []
    want = Counter((i, count[k], min(least[root[k]], default=None)) for k, (i, _) in enumerate(rows))
    for block in (4096, 40):
        frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("node", F.lit(1))
        got = vectors.link_vectors(frame, vectors.CollisionParams(block=block, order_recall=0.9999, count_recall=0.99999)).collect()
        assert Counter((r.vec_id, r.n_links, r.component_id) for r in got) == want
    assert vectors.link_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []


def test_vector_recall_at_the_threshold(spark):
    g = np.random.default_rng(1)
    n = 1500
    base = g.standard_normal((n, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = g.standard_normal((n, 64))
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = (0.9 + 1e-6) * base + np.sqrt(1 - (0.9 + 1e-6) ** 2) * other
    rows = [(i, base[i].tolist()) for i in range(n)] + [(n + i, near[i].tolist()) for i in range(n)]
    got = vectors.link_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"),
                               vectors.CollisionParams(block=300)).collect()
    assert sum(r.n_links > 0 for r in got) / len(got) > 0.97
