"""The prefix trie against a plain loop."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from riskloom.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            key = tuple(turns[:d])
            members[key].append(c)
            if d:
                children[key[:-1]].add(key)
        ends[tuple(turns)].append(c)
    total = {}
    for key in sorted(members, key=len, reverse=True):
        saved = (len(members[key]) - 1) * len(key[-1][1].encode()) if key else 0
        below = [total[k] for k in children[key]]
        total[key] = (sum(x for x, _ in below) or 1, saved + sum(s for _, s in below))
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), *total[k],
                   hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


def made(spark, rows, height=trie.HEIGHT, schema=SCHEMA):
    out = trie.prefix_trie(*trie.share_heads(trie.order_turns(spark.createDataFrame(rows, schema))), height)
    return sorted(tuple(r) for r in out.collect())


def some(seed, convs, longest, words):
    draw = random.Random(seed)
    return [(c, t, draw.choice(["user", "assistant"]), draw.choice(words)) for c in convs for t in range(draw.randint(1, longest))]


def awkward():
    rows = some(1, range(-12, 60), 9, ["a", "b", "é"])
    rows += [(3, None, "user", None), (4, None, None, ""), (None, 1, "user", "lost"), (7, 0, "user", "a"), (7, 0, "user", "a"),
             (7, 0, "user", "b"), (61, 0, "", "user"), (62, 0, "user", ""), (10**12, 0, "user", "x" * 50_000), (10**12 + 1, 5, "user", "y")]
    return rows


@pytest.mark.parametrize("height", [2, 4])
def test_nodes_equal_a_plain_loop(spark, height):
    assert made(spark, awkward(), height) == plain(awkward())


def test_long_and_hot_conversations(spark):
    """One conversation with most rows, many equal ones, and more levels of bands than one."""
    rows = [(5, t, "user", f"t{t % 3}") for t in range(300)] + [(6, t, "user", f"t{t % 3}") for t in range(250)]
    rows += [(c, t, "user", "same") for c in range(100, 5300) for t in range(2)]
    assert made(spark, rows, 3) == plain(rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    lonely = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    assert made(spark, [(lonely, 0, "user", "gone")]) == [
        (lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())]


def test_empty_table_and_clashing_columns(spark):
    assert made(spark, []) == []
    rows = awkward()
    more = spark.createDataFrame(rows, SCHEMA)
    for name in ("pos", "i", "k1", "k2", "path", "part", "content", "n_bytes", "n_turns", "base", "h", "band"):
        more = more.withColumn(name, F.lit("own"))
    out = trie.prefix_trie(*trie.share_heads(trie.order_turns(more)))
    assert sorted(tuple(r) for r in out.collect()) == plain(rows)
