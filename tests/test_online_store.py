"""The keyed online store and the dual write."""

import re

import pytest
from pyspark.sql import functions as F

from riskloom.session import work_dir
from riskloom.sources import online_store as O
from riskloom.sources.commits import committed
from riskloom.streaming import jobs as L

at = lambda seconds: F.timestamp_seconds(F.lit(seconds))


def rows(spark, items):
    """(id, count, expiry in seconds)"""
    made = spark.createDataFrame(items, "transaction_id string, n string, e bigint")
    return made.select("transaction_id", F.create_map(F.lit("txn_count_1hr"), "n", F.lit("customer_id"), F.lit("c")).alias("fields"),
                       F.timestamp_seconds("e").alias("expires_at"))


def live(spark, root, now):
    return {r.transaction_id: r.fields["txn_count_1hr"] for r in O.read_live(spark, root, at(now)).collect()}


def test_upsert_expiry_and_repetition(spark):
    root = work_dir(spark, "store")
    assert live(spark, root, 0) == {} and O.lookup(rows(spark, [("a", "1", 9)]), root, at(0)).collect()[0].found is False
    O.publish(rows(spark, [(f"t{i}", "1", 100 + i) for i in range(50)]), root, 0, at(0), buckets=4)
    O.publish(rows(spark, [("t1", "2", 300), ("t2", "0", 90), ("new", "7", 200), ("new", "8", 200), ("gone", "1", 100)]), root, 1, at(120))
    assert live(spark, root, 120) == {"t1": "2", "new": "8"} | {f"t{i}": "1" for i in range(21, 50)}
    before = live(spark, root, 0)
    O.publish(rows(spark, [("t1", "9", 999)]), root, 1, at(120))  # committed before: nothing happens
    assert live(spark, root, 0) == before
    with pytest.raises(ValueError):
        O.publish(rows(spark, [("t1", "9", 999)]), root, -1, at(120))


def test_lookup_reads_only_the_buckets_of_its_ids(spark, monkeypatch):
    root = work_dir(spark, "store")
    O.publish(rows(spark, [(f"t{i}", str(i), 500) for i in range(2000)]), root, 0, at(0), buckets=32)
    ids = spark.createDataFrame([("t5",), ("t6",), ("nowhere",), ("t5",)], "transaction_id string")
    found = O.lookup(ids, root, at(10))
    assert sorted((r.transaction_id, r.found, r.txn_count_1hr) for r in found.collect()) == [
        ("nowhere", False, None), ("t5", True, 5), ("t5", True, 5), ("t6", True, 6)]
    read = {re.search(r"bucket=(\d+)", f).group(1) for f in found.inputFiles()}
    wanted = {str(r.b) for r in ids.select(O.bucket_of(32).alias("b")).collect()}
    assert read <= wanted and len(read) <= 3
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*In\(transaction_id", plan)
    monkeypatch.setattr(O, "LISTED_IDS", 1)  # more ids than are listed: joined, same result
    assert sorted(map(str, O.lookup(ids, root, at(10)).collect())) == sorted(map(str, found.collect()))


def test_bucket_that_empties(spark):
    root = work_dir(spark, "store")
    O.publish(rows(spark, [("a", "1", 10)]), root, 0, at(0), buckets=1)
    O.publish(rows(spark, [("a", "2", 5)]), root, 1, at(50))
    assert live(spark, root, 0) == {}


def features(spark, ids):
    from riskloom.schemas import FEATURE_TYPES

    columns = [F.lit(1).cast(t).alias(n) for n, t in FEATURE_TYPES.items()]
    return spark.createDataFrame([(i, "c") for i in ids], "transaction_id string, customer_id string").select(
        "*", *columns, F.lit("1").alias("feature_version"))


def test_a_failure_between_the_writes_leaves_neither_visible(spark, monkeypatch):
    root, now = work_dir(spark, "dual"), at(1000)
    L.atomic_dual_write(features(spark, ["a"]), 0, root, now)
    whole = L.merge_online

    def broken(*args, **more):
        whole(*args, **more)
        raise RuntimeError("lost")

    monkeypatch.setattr(L, "merge_online", broken)
    with pytest.raises(RuntimeError):
        L.atomic_dual_write(features(spark, ["b", "a"]), 1, root, now)
    both = lambda: (sorted(r.transaction_id for r in L.read_offline(spark, root).collect()),
                    sorted(r.transaction_id for r in O.read_live(spark, root, now).collect()))
    assert both() == (["a"], ["a"]) and committed(spark, root) == [0]
    monkeypatch.setattr(L, "merge_online", whole)
    L.atomic_dual_write(features(spark, ["b", "a"]), 1, root, now)
    assert both() == (["a", "a", "b"], ["a", "b"])
    L.atomic_dual_write(features(spark, ["c"]), 1, root, now)
    assert both() == (["a", "a", "b"], ["a", "b"])
