"""Trailing windows against a sequential loop, and the closed-form feature cases."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.functions.geo import haversine_km
from riskloom.operators.entities import linked_counts, linked_counts_as_of, merchant_risk
from riskloom.operators.features import amount_zscore, is_first_seen
from riskloom.operators.trailing import Trailing, trailing

S = 1_000_000


def loop(rows, key, seconds):
    """Row by row in (us, id) order: count, sum, max and distinct devices of the window."""
    out, seen = {}, []
    for row in sorted(rows, key=lambda r: (r["us"], r["id"])):
        seen.append(row)
        win = [r for r in seen if r[key] == row[key] and r["us"] >= row["us"] - seconds * S]
        out[row["id"]] = (len(win), sum(r["v"] for r in win), max(r["v"] for r in win),
                          len({r["dev"] for r in win}))
    return out


def make_rows(n, seed, hot_share=0.5, span=20_000):
    rnd = random.Random(seed)
    return [{"id": f"t{i:04d}", "cust": "hot" if rnd.random() < hot_share else f"c{rnd.randint(0, 4)}",
             "us": rnd.randint(0, span) * S + rnd.choice([0, 0, 1]), "v": rnd.randint(1, 500),
             "dev": f"d{rnd.randint(0, 5)}"} for i in range(n)]


@pytest.mark.parametrize("seconds,slice_seconds", [(60, 3600), (3600, 3600), (7200, 3600), (14400, 3600), (60, 60)])
def test_trailing_matches_sequential_loop(spark, seconds, slice_seconds):
    rows = make_rows(400, seconds, span=20_000 if seconds > 60 else 900)
    specs = [Trailing("n", "count", None, seconds), Trailing("s", "sum", "v", seconds)]
    short = seconds <= slice_seconds
    if short:
        specs.append(Trailing("u", "nunique", "dev", seconds))
    if seconds % slice_seconds == 0:
        specs.append(Trailing("m", "max", "v", seconds))
    got = trailing(spark.createDataFrame(rows), "cust", specs, slice_seconds, id_col="id").collect()
    expect = loop(rows, "cust", seconds)
    for r in got:
        n, s, m, u = expect[r["id"]]
        assert (r["n"], r["s"]) == (n, s), r
        assert not short or r["u"] == u
        assert "m" not in r.asDict() or r["m"] == m


def test_boundaries_are_inclusive_to_the_microsecond(spark):
    rows = [("a", 0), ("b", 60 * S), ("c", 60 * S + 1), ("d", 120 * S)]
    df = spark.createDataFrame([(i, "c", us) for i, us in rows], "id string, cust string, us long")
    got = {r["id"]: r["n"] for r in trailing(df, "cust", [Trailing("n", "count", None, 60)], 60, id_col="id").collect()}
    assert got == {"a": 1, "b": 2, "c": 2, "d": 3}


def test_ties_see_only_earlier_ids(spark):
    df = spark.createDataFrame([(f"t{i}", "c", 5 * S) for i in range(4)], "id string, cust string, us long")
    got = {r["id"]: r["n"] for r in trailing(df, "cust", [Trailing("n", "count", None, 60)], id_col="id").collect()}
    assert got == {"t0": 1, "t1": 2, "t2": 3, "t3": 4}


def test_last_and_running_across_slices(spark):
    rows = [("a", 0, 1, "x"), ("b", 10, 2, None), ("c", 9000, 3, None), ("d", 20000, 4, "y"), ("e", 20000, 5, None)]
    df = spark.createDataFrame([(i, "c", us * S, v, p) for i, us, v, p in rows],
                               "id string, cust string, us long, v long, p string")
    got = {r["id"]: (r["l"], r["s"]) for r in trailing(
        df, "cust", [Trailing("l", "last", "p"), Trailing("s", "running_sum", "v")], id_col="id").collect()}
    assert got == {"a": (None, 1), "b": ("x", 3), "c": ("x", 6), "d": ("x", 10), "e": ("y", 15)}


def test_hot_customer_is_spread_over_slices(spark):
    """A customer holding all rows must not end up in one task."""
    df = spark.range(4000).select(F.col("id").cast("string").alias("id"), F.lit("hot").alias("cust"),
                                  (F.col("id") * 60 * S).alias("us"))
    out = trailing(df, "cust", [Trailing("n", "count", None, 3600)], id_col="id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tiny data would merge
    try:
        per_task = out.withColumn("task", F.spark_partition_id()).groupBy("task").count()
        assert per_task.agg(F.max("count")).head()[0] < 2000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    plan = out._jdf.queryExecution().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


@pytest.mark.parametrize("a,b,low,high", [
    ((19.0760, 72.8777), (28.6139, 77.2090), 1100, 1200), ((51.5074, -0.1278), (19.0760, 72.8777), 7100, 7300),
    ((19.0, 72.0), (19.0, 72.0), 0, 0), ((None, 72.0), (19.0, 72.0), 0, 0)])
def test_haversine(spark, a, b, low, high):
    km = spark.createDataFrame([(*a, *b)], "a double, b double, c double, d double").select(
        haversine_km(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).head()[0]
    assert low <= km <= high


def _txn(spark, rows):
    return spark.createDataFrame(rows, "transaction_id string, customer_id string, device_fingerprint string, "
                                       "ip_address string, amount double, us long").withColumn(
        "cents", (F.col("amount") * 100).cast("long"))


def test_zscore_baseline_and_cold_start(spark):
    df = _txn(spark, [("a", "c", "d", None, 500.0, 0), ("b", "c", "d", None, 3500.0, S)])
    base = spark.createDataFrame([("c", 500.0, 100.0)], "customer_id string, baseline_mean double, baseline_std double")
    got = {r[0]: r[1] for r in amount_zscore(df, base).collect()}
    assert got == {"a": 0.0, "b": 30.0}
    cold = {r[0]: r[1] for r in amount_zscore(df).collect()}
    assert cold == {"a": 0.0, "b": 1.5}  # mean 2000, spread 1000


def test_novelty(spark):
    df = _txn(spark, [("a", "c", "d1", None, 1.0, 0), ("b", "c", "d1", None, 1.0, 1), ("x", "c", "d2", None, 1.0, 2)])
    got = {r[0]: r[1] for r in is_first_seen(df, "device_fingerprint", "new").collect()}
    assert got == {"a": True, "b": False, "x": True}


def test_merchant_chain(spark):
    df = spark.createDataFrame([("m", "crypto_exchange"), ("m", "nowhere"), ("p", "fuel")],
                               "merchant_id string, merchant_category string")
    profiles = spark.createDataFrame([("p", 7.0, 0.5)], "merchant_id string, profile_avg_amount double, profile_fraud_rate double")
    got = sorted((r["merchant_avg_amount"], r["merchant_fraud_rate"]) for r in merchant_risk(df, profiles).collect())
    assert got == [(7.0, 0.5), (1000.0, 0.015), (25000.0, 0.12)]


def test_linked_counts_with_shared_ip(spark):
    """300 customers behind one IP, one of them also sharing a device."""
    rows = [(f"t{i}", f"c{i}", f"d{i}", "ip", 1.0, i) for i in range(300)]
    rows += [("u1", "z", "d7", None, 1.0, 400), ("u2", "y", "lonely", "", 1.0, 401)]
    df = _txn(spark, rows)
    got = {r[0]: r[1] for r in linked_counts(df).collect()}
    assert got["t0"] == 299 and got["t7"] == 300 and got["u1"] == 1 and got["u2"] == 0
    as_of = {r[0]: r[1] for r in linked_counts_as_of(df).collect()}
    assert as_of["t0"] == 0 and as_of["t7"] == 7 and as_of["t299"] == 299 and as_of["u1"] == 1
