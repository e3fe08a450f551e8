"""Metrics, gates, drift, splits, routing, narratives: closed forms and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.functions.numeric import round_dp
from riskloom.functions.text import lcs_length
from riskloom.operators import drift, evaluation as H, lifecycle as K, narrative as N, training as TR
from riskloom.operators import validate as V


def test_rounding_equals_python(spark):
    rnd = random.Random(3)
    xs = [2.675, 35.245, 0.125, -0.125, -0.0004] + [rnd.randint(-9999, 9999) / 8 for _ in range(300)]
    xs += [rnd.uniform(-1e4, 1e4) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for places in (1, 2, 3):
        for x, y in df.select("x", round_dp(F.col("x"), places)).collect():
            assert y == round(x, places)


def brute_metrics(rows):
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in sorted({p for _, p in rows}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(p >= t for p in neg)
        ap += (tp / len(pos) - last) * tp / (tp + fp)
        last = tp / len(pos)
    return round(auc, 4), round(ap, 4)


@pytest.mark.parametrize("levels", [3, 17, 10_000])
def test_auc_and_ap_with_ties(spark, levels):
    rnd = random.Random(levels)
    rows = [(int(rnd.random() < 0.3), rnd.randint(0, levels) / levels) for _ in range(300)]
    m = H.all_metrics(spark.createDataFrame(rows, "y int, p double")).head()
    assert (m["auc_roc"], m["pr_auc"]) == pytest.approx(brute_metrics(rows), abs=1e-9)
    assert m["total_samples"] == 300


def test_costs(spark):
    rows = [(1, 0.1), (1, 0.2), (1, 0.9), (0, 0.7), (0, 0.8), (0, 0.9)]
    cost = H.financial_cost(spark.createDataFrame(rows, "y int, p double")).head()
    assert cost["total_financial_loss"] == 1030.0
    grid = H.threshold_grid()
    edge = [(i % 2, t) for i, t in enumerate(grid)] + [(1, 0.0), (0, 1.0)]
    got = H.threshold_costs(spark.createDataFrame(edge, "y int, p double")).collect()
    for r in got:
        assert r["true_positives"] == sum(y and p >= r["cutoff"] for y, p in edge)
        assert r["false_positives"] == sum((not y) and p >= r["cutoff"] for y, p in edge)


def test_class_weight(spark):
    df = spark.createDataFrame([(0,)] * 95 + [(1,)] * 5, "y int")
    assert H.class_weight(df).head()["scale_pos_weight"] == 19.0
    assert H.class_weight(df.where("y = 0")).head()["scale_pos_weight"] == 1.0


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 12)], "latency_ms double")
    r = H.latency_percentiles(df).head()
    assert (r["latency_p50_ms"], r["latency_p99_ms"], r["latency_mean_ms"]) == (6.0, 10.9, 6.0)


def test_drift(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    frame = lambda mu, sd: spark.createDataFrame(
        [(float(x), float(n), 5.0) for x, n in zip(rng.normal(mu, sd, 600), rng.poisson(2, 600))],
        "amount_zscore double, txn_count_1min double, flat double")
    rows, summary = drift.drift_report(frame(0, 1), frame(4.5, 1.5))
    got = {r["feature"]: r for r in rows.collect()}
    assert got["amount_zscore"]["severity"] == "SEVERE" and got["amount_zscore"]["psi"] >= 0.25
    assert got["txn_count_1min"]["severity"] == "NONE"
    assert got["flat"]["psi"] == 0.0 and got["flat"]["wasserstein_dist"] == 0.0
    assert summary.head()["overall_drift_detected"] and summary.head()["features_monitored"] == 3


def test_wasserstein_value_and_small_sides(spark):
    a = spark.createDataFrame([(float(x), 1.0 if x == 0 else None) for x in (0, 1, 3, 5, 5)], "v double, w double")
    b = spark.createDataFrame([(float(x), 1.0) for x in (5, 6, 8, 10, 10)], "v double, w double")
    got = {r["feature"]: r["wasserstein_dist"] for r in drift.wasserstein(a, b).collect()}
    assert got == {"v": 5.0}  # w has fewer than five reference values


def test_stratified_split_is_exact(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("transaction_id"),
                                  (F.col("id") < 30).cast("int").alias("is_fraud"))
    split = TR.stratified_split(df)
    assert {r["split"]: r["count"] for r in split.groupBy("split").count().collect()} == {
        "train": 700, "val": 150, "test": 150}
    assert split.where("is_fraud = 1 and split = 'train'").count() == 21
    with pytest.raises(ValueError):
        TR.stratified_split(df, 0.5, 0.1, 0.1)
    with pytest.raises(KeyError):
        TR.stratified_split(df, label="nope")


def test_random_split_and_folds(spark):
    ten = spark.range(10)
    counts = {r["split"]: r["count"] for r in TR.random_split(ten, 0.6, 0.2, 0.2).groupBy("split").count().collect()}
    assert counts == {"train": 6, "val": 2, "test": 2}
    with pytest.raises(Exception, match="at least 3"):
        TR.random_split(spark.range(2)).collect()
    folds = TR.stratified_kfold(ten.withColumn("is_fraud", (F.col("id") < 3).cast("int")), id_col="id")
    assert folds.where("is_fraud = 1").select("fold").distinct().count() == 3


def test_canary(spark):
    import hashlib

    ids = spark.range(1000).select(F.concat(F.lit("cust_"), F.col("id").cast("string")).alias("customer_id"))
    routed = K.canary_route(ids, K.split_config(spark, "v2", 30.0))
    rows = routed.collect()
    for r in rows[:200]:
        assert r["is_canary"] == (int(hashlib.md5(r["customer_id"].encode()).hexdigest(), 16) % 100 < 30)
    assert 250 <= sum(r["is_canary"] for r in rows) <= 350
    assert K.canary_route(ids, K.split_config(spark, "v2", 50.0, shadow_mode=True)).where("is_canary").count() == 0
    with pytest.raises(ValueError):
        K.split_config(spark, "v2", 101.0)


def _observe(spark, n, latency=4.0, error=False, arm="canary"):
    return spark.range(n).select(F.lit(arm).alias("arm"), F.col("id").alias("us"), F.col("id").cast("string").alias("transaction_id"),
                                 F.lit(latency).alias("latency_ms"), F.lit(error).alias("is_error"), F.lit(False).alias("was_flagged"))


def test_rollback(spark):
    config = K.split_config(spark, "v2", 30.0)
    decide = lambda obs: K.rollback_decision(K.canary_health(obs), config).head()
    both = lambda obs: obs.unionByName(_observe(spark, 30, arm="champion"))
    assert not decide(both(_observe(spark, 30)))["rolled_back"]
    assert decide(both(_observe(spark, 30, latency=18.0)))["rolled_back"]
    assert "error rate" in decide(both(_observe(spark, 25, error=True)))["reason"]
    assert not decide(both(_observe(spark, 19, error=True)))["rolled_back"]
    assert decide(_observe(spark, 5000))["samples"] == 200


def test_validation(spark):
    df = spark.createDataFrame(
        [("a", "c", "m", 5.0, "inr ", "upi", "d", 10.0, 10.0), ("b", "c", "m", -10.0, "INR", "upi", "d", 10.0, 10.0),
         ("e", "c", "m", 5.0, "INR", "fax", "d", 120.0, 10.0)],
        "transaction_id string, customer_id string, merchant_id string, amount double, currency string, channel string, "
        "device_fingerprint string, location_lat double, location_lng double").withColumn("timestamp", F.timestamp_seconds(F.lit(0)))
    good, bad = V.validate(df)
    assert [r["currency"] for r in good.collect()] == ["INR"]
    assert {r["transaction_id"]: len(r["violations"]) for r in bad.collect()} == {"b": 1, "e": 2}


CONTEXT = ("struct<transaction_info:struct<amount:double,channel:string>,geographic_signals:struct<distance_from_last_txn_km:double,"
           "is_international:boolean>,feature_snapshot:struct<is_international:int,amount_zscore:double,is_new_device:boolean>>")


@pytest.mark.parametrize("text,score,ok", [
    ("[Citing: amount=500, amount_zscore=13.9, distance=7189km]", 1.0, True),
    ("[citing: amount=900, amount_zscore=99, made_up=1, channel=up]", 0.25, False),
    ("no citations", 0.5, False), ("[Citing: , ,]", 1.0, True),
    ("[Citing: is_international=true]", 0.0, False),      # the snapshot's 1 shadows the flag
    ("[Citing: is_new_device=true, is_new_device]", 1.0, True), ("[Citing: unknown_key]", 0.0, False),
    ("[Citing: geographic_signals.is_international=true]", 1.0, True)])
def test_grounding(spark, text, score, ok):
    context = ((500.0, "upi"), (7189.2, True), (1, 14.2, True))
    df = spark.createDataFrame([(text, context)], f"narrative string, context {CONTEXT}")
    row = N.grounding(df).head()
    assert (row["grounding_score"], row["is_acceptable"]) == (score, ok)


def test_grounding_bool_coercion(spark):
    df = spark.createDataFrame([("[Citing: is_international=true]", ((1.0, "upi"), (0.0, True), (1, 0.0, True)))],
                               f"narrative string, context {CONTEXT}")
    assert N.grounding(df, coerce_bool=True).head()["grounding_score"] == 1.0


def test_lcs_against_table():
    rnd = random.Random(5)
    for _ in range(60):
        a = [rnd.choice("abcd") for _ in range(rnd.randint(0, 25))]
        b = [rnd.choice("abcd") for _ in range(rnd.randint(0, 25))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert lcs_length(a, b) == t[-1][-1]


def test_rouge(spark):
    df = spark.createDataFrame([("Café is open", "café is open"), ("a b", "c d"), ("one", "one two")],
                               "generated string, ground_truth string")
    got = N.rouge_l(N.rouge_n(N.rouge_n(df, 1), 2)).collect()
    assert [(r["rouge_1"], r["rouge_2"], r["rouge_l"]) for r in got[:2]] == [(1.0, 1.0, 1.0), (0.0, 0.0, 0.0)]
    assert got[2]["rouge_2"] == 0.0 and got[2]["rouge_l"] == pytest.approx(2 / 3)


def test_parse_narrative(spark):
    md = ("## Transaction Summary\nshort\n\n## Risk Indicators\n- [STRONG INDICATOR] one\n- two\n\n"
          "## Customer Context & Graph\nctx\n## Recommended Action\nESCALATE_URGENT now, not APPROVE")
    row = spark.createDataFrame([(md,)], "t string").select(N.parse_narrative(F.col("t")).alias("n")).head()["n"]
    assert row["transaction_summary"] == "short" and row["recommended_action"] == "ESCALATE_URGENT"
    assert [(i["indicator"], i["tag"]) for i in row["risk_indicators"]] == [
        ("[STRONG INDICATOR] one", "[STRONG INDICATOR]"), ("two", "[MODERATE INDICATOR]")]
    assert N.SYSTEM_RULES and row["customer_context"] == "ctx"


def test_empty_gate_fails(spark):
    empty = spark.createDataFrame([], "fidelity_score double, hallucination_rate double, rouge_1 double, rouge_2 double, "
                                      "rouge_l double, sar_compliant boolean")
    row = N.narrative_gate(empty).head()
    assert not row["passed_operational_gate"] and row["fidelity_score"] == 0.0
