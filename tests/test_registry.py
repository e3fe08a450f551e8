"""Times in production and drift per version."""

import random

from riskloom.operators import lifecycle as K
from riskloom.operators.scoring import append_scores, read_scores

LOG = "model_name string, version string, action string, gate_passed boolean, us bigint, event_id bigint"
SNAP = "model_name string, snapshot_type string, drift_detected boolean, drift_score double, us bigint, event_id bigint"
HOUR = K.SLICE_US


def intervals(spark, rows):
    return sorted(tuple(r) for r in K.production_intervals(spark.createDataFrame(rows, LOG)).collect())


def test_blocked_and_repeated_promotions_change_nothing(spark):
    rows = [("m", "a", "promote", True, 5, 1), ("m", "b", "promote", False, 6, 2), ("m", "b", "promote", None, 7, 3),
            ("m", "a", "promote", True, 8, 4), ("m", "b", "canary", True, 9, 5), ("m", "b", "promote", True, 3 * HOUR, 6),
            ("m", "a", "rollback", None, 9 * HOUR, 7), ("n", "a", "register", True, 1, 8),
            (None, "a", "promote", True, 1, 9), ("m", None, "promote", True, 2 * HOUR, 10), ("m", "c", "promote", True, None, 11)]
    want = [("m", "a", 5, 1, 3 * HOUR), ("m", "a", 9 * HOUR, 7, None), ("m", "b", 3 * HOUR, 6, 9 * HOUR)]
    assert [r[:4] for r in intervals(spark, rows)] == [r[:4] for r in want]
    assert [r[4] for r in intervals(spark, rows + rows)] == [r[4] for r in want]


def test_intervals_equal_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(rng.choice("mn"), rng.choice("abc"), rng.choice(["promote", "rollback", "canary"]), rng.random() < 0.7,
             rng.randrange(40) * HOUR // 4, i) for i in range(400)]
    want, now = [], {}
    for model, version, action, passed, us, event in sorted(rows, key=lambda r: (r[0], r[4], r[5])):
        if action == "canary" or (action == "promote" and not passed) or (model in now and want[now[model]][1] == version):
            continue
        if model in now:
            want[now[model]][4] = us
        now[model] = len(want)
        want.append([model, version, us, event, None])
    key = lambda r: r[3]
    assert sorted(intervals(spark, rows), key=key) == sorted(map(tuple, want), key=key)


def test_snapshots_count_for_the_version_of_their_time(spark):
    log = spark.createDataFrame([("m", "a", "promote", True, 10, 1), ("m", "b", "promote", True, 5 * HOUR, 2),
                                 ("n", "z", "rollback", None, 1, 3)], LOG)
    snaps = spark.createDataFrame([
        ("m", "feature_drift", True, 0.9, 9, 4), ("m", "feature_drift", True, 0.4, 10, 0), ("m", "prediction_drift", None, 0.1, HOUR, 5),
        ("m", "feature_drift", False, 0.0, 5 * HOUR, 1), ("m", "feature_drift", True, 0.3, 5 * HOUR - 1, 6),
        (None, "feature_drift", True, 0.3, 50, 7), ("m", "feature_drift", True, 0.3, None, 8)], SNAP)
    out = {(r.model_name, r.version): r for r in K.version_drift(log, snaps).collect()}
    a, b, z = out["m", "a"], out["m", "b"], out["n", "z"]
    assert (a.snapshots, a.drifted_snapshots, a.drift_status, a.drift_score, a.closed_us, a.is_production) == (3, 2, "drifted", 0.3, 5 * HOUR - 10, False)
    assert (b.snapshots, b.drift_status, b.prediction_drift_detected, b.is_production) == (1, "stable", None, True)
    assert (z.snapshots, z.drift_status, z.is_production) == (0, "unknown", True)
    assert K.version_drift(log.limit(0), snaps).count() == 0


def test_promotions_and_rollbacks_are_appended(spark, tmp_path):
    gate = lambda ok: spark.createDataFrame([(ok,)], "passed boolean")
    better = lambda ok: spark.createDataFrame([(ok,)], "is_promotable boolean")
    path = str(tmp_path / "log")
    K.append_registry(K.promotion_event(gate(True), better(True), "m", "v1", 10, 1), path)
    K.append_registry(K.promotion_event(gate(True), better(None), "m", "v2", 20, 2), path)
    K.append_registry(K.promotion_event(gate(True), better(True), "m", "v3", 30, 3), path)
    K.append_registry(K.rollback_event(spark, "m", "v1", 40, 4), path)
    log = spark.read.parquet(path)
    assert [tuple(r) for r in K.production_intervals(log).orderBy("from_us").collect()] == [
        ("m", "v1", 10, 1, 30), ("m", "v3", 30, 3, 40), ("m", "v1", 40, 4, None)]
    assert [tuple(r) for r in K.current_production(log).collect()] == [("m", "v1")]


def test_a_repeated_batch_of_scores_replaces_itself(spark, tmp_path):
    made = lambda ids, p: spark.createDataFrame(
        [(i, "v1", p, "low", 0.3, False) for i in ids],
        "transaction_id string, model_version string, risk_score double, risk_label string, threshold_used double, was_flagged boolean")
    path = str(tmp_path / "scores")
    for ids, p, batch in (("ab", 0.1, 0), ("cd", 0.2, 1), ("cd", 0.3, 1), ("a", 0.4, 2)):
        append_scores(made(ids, p), path, batch)
    got = sorted((r.transaction_id, r.risk_score, r.scoring_latency_ms) for r in read_scores(spark, path).collect())
    assert got == [("a", 0.1, 0.0), ("a", 0.4, 0.0), ("b", 0.1, 0.0), ("c", 0.3, 0.0), ("d", 0.3, 0.0)]
