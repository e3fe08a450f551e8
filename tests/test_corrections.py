"""Inputs that once gave wrong answers, and a check that the mapped data reaches every branch."""

import pytest
from pyspark.sql import functions as F

from compare import duck
from riskloom.operators import cases as CS
from riskloom.operators import scoring as E
from riskloom.operators.validate import feature_violations, validate
from riskloom.plans import registry
from riskloom.schemas import FEATURE_TYPES, FEATURES
from riskloom.session import work_dir
from riskloom.sources.adapter import transactions
from riskloom.streaming import jobs as L

SF = "/root/testdata/sf0.001"


def feature_rows(spark, ids, count):
    kinds = {"bigint": F.lit(count).cast("bigint"), "double": F.lit(float(count)), "boolean": F.lit(False)}
    return spark.createDataFrame([(i,) for i in ids], "transaction_id string").select(
        "transaction_id", F.lit("c").alias("customer_id"), *[kinds[FEATURE_TYPES[f]].alias(f) for f in FEATURES],
        F.lit("1.0.0").alias("feature_version"))


def test_second_publication_replaces_the_first(spark):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    store = (E.publish_online(feature_rows(spark, "ab", 5), at(1000))
             .unionByName(E.publish_online(feature_rows(spark, "abc", 7), at(2000)))
             .unionByName(E.publish_online(feature_rows(spark, "c", 9), at(2000))))
    ids = spark.createDataFrame([(x,) for x in "abcd"], "transaction_id string")
    got = {r.transaction_id: (r.found, r.txn_count_1hr) for r in E.lookup_online(ids, store, at(3000)).collect()}
    assert got == {"a": (True, 7), "b": (True, 7), "c": (True, 9), "d": (False, None)}
    assert E.live_online(store, at(2000 + 86400)).count() == 0
    events = ids.withColumns({"customer_id": F.lit("c"), "amount": F.lit(1.0), "is_international": F.lit(False), "timestamp": at(0)})
    twice = feature_rows(spark, "ab", 5).unionByName(feature_rows(spark, "a", 8))
    back = {r.transaction_id: (r.is_fallback, r.txn_count_1hr) for r in E.fetch_or_fallback(events, twice).collect()}
    assert back == {"a": (False, 8), "b": (False, 5), "c": (True, 1), "d": (True, 1)}


def test_amounts_must_be_finite(spark):
    inf, nan = float("inf"), float("nan")
    rows = transactions(spark, SF).limit(1).drop("amount").crossJoin(
        spark.createDataFrame([(x,) for x in (1.0, 0.0, -1.0, nan, inf, -inf)], "amount double"))
    ok, bad = validate(rows)
    assert [r.amount for r in ok.collect()] == [1.0]
    found = {str(r.amount): r.violations for r in bad.collect()}
    assert found["nan"] == found["inf"] == ["amount must be finite"] and "amount must be positive" in found["-inf"]
    broken = feature_rows(spark, "a", 1).withColumns({"amount_zscore": F.lit(nan), "max_amount_24hr": F.lit(inf)})
    assert sorted(feature_violations(broken).first().violations) == ["amount_zscore is not finite", "max_amount_24hr is not finite"]


def test_a_case_feed_finds_both_kinds_of_reference(spark):
    cases = spark.createDataFrame([("case_1", "t1", 0.9, 10), ("case_2", "t2", 0.8, 11)], "id string, transaction_id string, risk_score double, created_at bigint")
    notes = spark.createDataFrame([("t1", 12)], "transaction_id string, created_at bigint")
    feedback = spark.createDataFrame([("case_1", "rejected", "x", 20), ("t1", "approved", "y", 21), ("t2", "approved", "y", 22), ("t9", "approved", "z", 23)],
                                     "case_ref string, decision string, analyst_id string, decided_at bigint")
    feed = lambda case: sorted((r.event_type, r.at) for r in CS.case_event_feed(cases, notes, feedback, case=case).collect())
    mine = [("case_flagged", 10), ("case_resolved", 20), ("case_resolved", 21), ("narrative_ready", 12)]
    assert feed("case_1") == feed("t1") == mine
    assert feed("t9") == [("case_resolved", 23)] and len(feed(None)) == 7


@pytest.mark.parametrize("order", ["by_time", "late_rows_last"])
def test_a_late_row_has_the_distance_of_the_whole_history(spark, order):
    from riskloom.operators.features import build_feature_vector
    from riskloom.sources.streams import read_txn_stream

    t = transactions(spark, SF).cache()
    late = F.col("event_id") % 5 == 0
    root, landing = work_dir(spark, "late-out"), work_dir(spark, "late-in")
    cut = F.col("us") < 1_704_067_200_000_000 + 12 * 86_400_000_000
    parts = [~late, late] if order == "late_rows_last" else [cut, ~cut]
    for part in parts:
        t.where(part).write.mode("append").parquet(landing)
        L.stream_features(read_txn_stream(spark, "parquet", path=landing), root, root + "-ckpt")
    got = {r.transaction_id: r.distance_from_last_txn for r in spark.read.parquet(root + "/features").collect()}
    want = {r.transaction_id: r.distance_from_last_txn for r in build_feature_vector(t).collect()}
    compared = {r.transaction_id for r in t.where(parts[1]).collect()} if order == "late_rows_last" else set(want)
    assert set(got) == set(want)
    assert {i: got[i] for i in compared} == {i: want[i] for i in compared}


def test_the_mapped_data_reaches_every_branch():
    """Asked of the SQL side, so it holds for what the queries are compared with."""
    con, sql = duck("/root/testdata/sf0.01"), registry.oracle_sql()
    ask = lambda name, what: con.execute(f"SELECT {what} FROM ({sql[name]})").fetchone()
    assert ask("case_by_id", "count(*)")[0] == 2
    assert set(con.execute(f"SELECT DISTINCT action FROM ({sql['recommended_action']})").fetchall()) >= {("ESCALATE_URGENT",), ("HOLD_FOR_REVIEW",)}
    assert all(ask("grounding_gate", "count_if(used_fallback), count_if(NOT used_fallback)"))
    assert ask("curate_instructions", "count(*)")[0] > 0 and 0 < ask("retention_rate", "max(retention_rate)")[0] < 1
    assert all(ask("feature_vector", "count_if(is_weekend), count_if(NOT is_weekend)"))
    assert ask("feature_vector", "count(DISTINCT hour_of_day)")[0] == 24
    assert all(ask("is_new_lookback", "count_if(is_new_device_lookback), count_if(NOT is_new_device_lookback)"))
    assert all(ask("sar_compliance_narratives", "count_if(sar_compliant), count_if(NOT sar_compliant)"))
    assert all(ask("lookup_online_features", "count_if(found), count_if(NOT found)"))
    count, lifetime = (con.execute(x).fetchone()[0] for x in (
        f"SELECT max(txn_count_24hr) FROM ({sql['txn_count_24hr']})",
        "SELECT max(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id)"))
    assert count < lifetime / 2  # a day's window expires
    assert "n_txns >=" not in sql["merchant_risk_lookup"]


def test_link_counts_read_the_events_once(spark):
    from riskloom.operators.entities import linked_counts, linked_counts_as_of

    for function, most in ((linked_counts, 8), (linked_counts_as_of, 40)):
        plan = function(transactions(spark, SF))._jdf.queryExecution().executedPlan().toString()
        assert "events.parquet" not in plan  # only written tables, far smaller than the events, are read again
        assert plan.count("Exchange hashpartitioning") <= most, (function.__name__, plan.count("Exchange hashpartitioning"))


def test_a_hot_device_and_a_hot_address(spark):
    from riskloom.operators.entities import linked_counts

    rows = [(f"t{i}", f"c{i}", i, "hot_dev" if i < 400 else f"d{i}", "hot_ip" if i >= 200 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "transaction_id string, customer_id string, us bigint, device_fingerprint string, ip_address string")
    got = {r.transaction_id: r.linked_count for r in linked_counts(df).collect()}
    assert (got["t0"], got["t300"], got["t500"]) == (399, 599, 399)


def test_staged_tables_have_an_owner(spark):
    import glob

    from riskloom.session import stage, staging_area

    root = spark.conf.get("spark.checkpoint.dir")
    with staging_area(spark):
        assert stage(spark.range(5), "owned").count() == 5 and glob.glob(f"{root}/owned-*")
    assert not glob.glob(f"{root}/owned-*")


def test_a_batch_reads_only_its_hours(spark):
    hour, path = 3_600_000_000, work_dir(spark, "hours")
    rows = spark.range(24 * 30).select(F.col("id").alias("n"), (F.col("id") * hour + 5).alias("us"))
    for batch in range(3):
        L.write_hours(rows.where(F.col("n") % 3 == batch), path, batch)
    L.write_hours(rows.where(F.col("n") % 3 == 2), path, 2)  # a repeated batch
    got = L.read_hours(spark, path, 100 * hour, 126 * hour)
    assert sorted(r.n for r in got.collect()) == list(range(100, 126)) and len(got.inputFiles()) == 27
    assert L.read_hours(spark, path, 10_000 * hour, 10_001 * hour) is None


def test_alerts_of_a_stream_carry_their_features(spark):
    from riskloom.operators import training as TR
    from riskloom.operators.features import build_feature_vector
    from riskloom.session import stage

    made = stage(build_feature_vector(transactions(spark, SF), keep=("is_fraud",)), "made")
    xy = E.prepare_xy(made)
    model = TR.train_model(xy, xy, {"maxDepth": 4, "stepSize": 0.5}, rounds=5)
    landing, root = work_dir(spark, "made-in"), work_dir(spark, "alerts-out")
    made.write.parquet(landing)
    stream = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", "1").parquet(landing)
    L.stream_alerts(stream, model, "gbt_v1", FEATURES, root, root + "-ckpt")
    got = {(r.key, r.value) for r in spark.read.parquet(root + "/alerts").select("key", "value").collect()}
    want = {(r.key, r.value) for r in L.alerts_of(made, model, "gbt_v1", FEATURES).collect()}
    assert got == want and len(want) > 0
    assert all('"features":{"txn_count_1min":' in value for _, value in want)


def test_training_is_repeatable_and_better_than_chance(spark):
    from riskloom.operators import evaluation as H
    from riskloom.operators import training as TR
    from riskloom.operators.features import build_feature_vector
    from riskloom.session import stage

    made = build_feature_vector(transactions(spark, SF), keep=("is_fraud", "k"))
    made = made.withColumn("is_fraud", (F.col("hour_of_day") >= 5).cast("int"))  # a label that the features explain
    splits = stage(TR.stratified_split(E.prepare_xy(made, keep=("transaction_id",)), label="y"), "splits")
    part = lambda s: splits.where(F.col("split") == s)
    fits = [TR.train_model(part("train"), part("val"), {"maxDepth": 3}, rounds=10) for _ in range(2)]
    first, second = ([tuple(r) for r in TR.predict(m, part("test"), "transaction_id").orderBy("transaction_id").collect()] for m in fits)
    assert first == second
    assert H.roc_auc(TR.predict(fits[0], part("test"))).head()["auc_roc"] > 0.8
    row = TR.training_metadata(fits[0], splits, "v").head()
    assert row.train_samples + row.val_samples + row.test_samples == splits.count()
    history = TR.tune_model(part("train").drop("split"), k=2, candidates=[{"maxDepth": 1}, {"maxDepth": 3}], rounds=4)
    assert [h["mean_pr_auc"] for h in history] == sorted((h["mean_pr_auc"] for h in history), reverse=True)
    assert {h["candidate_idx"] for h in history} == {0, 1} and all("mean_roc_auc" in h for h in history)
