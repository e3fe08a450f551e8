"""Scoring by the version in force, side-by-side tuning, and the index of pairs seen."""

import random

from pyspark.sql import functions as F

from riskloom.operators import lifecycle as K
from riskloom.operators import training as TR
from riskloom.operators.scorecard import scorecard
from riskloom.operators.scoring import read_scores, score
from riskloom.schemas import FEATURES
from riskloom.streaming import first_seen as P
from riskloom.streaming import jobs as L


def feature_rows(spark, n, start=0):
    rows = spark.range(start, start + n).select(
        F.concat(F.lit("t"), "id").alias("transaction_id"), F.concat(F.lit("c"), F.col("id") % 40).alias("customer_id"), "id")
    return rows.select("transaction_id", "customer_id", *[
        (F.col("id") % 9).cast("double").alias(f) for f in FEATURES])


def test_a_scorecard_is_cut_to_probabilities_and_survives_saving(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0.5), ("b", 7.0), ("c", -2.0), ("d", None)], "transaction_id string, amount_zscore double")
    scorecard("amount_zscore").write().save(str(tmp_path / "v1"))
    got = score(rows, L.saved_models(str(tmp_path))("v1"), "v1")
    assert {r.transaction_id: r.p for r in got.collect()} == {"a": 0.5, "b": 1.0, "c": 0.0, "d": 0.0}


def split(spark, path, us, version, pct, shadow=False):
    spark.createDataFrame([(us, 0, version, pct, shadow)], "us bigint, event_id bigint, canary_version string, canary_percentage double, shadow_mode boolean"
                          ).write.mode("append").parquet(path)


def test_serving_config_follows_registry_and_split_log(spark, tmp_path):
    registry, log = str(tmp_path / "registry"), str(tmp_path / "split")
    config = lambda: L.serving_config(spark, "m", registry, log).head()
    assert (config().champion_version, config().is_active) == (K.CHAMPION, False)
    K.append_registry(K.rollback_event(spark, "other", "x", 1, 1), registry)
    assert config().champion_version == K.CHAMPION
    K.append_registry(K.rollback_event(spark, "m", "v1", 1, 2), registry)
    split(spark, log, 1, "v2", 100.0)
    assert (config().champion_version, config().canary_version, config().is_active) == ("v1", "v2", True)
    split(spark, log, 2, "v2", 400.0)  # refused
    assert config().canary_percentage == 100.0
    K.append_registry(K.rollback_event(spark, "m", "v2", 5, 3), registry)  # the canary becomes the champion
    assert (config().champion_version, config().canary_percentage, config().is_active) == ("v2", 0.0, False)


def test_a_promotion_reaches_the_next_batch_and_a_repeated_batch_keeps_its_version(spark, tmp_path):
    registry, log, root = (str(tmp_path / x) for x in ("registry", "split", "out"))
    cards = {"v1": scorecard("0.7D"), "v2": scorecard("0.9D")}
    loads = []

    def load(version):
        loads.append(version)
        return cards[version]

    schema = feature_rows(spark, 1).schema

    def run(part, attempt=0):
        feature_rows(spark, 50, 50 * part).write.mode("append").parquet(str(tmp_path / "in"))
        L.stream_versioned_alerts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), load, "m", registry, log,
                                  ["txn_count_1hr"], root, str(tmp_path / f"ckpt{attempt}"))

    K.append_registry(K.rollback_event(spark, "m", "v1", 1, 1), registry)
    run(0)
    K.append_registry(K.rollback_event(spark, "m", "v2", 2, 2), registry)
    run(1)
    versions = lambda: {(r.batch, r.model_version): r.n for r in read_scores(spark, root + "/scores").groupBy(
        "batch", "model_version").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert versions() == {(0, "v1"): 50, (1, "v2"): 50} and loads == ["v1", "v2"]
    alerts = spark.read.parquet(root + "/alerts")
    assert alerts.count() == 100 and alerts.where("value LIKE '%\"txn_count_1hr\":%'").count() == 100
    # A stream that starts over repeats batch 0 over all rows: the recorded choice still holds there.
    run(2, attempt=1)
    assert versions() == {(0, "v1"): 150, (1, "v2"): 50}


def test_shadow_scores_do_not_decide_and_shares_split_the_rows(spark):
    rows, load = feature_rows(spark, 80), {"v1": scorecard("0.2D"), "v2": scorecard("0.9D")}.__getitem__
    shadow = L.score_routed(rows, K.split_config(spark, "v2", 0.0, True, "v1"), load, ["txn_count_1hr"]).collect()
    assert len(shadow) == 80 and {(r.model_version, r.risk_score, r.shadow_score, r.was_flagged) for r in shadow} == {("v1", 0.2, 0.9, False)}
    shared = L.score_routed(rows, K.split_config(spark, "v2", 50.0, False, "v1"), load, ["txn_count_1hr"])
    routed = {r.transaction_id: r.model_version for r in K.canary_route(rows, K.split_config(spark, "v2", 50.0, False, "v1")).collect()}
    got = shared.collect()
    assert {r.transaction_id: r.model_version for r in got} == routed and set(routed.values()) == {"v1", "v2"}
    assert all(r.risk_score == (0.9 if r.is_canary else 0.2) and r.shadow_score is None for r in got)
    assert L.score_routed(rows.limit(0), K.split_config(spark, "v2", 50.0, False, "v1"), load, ["txn_count_1hr"]).count() == 0


def test_fits_side_by_side_give_the_same_history(spark):
    rows = feature_rows(spark, 120).withColumn("y", (F.xxhash64("transaction_id") % 3 == 0).cast("int"))
    seen = []

    def fit(train, held, params, rounds, seed):
        seen.append((train.count(), held.count()))
        return scorecard(f"{params['w']!r}D * txn_count_1hr")

    candidates = [{"w": 0.1}, {"w": -0.1}, {"w": 0.0}]
    alone, together = (TR.tune_model(rows, 3, candidates, parallelism=n, fit=fit) for n in (1, 9))
    assert alone == together and [h["candidate_idx"] for h in alone] != [] and len(seen) == 18
    assert all(a + b == 120 for a, b in seen)
    assert [h for h in alone if h["w"] == 0.0][0]["mean_roc_auc"] == 0.5


def test_pairs_seen_equal_a_set_and_stay_in_few_folders(spark, tmp_path):
    rng, seen, root = random.Random(4), set(), str(tmp_path / "pairs")
    for version in range(12):
        batch = [("hot" if rng.random() < 0.4 else f"c{rng.randrange(30)}", f"d{rng.randrange(25)}") for _ in range(60)]
        rows = spark.createDataFrame(batch + [(None, "d1"), ("c1", None)], "customer_id string, device string")
        known = P.known_pairs(rows, "device", root, version)
        customers = {c for c, _ in batch}
        got = set() if known is None else {tuple(r) for r in known.collect() if r.customer_id in customers}
        assert got == {p for p in seen if p[0] in customers}
        for _ in range(2 if version % 5 == 0 else 1):  # a repeated batch adds nothing twice
            P.add_pairs(rows, "device", root, version, buckets=4)
        seen |= set(batch)
    folders, buckets = P._folders(spark, root, 99)
    assert buckets == 4 and max(map(len, folders.values())) <= P.FOLDERS
    stored = P._read(spark, root, "device", folders)
    assert stored.count() == len(seen) and {tuple(r) for r in stored.collect()} == seen


def test_a_batch_opens_only_the_buckets_of_its_customers(spark, tmp_path):
    root = str(tmp_path / "pairs")
    mine = spark.createDataFrame([("c1", "d1"), ("c2", "d2")], "customer_id string, device string")
    wanted = {r.b for r in mine.select(P._bucket(P.BUCKETS).alias("b")).collect()}
    opened = []
    for version in range(10):  # the stream grows by other customers
        others = spark.range(200).select(F.concat_ws("_", F.lit("o"), F.lit(version), "id").alias("customer_id"), F.lit("d").alias("device"))
        P.add_pairs(mine.unionByName(others) if version == 0 else others, "device", root, version)
        known = P.known_pairs(mine, "device", root, version + 1)
        files = known.inputFiles()
        assert {int(f.split("bucket=")[1].split("/")[0]) for f in files} <= wanted
        assert sorted(map(tuple, known.collect())) == [("c1", "d1"), ("c2", "d2")]
        opened.append(len({f.rsplit("/", 1)[0] for f in files}))
    assert max(opened) <= len(wanted) * P.FOLDERS
    assert "PushedFilters: [In(customer_id" in known._jdf.queryExecution().toString()
