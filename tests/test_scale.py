"""Work and memory that must not grow faster than the input."""

import re

import pytest
from pyspark.sql import functions as F

from riskloom.operators import evaluation as H
from riskloom.operators import training as TR
from riskloom.operators.ranking import hash_rank


def moved(df) -> str:
    """The columns that exchanges and sorts of the plan handle."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    blocks = re.split(r"\n\n+", text)
    return "\n".join(block for block in blocks if re.match(r"\(\d+\) (BroadcastExchange|Exchange|Sort|Window)", block))


def test_split_takes_the_members_of_the_ranks_and_moves_no_rows(spark):
    df = spark.range(3000).select(F.concat(F.lit("t"), "id").alias("transaction_id"), (F.col("id") % 37 == 0).cast("int").alias("is_fraud"),
                                  (F.col("id") * 2).alias("wide"))
    split = TR.stratified_split(df)
    got = {r.transaction_id: r.split for r in split.collect()}
    sizes = split.groupBy("is_fraud", "split").count().collect()
    train = {r.is_fraud: r["count"] for r in sizes if r.split == "train"}
    val = {r.is_fraud: r["count"] for r in sizes if r.split == "val"}
    ranks = hash_rank(df, "is_fraud", "transaction_id", 42).collect()
    assert got == {r.transaction_id: "train" if r._rank <= train[r.is_fraud] else
                   "val" if r._rank <= train[r.is_fraud] + val[r.is_fraud] else "test" for r in ranks}
    assert sum(train.values()) == 2100 and sum(val.values()) == 450
    assert "transaction_id" in moved(split)
    assert "wide" not in moved(split)


@pytest.mark.parametrize("n, label", [(1, 1), (2, 0), (3, 1)])
def test_split_of_few_rows_is_whole(spark, n, label):
    df = spark.range(n).select(F.col("id").alias("transaction_id"), F.lit(label).alias("is_fraud"))
    assert TR.stratified_split(df).count() == n


def test_metadata_orders_the_scores_once(spark, monkeypatch):
    from riskloom.operators.scorecard import scorecard

    ordered, whole = [], H.stage_ordered
    monkeypatch.setattr(H, "stage_ordered", lambda *args: ordered.append(args) or whole(*args))
    splits = spark.range(60).select((F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") / 60.0).alias("x"),
                                    F.element_at(F.array(*map(F.lit, ("train", "val", "test"))), (F.col("id") % 3 + 1).cast("int")).alias("split"))
    row = TR.training_metadata(scorecard("x"), splits, "v").collect()[0]
    test = TR.predict(scorecard("x"), splits.where("split = 'test'"))
    best, half = H.all_metrics(test, row.optimal_threshold).head(), H.all_metrics(test, 0.5).head()
    cost = H.financial_cost(test, row.optimal_threshold).head()
    assert (row.auc_roc, row.f1_score_standard_05, row.f1_score_optimal, row.financial_loss, row.missed_fraud_count, row.false_alarms_count) == (
        half.auc_roc, half.f1_score, best.f1_score, cost.total_financial_loss, cost.false_negatives, cost.false_positives)
    assert len(ordered) == 3  # two by the comparisons above


def test_micro_batch_prepares_its_rows_once(spark, monkeypatch):
    from riskloom.operators.features import build_feature_vector
    from riskloom.sources.adapter import MIDDLE_US, transactions
    from riskloom.streaming import jobs as L

    staged, whole = [], L.stage
    monkeypatch.setattr(L, "stage", lambda df, name: staged.append(name) or whole(df, name))
    t = transactions(spark, "/root/testdata/sf0.001")
    late = F.col("us") >= MIDDLE_US
    made = L.micro_batch_features(t.where(late).unionByName(t.where(late)), t.where(~late))
    assert staged == ["rows"]
    key = lambda df: sorted(map(str, df.select("transaction_id", "txn_count_24hr", "amount_zscore", "is_new_device").collect()))
    ids = t.where(late).select("transaction_id")
    assert key(made) == key(build_feature_vector(t).join(ids, "transaction_id"))


def test_store_moves_rows_once_and_joins_values(spark):
    from riskloom.session import work_dir
    from riskloom.sources import online_store as O

    root, at = work_dir(spark, "store"), lambda s: F.timestamp_seconds(F.lit(s))
    rows = lambda n, count: spark.range(n).select(
        F.concat(F.lit("t"), "id").alias("transaction_id"), F.create_map(F.lit("txn_count_1hr"), F.lit(count)).alias("fields"),
        F.timestamp_seconds(F.lit(500)).alias("expires_at"))
    O.publish(rows(1500, "1"), root, 0, at(0), buckets=3)
    O.publish(rows(700, "2").unionByName(rows(300, "3")), root, 1, at(0))
    found = O.lookup(rows(1600, "0"), root, at(10))
    assert "fields" not in moved(found) and "transaction_id" in moved(found)
    assert sorted((r.txn_count_1hr or 0, r.found, r["count"]) for r in found.groupBy("txn_count_1hr", "found").count().collect()) == [
        (0, False, 100), (1, True, 800), (2, True, 400), (3, True, 300)]
    nulls = spark.createDataFrame([(None,), ("t1",)], "transaction_id string")
    assert {r.transaction_id: r.found for r in O.lookup(nulls, root, at(10)).collect()} == {None: False, "t1": True}


def test_stream_input_is_not_dealt_to_two_tasks(spark, monkeypatch):
    from riskloom.plans import data_queries as Q
    from riskloom.sources.adapter import transactions

    def dealt(*args):
        raise AssertionError("the history is dealt anew")

    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", dealt)
    sf = "/root/testdata/sf0.001"
    t = transactions(spark, sf)
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(Q.stream_dedupe(spark, sf)) == ids(t.select("transaction_id"))
    assert ids(Q.stream_score_and_flag(spark, sf)) == ids(t.where("amount > 200 and is_fraud = 1").select("transaction_id"))


def test_merge_moves_only_the_columns_in_use(spark):
    history = spark.range(50).select(F.col("id").cast("string").alias("transaction_id"), (F.col("id") * 2).alias("x"), (F.col("id") * 3).alias("unused"),
                                     F.lit(0).alias("is_fraud"))
    labels = spark.createDataFrame([("1", 7, 8, 1, 10), ("1", 9, 8, 0, 20), ("new", 5, 5, 1, None)],
                                   "transaction_id string, x long, unused long, is_fraud int, at long")
    merged = TR.merge_feedback(history, labels.withColumn("created_at", F.timestamp_seconds("at")).drop("at"))
    assert merged.columns == ["transaction_id", "x", "unused", "is_fraud"]
    got = {r.transaction_id: (r.x, r.is_fraud) for r in merged.select("transaction_id", "x", "is_fraud").collect()}
    assert got == {str(i): (2 * i, 0) for i in range(50)} | {"1": (9, 0), "new": (5, 1)}
    assert "unused" not in moved(merged.select("transaction_id", "x"))


@pytest.mark.parametrize("limit, most", [(90, 1), (200, 2), (10_000, 3)])
def test_boosted_fits_side_by_side_hold_a_bounded_number_of_rows(spark, monkeypatch, limit, most):
    from multiprocessing import pool

    sizes, whole = [], pool.ThreadPool
    monkeypatch.setattr(pool, "ThreadPool", lambda n: sizes.append(n) or whole(n))
    monkeypatch.setattr(TR, "ROWS_SIDE_BY_SIDE", limit, raising=False)
    monkeypatch.setattr(TR, "train_model", lambda *args, **more: None)
    monkeypatch.setattr(TR, "predict", lambda model, held: held.select("y", F.lit(0.5).alias("p")))
    rows = spark.range(90).select(F.col("id").alias("transaction_id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    assert TR.fold_scores(rows, fit=TR.train_model).count() == 3 * 90
    assert sizes == [most]


def test_a_larger_feature_table_has_more_tasks_not_larger_ones(spark, monkeypatch):
    from riskloom import session as S
    from riskloom.plans import governance_queries as G
    from riskloom.plans import stored as K

    sf = "/root/testdata/sf0.001"
    files = lambda: len(G.features(spark, sf).inputFiles())
    monkeypatch.setattr(K, "_WRITTEN", {})
    whole = sorted(map(str, G.features(spark, sf).collect()))
    assert files() <= 4
    monkeypatch.setattr(K, "_WRITTEN", {})
    monkeypatch.setattr(S, "TASK_ROWS", 5)
    monkeypatch.setattr(S, "TASK_BYTES", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "100b")
    try:
        assert files() > 4 and sorted(map(str, G.features(spark, sf).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_settings_are_bounded_inside_only_and_finer_ones_stay(spark):
    from riskloom.session import TASK_BYTES, TASK_ROWS, bounded_tasks

    advisory, scan, parts = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes",
                             "spark.sql.shuffle.partitions")
    before = [spark.conf.get(n) for n in (advisory, scan, parts)]
    spark.conf.set(scan, "16k")
    try:
        with pytest.raises(KeyError), bounded_tasks(spark, 4 * TASK_ROWS + 1):
            assert (spark.conf.get(advisory), spark.conf.get(scan), spark.conf.get(parts)) == (str(TASK_BYTES), "16k", "5")
            raise KeyError
        with bounded_tasks(spark, TASK_ROWS):
            assert spark.conf.get(parts) == "4"
        assert [spark.conf.get(n) for n in (advisory, scan, parts)] == [before[0], "16k", "4"]
    finally:
        spark.conf.set(scan, before[1])


def test_cells_of_the_drift_histogram_carry_no_names(spark, monkeypatch):
    from riskloom.operators import drift as J

    rows = spark.createDataFrame([(1.0, 5, None), (1.0, 6, True), (float("nan"), 6, False), (2.0, 6, True)], "a double, b long, c boolean")
    made = J.value_histogram(rows, rows.where("b = 6"), ["a", "b", "c"])
    assert sorted((r.feature, r.value, r.ref_n, r.cur_n) for r in made.collect()) == [
        ("a", 1.0, 2, 1), ("a", 2.0, 1, 1), ("b", 5.0, 1, 0), ("b", 6.0, 3, 3), ("c", 0.0, 1, 1), ("c", 1.0, 2, 2)]
    monkeypatch.setattr(J, "stage_ordered", lambda hist, *args: hist)
    assert "feature" not in moved(J.value_histogram(rows, rows, ["a", "b", "c"]))
