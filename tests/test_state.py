"""State processors: expiry, late rows, repeated input; the marks of late rows."""

from pyspark.sql import functions as F

from riskloom.operators.features import build_feature_vector
from riskloom.schemas import FEATURES, TXN_DDL
from riskloom.session import work_dir
from riskloom.streaming import stateful as S

START = 1_700_000_000_000_000
HOUR = 3600 * 1_000_000


def txn(i, us, customer="c", device="d", merchant="m", amount=10.0, lat=None, lng=None):
    return (f"t{i:04d}", customer, merchant, amount, "INR", "upi", device, None, lat, lng, "fuel", False, us, None, None)


def frame(spark, rows):
    raw = spark.createDataFrame(rows, TXN_DDL.replace("timestamp timestamp not null", "timestamp bigint not null"))
    return raw.withColumn("timestamp", F.timestamp_micros("timestamp"))


def feed(spark, batches, delay="1 hour"):
    """Lands batch after batch, one run each; returns the emissions and the last progress of every run."""
    root, landing, progress = work_dir(spark, "state"), work_dir(spark, "landing"), []
    for rows in batches:
        df = frame(spark, rows)
        df.write.mode("append").parquet(landing)
        query = S.stateful_features(spark.readStream.schema(df.schema).parquet(landing), root, root + "-ckpt", delay)
        progress.append(query.recentProgress)
    return spark.read.schema(S.DEVICE_OUT).parquet(root), progress


def same_as_batch(spark, emitted, rows):
    columns = ["transaction_id", *FEATURES]
    got = S.newest_features(emitted).select(columns).collect()
    want = build_feature_vector(frame(spark, rows)).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_state_shrinks_when_event_time_passes_and_results_stay(spark):
    first = [txn(i, START + i * 60_000_000, device=f"d{i % 3}", lat=10.0 + i, lng=20.0) for i in range(90)]
    second = [txn(100, START + 40 * HOUR, device="d1", merchant="n"), txn(101, START + 41 * HOUR, device="d9")]
    third = [txn(102, START + 80 * HOUR, device="d2")]
    emitted, progress = feed(spark, [first, second, third])
    same_as_batch(spark, emitted, first + second + third)
    held = lambda run, k: progress[run][-1].stateOperators[k].numRowsTotal
    assert held(1, 0) < held(0, 0) and held(2, 1) < held(0, 1)
    assert len(progress[0][-1].stateOperators) == 2
    assert spark.conf.get(S.PROVIDER) != S.ROCKS  # the session keeps its own state store


def test_late_rows_change_what_was_emitted(spark):
    place = dict(lat=12.0, lng=77.0)
    first = [txn(1, START + 10 * HOUR, **place), txn(2, START + 11 * HOUR, device="e"), txn(3, START + 39 * HOUR, device="f", merchant="x", **place)]
    late = [txn(4, START + 9 * HOUR + 1, device="f", merchant="x", amount=900.0, lat=13.0, lng=77.5), txn(5, START + 10 * HOUR),
            txn(6, START + 11 * HOUR, customer="other", device="e"), txn(1, START + 10 * HOUR, **place)]
    emitted, _ = feed(spark, [first, late], "10 days")
    same_as_batch(spark, emitted, first + late[:3])
    versions = {r.transaction_id: r.n for r in emitted.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert versions["t0001"] > 1 and versions["t0003"] > 1 and versions["t0004"] == 1


def test_late_rows_are_kept_and_a_repeated_batch_replaces_its_own(spark):
    root, landing = work_dir(spark, "late"), work_dir(spark, "late-in")
    for rows in ([txn(1, START), txn(2, START + 5 * HOUR)], [txn(3, START + 4 * HOUR + 1), txn(4, START + 3 * HOUR), txn(5, START + 9 * HOUR)]):
        df = frame(spark, rows)
        df.write.mode("append").parquet(landing)
        S.late_rows(spark.readStream.schema(df.schema).parquet(landing), root, root + "-ckpt", HOUR)
    late = lambda: sorted(r.transaction_id for r in spark.read.parquet(f"{root}/late").collect())
    assert late() == ["t0004"]
    S.late_rows(spark.readStream.schema(df.schema).parquet(landing), root, root + "-ckpt-new", HOUR)
    assert late() == ["t0004"]  # starts over as batch 0, which has no mark before it; batch 1 stays


def test_rows_share_entries_of_the_state(spark):
    rows = [txn(i, START + i * 60_000_000, device=f"d{i % 3}", merchant=f"m{i % 40}") for i in range(160)]
    emitted, progress = feed(spark, [rows[:120:2], rows[1:120:2], rows[120:]], "10 days")
    same_as_batch(spark, emitted, rows)
    assert progress[-1][-1].stateOperators[0].numRowsTotal < 40  # an entry per row and per first sight made over 200
