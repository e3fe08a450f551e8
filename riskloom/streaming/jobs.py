"""Micro-batch features, idempotent sinks, alerts, rate limits and canary monitoring.

Each micro-batch goes through the batch operators, so batch and stream share one
definition of every feature and one treatment of hot keys (time slices), unlike
per-key state, which keeps a hot customer in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.geo import known_location
from riskloom.operators import lifecycle as K
from riskloom.operators.features import build_feature_vector, with_micros
from riskloom.operators.ranking import latest_per_key
from riskloom.operators.scoring import flagged_events, publish_online, risk_tier
from riskloom.operators.trailing import MICROS, trailing_count
from riskloom.session import stage, staging_area
from riskloom.sources.commits import commit, committed
from riskloom.sources.online_store import merge_online
from riskloom.sources.tables import feature_snapshots
from riskloom.streaming.first_seen import add_pairs, known_pairs

CUSTOMER_TTL_SECONDS, DEVICE_TTL_SECONDS, ONLINE_TTL_SECONDS = 90_000, 7_200, 86_400


def read_stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where nothing is stored yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _hour(us: Column) -> Column:
    return F.floor(us / F.lit(3600 * MICROS))


def write_hours(rows: DataFrame, path: str, batch_id: int) -> None:
    """Appends a batch to a table in folders of event hours; a repeated batch replaces its own part of each."""
    (rows.withColumns({"hour": _hour(F.col("us")), "batch": F.lit(batch_id)}).repartition("hour").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("hour", "batch").parquet(path))


def read_hours(spark: SparkSession, path: str, low_us: int, high_us: int) -> DataFrame | None:
    """The rows of the event hours from ``low_us`` to ``high_us``.

    Only the folders of those hours are listed and read, so the cost does not grow with the age of the table.
    """
    conf, files = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs
    store = files.Path(path).getFileSystem(conf)
    hours = range(low_us // (3600 * MICROS), high_us // (3600 * MICROS) + 1)
    there = [folder for folder in (f"{path}/hour={h}" for h in hours) if store.exists(files.Path(folder))]
    if not there:
        return None
    return spark.read.option("basePath", path).parquet(*there).where(
        F.col("us").between(low_us, high_us)).drop("hour")


def live_history(history: DataFrame, newest_us, ttl_seconds: int = CUSTOMER_TTL_SECONDS) -> DataFrame:
    """State expiry: only rows that a trailing window can still reach."""
    return history.where(F.col("us") >= newest_us - F.lit(ttl_seconds * MICROS))


def micro_batch_features(batch: DataFrame, history: DataFrame | None,
                         known_devices: DataFrame | None = None,
                         known_merchants: DataFrame | None = None,
                         last_places: DataFrame | None = None, once: bool = False) -> DataFrame:
    """Features of the batch rows given what came before; one row per new transaction.

    ``once``: the batch is a staged table of one row per transaction. The rows that the windows see are staged here,
    as every group of features reads them.

    ``history`` may be cut to :func:`live_history` when the lifetime tables are
    given: pairs seen before the batch, and each customer's last located row.
    Rows already stored are dropped from the batch, so a replay is harmless.
    """
    batch = with_micros(batch)
    batch = batch if once else batch.dropDuplicates(["transaction_id"])
    if history is None:
        return build_feature_vector(batch if once else stage(batch, "rows"), known_devices=known_devices,
                                    known_merchants=known_merchants)
    fresh = batch.join(history.select("transaction_id"), "transaction_id", "left_anti")
    earlier = history.select(*fresh.columns)
    if last_places is not None:
        # Older located rows stand for their customer; no trailing window reaches them.
        earlier = earlier.unionByName(last_places.select(*fresh.columns))
    both = (earlier.withColumn("_new", F.lit(False))
            .unionByName(fresh.withColumn("_new", F.lit(True))))
    made = build_feature_vector(stage(both, "rows"), known_devices=known_devices, known_merchants=known_merchants,
                                keep=("_new",))
    return made.where("_new").drop("_new")


def _located(df: DataFrame, per_hour: bool = False) -> DataFrame:
    """The last row with a known location per customer, or per customer and hour.

    Hours are kept in the table so that a later batch with older rows still finds the
    place that was the last one then.
    """
    rows = df.where(known_location(F.col("location_lat"), F.col("location_lng")))
    if not per_hour:
        return latest_per_key(rows, ["customer_id"], ["us", "transaction_id"])
    return latest_per_key(rows.withColumn("_hour", _hour(F.col("us"))), ["customer_id", "_hour"], ["us", "transaction_id"]).drop("_hour")


def stream_features(stream: DataFrame, root: str, checkpoint: str):
    """Runs the feature stream over the available input.

    State lies in tables under ``root``: rows by event hour and batch, the (customer, device) and
    (customer, merchant) pairs seen (:mod:`first_seen`), and last located rows by hour. A batch reads
    the hours from 25 before its first row to its last, and the pairs of its customers' buckets; older
    rows act through the pair and location tables. Every batch overwrites its own folders, so a batch
    repeated after a failure replaces its output. Tables staged for a batch go with it.
    """
    spark = stream.sparkSession

    def earlier(table: str, batch_id: int) -> DataFrame | None:
        df = read_stored(spark, f"{root}/{table}")
        return None if df is None else df.where(F.col("batch") != batch_id).drop("batch")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        with staging_area(spark):
            one_batch(batch, batch_id)

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        batch = stage(with_micros(batch).dropDuplicates(["transaction_id"]), "batch")
        put = lambda df, table: df.write.mode("overwrite").parquet(f"{root}/{table}/batch={batch_id}")
        ends = batch.agg(F.min("us").alias("first"), F.max("us").alias("last")).head()
        if ends["first"] is None:
            return
        low = ends["first"] - CUSTOMER_TTL_SECONDS * MICROS
        rows, places = read_hours(spark, f"{root}/history", low, ends["last"]), earlier("places", batch_id)
        pairs = {c: known_pairs(batch, c, f"{root}/pairs_{c}", batch_id) for c in ("device_fingerprint", "merchant_id")}
        live = None if rows is None else rows.where(F.col("batch") != batch_id).drop("batch")
        last = None
        if places is not None:
            # Cut first: a late row's last place is the newest before the live rows.
            last = _located(places.where(F.col("us") < low))
            live = last.limit(0) if live is None else live
        put(micro_batch_features(batch, live, pairs["device_fingerprint"], pairs["merchant_id"], last, once=True),
            "features")
        for column in pairs:
            add_pairs(batch, column, f"{root}/pairs_{column}", batch_id)
        put(_located(batch, per_hour=True), "places")
        write_hours(batch, f"{root}/history", batch_id)

    return run_available(stream, on_batch, checkpoint)


def run_available(stream: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str):
    query = (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def stream_dedupe(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row per transaction id within the watermark."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["transaction_id"])


def dual_write(features: DataFrame, batch_id: int, root: str) -> None:
    """Online and offline rows of one batch, each replacing the same batch's output."""
    online = publish_online(features, F.current_timestamp(), ONLINE_TTL_SECONDS)
    online.write.mode("overwrite").parquet(f"{root}/online/batch={batch_id}")
    feature_snapshots(features).write.mode("overwrite").parquet(f"{root}/offline/batch={batch_id}")


def atomic_dual_write(features: DataFrame, batch_id: int, root: str, now: Column) -> None:
    """Online upsert and offline rows of one batch, visible together by one commit record.

    Readers are :func:`riskloom.sources.online_store.read_live` or ``lookup`` on ``root`` and :func:`read_offline`. What a
    failed attempt has written before the record stays unseen, and the repeated batch replaces it.
    """
    if batch_id in committed(features.sparkSession, root):
        return
    feature_snapshots(features).write.mode("overwrite").parquet(f"{root}/offline/batch={batch_id}")
    online = merge_online(publish_online(features, now, ONLINE_TTL_SECONDS), root, batch_id, now)
    commit(online, root, batch_id)


def read_offline(spark: SparkSession, root: str) -> DataFrame | None:
    """The offline rows of committed batches; None before the first one."""
    paths = [f"{root}/offline/batch={batch}" for batch in committed(spark, root)]
    return spark.read.option("basePath", f"{root}/offline").parquet(*paths) if paths else None


def stream_score(scored: DataFrame) -> DataFrame:
    """Scored stream (transaction_id, risk_score, ...) to keyed JSON alerts; stateless."""
    return flagged_events(risk_tier(scored))


def rate_limit_audit(df: DataFrame, key: str = "customer_id", window_seconds: int = 60,
                     limit: int = 60) -> DataFrame:
    """Requests per client in the trailing window; rejected requests count too."""
    counted = trailing_count(df, key, window_seconds, "requests", keep=[key])
    return counted.withColumn("limited", F.col("requests") > limit)


def stream_device_count(batch: DataFrame, history: DataFrame | None) -> DataFrame:
    """Trailing hour per device for a micro-batch; needs two hours of history at most."""
    batch = with_micros(batch)
    cols = ["transaction_id", "device_fingerprint", "us"]
    rows = batch.select(*cols).withColumn("_new", F.lit(True))
    if history is not None:
        oldest = batch.agg(F.min("us")).scalar()
        live = live_history(history, oldest, DEVICE_TTL_SECONDS)
        rows = rows.unionByName(live.select(*cols).withColumn("_new", F.lit(False)))
    counted = trailing_count(rows, "device_fingerprint", 3600, "device_txn_count", keep=["_new"])
    return counted.where("_new").drop("_new")


def stream_device_counts(stream: DataFrame, root: str, checkpoint: str):
    """Trailing hour per device as a stream; each batch keeps its rows by event hour and reads the two hours it needs."""
    spark = stream.sparkSession
    columns = ["transaction_id", "device_fingerprint", "us"]

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        with staging_area(spark):
            batch = stage(with_micros(batch).dropDuplicates(["transaction_id"]), "batch")
            ends = batch.agg(F.min("us").alias("first"), F.max("us").alias("last")).head()
            if ends["first"] is None:
                return
            rows = read_hours(spark, f"{root}/history", ends["first"] - DEVICE_TTL_SECONDS * MICROS, ends["last"])
            history = None if rows is None else rows.where(F.col("batch") < batch_id).drop("batch")
            stream_device_count(batch, history).write.mode("overwrite").parquet(f"{root}/counts/batch={batch_id}")
            write_hours(batch.select(*columns), f"{root}/history", batch_id)

    return run_available(stream, on_batch, checkpoint)


def stream_dual_write(features: DataFrame, root: str, checkpoint: str):
    """The feature stream into the online and the offline store."""
    return run_available(features, lambda batch, batch_id: dual_write(batch, batch_id, root), checkpoint)


def alerts_of(features: DataFrame, model, version: str, names: list[str]) -> DataFrame:
    """Features to keyed alerts that carry them: model score, tier, flag."""
    from riskloom.operators.scoring import score

    flagged = risk_tier(score(features, model, version)).where("was_flagged")
    return flagged_events(flagged.join(features.select("transaction_id", *names), "transaction_id"), names)


def stream_alerts(features: DataFrame, model, version: str, names: list[str], root: str, checkpoint: str):
    """The feature stream through a fitted model into alerts, one folder per batch."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        alerts_of(batch, model, version, names).write.mode("overwrite").parquet(f"{root}/alerts/batch={batch_id}")

    return run_available(features, on_batch, checkpoint)


def saved_models(folder: str) -> Callable[[str], object]:
    """A loader of MLlib pipelines saved under ``folder``/version."""
    from pyspark.ml import PipelineModel

    return lambda version: PipelineModel.load(f"{folder}/{version}")


def serving_config(spark: SparkSession, model_name: str, registry: str, split_log: str) -> DataFrame:
    """The routing in force now: the registry's production version as champion, the last accepted split request.

    Without a production version the default champion serves; without a request, or with a canary that has become
    the champion, all traffic is the champion's.
    """
    log, requests = read_stored(spark, registry), read_stored(spark, split_log)
    rows = [] if log is None else K.current_production(log).where(F.col("model_name") == model_name).head(1)
    champion = rows[0]["version"] if rows else K.CHAMPION
    if requests is None:
        return K.split_config(spark, None, 0.0, champion=champion)
    config = K.current_split(K.split_log(requests)[0], champion=champion)
    same = F.col("canary_version") == F.col("champion_version")
    return config.withColumns({
        "canary_percentage": F.when(same, 0.0).otherwise(F.col("canary_percentage")),
        "shadow_mode": F.when(same, False).otherwise(F.col("shadow_mode")),
        "is_active": F.when(same, False).otherwise(F.col("is_active"))})


def score_routed(features: DataFrame, config: DataFrame, load: Callable[[str], object], names: list[str]) -> DataFrame:
    """Every row scored by the version that its customer is routed to, with tier and ``payload`` (the named features).

    In shadow mode the champion decides and ``shadow_score`` is the candidate's. Each model sees only its own rows.
    """
    from riskloom.operators.scoring import score

    setting = config.head()
    keep = ("transaction_id", "customer_id", "is_canary", "payload")
    routed = K.canary_route(features, config).withColumn("payload", F.struct(*names))
    by = lambda version, rows: score(rows, load(version), version, keep)
    champion = by(setting["champion_version"], routed.where(~F.col("is_canary")))
    if not setting["is_active"] or not setting["canary_version"]:
        return risk_tier(champion.withColumn("shadow_score", F.lit(None).cast("double")))
    if setting["shadow_mode"]:
        other = by(setting["canary_version"], routed).select("transaction_id", F.col("risk_score").alias("shadow_score"))
        return risk_tier(champion.join(other, "transaction_id", "left"))
    canary = by(setting["canary_version"], routed.where("is_canary"))
    return risk_tier(champion.unionByName(canary).withColumn("shadow_score", F.lit(None).cast("double")))


def stream_versioned_alerts(features: DataFrame, load: Callable[[str], object], model_name: str, registry: str, split_log: str,
                            names: list[str], root: str, checkpoint: str):
    """The feature stream into scores and alerts, by the versions that registry and split log name when a batch starts.

    A promotion or a new split so reaches the running stream with its next batch. The choice is written before the
    batch is scored, and a repeated batch takes it from there: it scores with the same versions and replaces its own
    folders. ``features`` has customer_id and one row per transaction.
    """
    from riskloom.operators.scoring import append_scores

    spark, loaded = features.sparkSession, {}

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        with staging_area(spark):
            choice = f"{root}/choices/batch={batch_id}"
            if read_stored(spark, choice) is None:
                serving_config(spark, model_name, registry, split_log).coalesce(1).write.mode("overwrite").parquet(choice)
            config = read_stored(spark, choice)
            setting = config.head()
            used = {setting["champion_version"], setting["canary_version"]}
            for version in set(loaded) - used:  # versions out of service leave the driver
                del loaded[version]

            def cached(version: str):
                if version not in loaded:
                    loaded[version] = load(version)
                return loaded[version]

            scored = stage(score_routed(stage(batch, "batch"), config, cached, names), "scored")
            append_scores(scored, f"{root}/scores", batch_id)
            alerts = flagged_events(scored, ["payload.*"])
            routes = scored.select(F.col("transaction_id").alias("key"), "model_version", "is_canary")
            alerts.join(routes, "key").write.mode("overwrite").parquet(f"{root}/alerts/batch={batch_id}")

    return run_available(features, on_batch, checkpoint)


def canary_monitor(observations: DataFrame, root: str, batch_id: int) -> None:
    """foreachBatch body: health of the latest observations, an audit row per trip, and the reset it causes.

    ``root``/config is the log of split requests. A trip appends the request that routes everything to the champion, so
    the next batch finds no canary and cannot trip again. The last observations of each arm are carried over. Every
    folder is written per batch and read only below the batch's number, so a repeated batch replaces its own output.
    """
    with staging_area(observations.sparkSession):
        _canary_monitor(observations, root, batch_id)


def _canary_monitor(observations: DataFrame, root: str, batch_id: int) -> None:
    spark = observations.sparkSession

    def before(table: str) -> DataFrame | None:
        df = read_stored(spark, f"{root}/{table}")
        return None if df is None else df.where(F.col("batch") < batch_id)

    put = lambda df, table: df.write.mode("overwrite").parquet(f"{root}/{table}/batch={batch_id}")
    log = before("config").drop("batch")
    carried = before("recent")
    rows = stage(observations, "observations")
    if carried is not None:
        rows = rows.unionByName(carried.where(F.col("batch") == batch_id - 1).drop("batch"))
    config = stage(K.current_split(log), "config")
    tripped = stage(K.rollback_decision(K.canary_health(rows), config).where("rolled_back"), "tripped")
    newest = F.greatest(rows.agg(F.max("us")).scalar(), log.agg(F.max("us") + 1).scalar())
    put(tripped.withColumn("at_us", newest), "audit")
    put(K.reset_request(config, newest).join(tripped.select("rolled_back"), how="inner", on=F.lit(True)).drop("rolled_back"), "config")
    put(K.recent_observations(rows), "recent")


def stream_canary_monitor(observations: DataFrame, root: str, checkpoint: str):
    return run_available(observations, lambda batch, batch_id: canary_monitor(batch, root, batch_id), checkpoint)
