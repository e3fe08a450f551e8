"""Canary routing, rollback rules and the model registry on event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.functions.hashing import canary_bucket
from riskloom.functions.numeric import round_dp, safe_ratio
from riskloom.operators.ranking import last_n

CHAMPION = "baseline_v1"
MAX_P99_MS, MAX_ERROR_RATE, MAX_FLAG_MULTIPLE, MIN_SAMPLES = 10.0, 0.005, 3.0, 20
DEFAULT_CHAMPION_FLAG_RATE = 0.025


def split_log(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) split requests; a percentage must lie in 0..100."""
    ok = F.col("canary_percentage").between(0.0, 100.0)
    return requests.where(ok), requests.where(~F.coalesce(ok, F.lit(False)))


def current_split(accepted: DataFrame, order: tuple[str, ...] = ("us", "event_id"),
                  champion: str = CHAMPION) -> DataFrame:
    """One-row configuration: the latest request, and the latest version ever named."""
    at = F.struct(*order)
    named = F.col("canary_version").isNotNull() & (F.col("canary_version") != "")
    pct, shadow = (F.max_by("canary_percentage", at), F.max_by("shadow_mode", at))
    return accepted.agg(
        F.lit(champion).alias("champion_version"),
        F.max_by("canary_version", F.when(named, at)).alias("canary_version"),
        F.coalesce(pct, F.lit(0.0)).alias("canary_percentage"),
        F.coalesce(shadow, F.lit(False)).alias("shadow_mode"),
    ).withColumn("is_active", (F.col("canary_percentage") > 0) | F.col("shadow_mode"))


def split_config(spark, canary_version: str | None, canary_percentage: float,
                 shadow_mode: bool = False, champion: str = CHAMPION) -> DataFrame:
    """A validated one-row configuration."""
    if not 0.0 <= canary_percentage <= 100.0:
        raise ValueError(f"canary percentage must lie in 0..100, got {canary_percentage}")
    return spark.range(1).select(
        F.lit(champion).alias("champion_version"),
        F.lit(canary_version).cast("string").alias("canary_version"),
        F.lit(float(canary_percentage)).alias("canary_percentage"),
        F.lit(shadow_mode).alias("shadow_mode"),
        F.lit(canary_percentage > 0 or shadow_mode).alias("is_active"))


def reset_to_champion(config: DataFrame) -> DataFrame:
    return config.withColumns({"canary_percentage": F.lit(0.0), "shadow_mode": F.lit(False),
                               "is_active": F.lit(False)})


def reset_request(config: DataFrame, us: Column) -> DataFrame:
    """The split request that sends all traffic back to the champion, as a row of the configuration log."""
    reset = reset_to_champion(config)
    return reset.select(us.cast("bigint").alias("us"), F.lit(0).cast("bigint").alias("event_id"), "canary_version",
                        "canary_percentage", "shadow_mode")


def _setting(config: DataFrame, name: str) -> Column:
    return config.select(name).scalar()


def canary_route(df: DataFrame, config: DataFrame) -> DataFrame:
    """Adds model_version and is_canary; sticky per customer."""
    version = _setting(config, "canary_version")
    pct = _setting(config, "canary_percentage")
    to_canary = (_setting(config, "is_active") & version.isNotNull() & (version != "")
                 & (pct > 0) & ~_setting(config, "shadow_mode")
                 & (canary_bucket(F.col("customer_id")).cast("double") < pct))
    to_canary = F.coalesce(to_canary, F.lit(False))
    return df.withColumn("is_canary", to_canary).withColumn(
        "model_version", F.when(F.col("is_canary"), version)
        .otherwise(_setting(config, "champion_version")))


def shadow_score(df: DataFrame, config: DataFrame) -> DataFrame:
    """Keeps the champion's score as the decision; adds the candidate's in shadow mode.

    ``df`` carries both scores (two model transforms of the same rows).
    """
    on = (_setting(config, "is_active") & _setting(config, "shadow_mode")
          & _setting(config, "canary_version").isNotNull())
    return df.withColumns({
        "decision_score": F.col("risk_score"),
        "shadow_score": F.when(F.coalesce(on, F.lit(False)), F.col("candidate_score"))})


def recent_observations(observations: DataFrame, window: int = 200) -> DataFrame:
    """The last ``window`` observations of each arm."""
    return last_n(observations, ["arm"], [F.col("us").desc(), F.col("transaction_id").desc()],
                  window, F.col("transaction_id"))


def canary_health(observations: DataFrame, window: int = 200) -> DataFrame:
    """Health of each arm over its last ``window`` observations.

    An arm may hold nearly all rows: the cut to the last ``window`` is made per
    (arm, salt) first, so the final window sees at most 64 x ``window`` rows.
    """
    recent = recent_observations(observations, window)
    rate = lambda c: F.avg(F.col(c).cast("double"))
    return recent.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile("latency_ms", 0.5).alias("p50"), F.percentile("latency_ms", 0.99).alias("p99"),
        rate("is_error").alias("error_rate"), rate("was_flagged").alias("flag_rate"))


def health_report(health: DataFrame) -> DataFrame:
    return health.select(
        "arm", "n", round_dp(F.col("p50"), 2).alias("p50_latency_ms"),
        round_dp(F.col("p99"), 2).alias("p99_latency_ms"),
        round_dp(F.col("error_rate"), 4).alias("error_rate"),
        round_dp(F.col("flag_rate"), 4).alias("flag_rate"))


def rollback_decision(health: DataFrame, config: DataFrame, max_p99_ms: float = MAX_P99_MS,
                      max_error_rate: float = MAX_ERROR_RATE,
                      max_flag_multiple: float = MAX_FLAG_MULTIPLE,
                      min_samples: int = MIN_SAMPLES) -> DataFrame:
    """One audit row: the canary's figures, the broken rules and whether to roll back."""
    of = lambda arm, c: F.max(F.when(F.col("arm") == arm, F.col(c)))
    row = health.agg(
        F.coalesce(of("canary", "n"), F.lit(0)).alias("n"),
        of("canary", "p99").alias("p99"), of("canary", "error_rate").alias("err"),
        of("canary", "flag_rate").alias("flag"),
        F.coalesce(of("champion", "flag_rate"), F.lit(DEFAULT_CHAMPION_FLAG_RATE)).alias("champ"))
    row = row.withColumns({"active": _setting(config, "is_active"),
                           "canary_version": F.coalesce(_setting(config, "canary_version"),
                                                        F.lit("unknown")),
                           "champion_version": _setting(config, "champion_version")})
    pct = lambda c: F.format_string("%.2f", F.col(c) * 100)
    reasons = F.array_compact(F.array(
        F.when(F.col("p99") > max_p99_ms, F.concat(
            F.lit("Canary p99 latency ("), F.format_string("%.2f", "p99"),
            F.lit(f"ms) breached {max_p99_ms}ms SLA"))),
        F.when(F.col("err") > max_error_rate, F.concat(
            F.lit("Canary error rate ("), pct("err"),
            F.lit(f"%) exceeded {max_error_rate * 100:.2f}% threshold"))),
        F.when((F.col("champ") > 0) & (F.col("flag") > F.col("champ") * max_flag_multiple), F.concat(
            F.lit("Canary false-positive rate ("), pct("flag"),
            F.lit(f"%) spiked >{max_flag_multiple}x champion baseline ("), pct("champ"), F.lit("%)")))))
    armed = F.coalesce(F.col("active"), F.lit(False)) & (F.col("n") >= min_samples)
    row = row.withColumn("reasons", F.when(armed, reasons).otherwise(F.array().cast("array<string>")))
    return row.select(
        "canary_version", "champion_version", F.col("n").alias("samples"),
        F.concat_ws("; ", "reasons").alias("reason"), (F.size("reasons") > 0).alias("rolled_back"),
        round_dp(F.col("p99"), 2).alias("p99_latency_ms"), round_dp(F.col("err"), 4).alias("error_rate"),
        round_dp(F.col("flag"), 4).alias("flag_rate"), round_dp(F.col("champ"), 4).alias("champ_flag_rate"))


def registry_state(log: DataFrame) -> DataFrame:
    """Current status per (model, version) from the registry event log.

    ``log``: model_name, version, action (register, canary, promote, rollback),
    gate_passed, us, event_id. A promotion counts only when its gates passed; a
    rollback always counts. The latest effective one names production, versions
    that were production before are retired.
    """
    at = F.struct("us", "event_id")
    takes_over = (((F.col("action") == "promote") & F.coalesce("gate_passed", F.lit(False)))
                  | (F.col("action") == "rollback"))
    versions = log.groupBy("model_name", "version").agg(
        F.max(F.when(takes_over, at)).alias("took_over"),
        F.max(F.when(F.col("action") == "canary", 1)).alias("had_canary"),
        F.sum(F.when((F.col("action") == "promote") & ~F.coalesce("gate_passed", F.lit(False)), 1)
              .otherwise(0)).cast("bigint").alias("blocked_promotions"))
    production = versions.groupBy("model_name").agg(
        F.max_by("version", "took_over").alias("_production"), F.max("took_over").alias("_any"))
    status = (F.when(F.col("_any").isNotNull() & (F.col("version") == F.col("_production")), "production")
              .when(F.col("took_over").isNotNull(), "retired")
              .when(F.col("had_canary") == 1, "canary").otherwise("candidate"))
    return versions.join(production, "model_name").select(
        "model_name", "version", status.alias("status"), "blocked_promotions",
        F.col("took_over.us").alias("promoted_us"))


def current_production(log: DataFrame) -> DataFrame:
    return registry_state(log).where(F.col("status") == "production").select("model_name", "version")


def promotion_event(gate1: DataFrame, gate2: DataFrame, model_name: str, version: str, us: int, event_id: int) -> DataFrame:
    """A registry log row whose gate flag comes from the two evaluated gates."""
    passed = F.coalesce(F.col("passed") & gate2.select("is_promotable").scalar(), F.lit(False))
    return gate1.select(F.lit(model_name).alias("model_name"), F.lit(version).alias("version"),
                        F.lit("promote").alias("action"), passed.alias("gate_passed"),
                        F.lit(us).cast("bigint").alias("us"), F.lit(event_id).cast("bigint").alias("event_id"))


def rollback_event(spark: SparkSession, model_name: str, version: str, us: int, event_id: int) -> DataFrame:
    """A registry log row that puts a version into production without gates."""
    return spark.range(1).select(
        F.lit(model_name).alias("model_name"), F.lit(version).alias("version"), F.lit("rollback").alias("action"),
        F.lit(None).cast("boolean").alias("gate_passed"), F.lit(us).cast("bigint").alias("us"),
        F.lit(event_id).cast("bigint").alias("event_id"))


def append_registry(event: DataFrame, path: str) -> None:
    """Adds rows to the registry log; the log is never rewritten."""
    event.write.mode("append").parquet(path)


SLICE_US = 3_600_000_000


def _neighbour(df: DataFrame, value: str, order: tuple[str, ...], out: str, ahead: bool = False) -> DataFrame:
    """Adds the nearest non-null ``value`` strictly before each row (behind it with ``ahead``) among its model's rows.

    A model may hold most of a log, so rows are compared inside hours, and hours by one row each.
    """
    direct = (lambda c: F.col(c).desc()) if ahead else F.col
    known = F.when(F.col(value).isNotNull(), F.struct(*order))
    df = df.withColumn("_slice", F.floor(F.col("us") / F.lit(SLICE_US)))
    inside = Window.partitionBy("model_name", "_slice").orderBy(*map(direct, order)).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy("model_name").orderBy(direct("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    edge = F.min_by if ahead else F.max_by
    hours = df.groupBy("model_name", "_slice").agg(edge(value, known).alias("_edge")).select(
        "model_name", "_slice", F.last("_edge", ignorenulls=True).over(across).alias("_carried"))
    return (df.withColumn("_inside", F.last(value, ignorenulls=True).over(inside)).join(hours, ["model_name", "_slice"])
            .withColumn(out, F.coalesce("_inside", "_carried")).drop("_slice", "_inside", "_carried"))


def production_intervals(log: DataFrame) -> DataFrame:
    """Times in production: model_name, version, from_us, event_id (what began it) and to_us (null: still in production).

    A promotion whose gates passed and every rollback put a version into production until another version follows;
    naming the present one again changes nothing. Of changes in one microsecond the last by event_id holds, the others
    have from_us = to_us. Rows without model, version, time or event id take no part.
    """
    takes = (((F.col("action") == "promote") & F.coalesce("gate_passed", F.lit(False))) | (F.col("action") == "rollback"))
    named = log.where(takes).select("model_name", "version", "us", "event_id").dropna().dropDuplicates()
    order = ("us", "event_id")
    began = _neighbour(named, "version", order, "_before").where("_before IS NULL OR _before <> version")
    began = began.drop("_before").withColumn("_at", F.col("us"))
    return _neighbour(began, "_at", order, "to_us", ahead=True).select(
        "model_name", "version", F.col("us").alias("from_us"), "event_id", "to_us")


def version_drift(log: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Per version that was in production: its times there and the drift snapshots taken meanwhile.

    ``snapshots``: model_name, snapshot_type (feature_drift or prediction_drift), drift_detected, drift_score, us,
    event_id. Each counts for the version in production at its time; those before the first one, and those without model
    or time, count for none. The latest of each type decides: drifted, stable, or unknown where there is none.
    """
    began = production_intervals(log)
    # A change in the same microsecond comes before the snapshot.
    changes = began.select("model_name", "version", F.col("from_us").alias("us"), "event_id", F.lit(0).alias("_kind"))
    taken = snapshots.select("model_name", "snapshot_type", "drift_detected", "drift_score", "us", "event_id",
                             F.lit(1).alias("_kind")).where("model_name IS NOT NULL AND us IS NOT NULL")
    rows = _neighbour(changes.unionByName(taken, allowMissingColumns=True), "version", ("us", "_kind", "event_id"), "_in_production")
    at = F.struct("us", "event_id")
    latest = lambda kind: F.max_by(F.coalesce("drift_detected", F.lit(False)), F.when(F.col("snapshot_type") == kind, at))
    seen = rows.where("_kind = 1 AND _in_production IS NOT NULL").groupBy("model_name", F.col("_in_production").alias("version")).agg(
        F.count(F.lit(1)).alias("snapshots"), F.count_if("drift_detected").alias("drifted_snapshots"),
        latest("feature_drift").alias("feature_drift_detected"), latest("prediction_drift").alias("prediction_drift_detected"),
        F.max_by("drift_score", at).alias("drift_score"))
    times = began.groupBy("model_name", "version").agg(
        F.count(F.lit(1)).alias("times_in_production"), F.min("from_us").alias("first_us"),
        F.coalesce(F.sum(F.col("to_us") - F.col("from_us")), F.lit(0)).alias("closed_us"),
        F.max(F.col("to_us").isNull()).alias("is_production"))
    drifted = F.coalesce("feature_drift_detected", F.lit(False)) | F.coalesce("prediction_drift_detected", F.lit(False))
    return times.join(seen, ["model_name", "version"], "left").withColumns({
        "snapshots": F.coalesce("snapshots", F.lit(0)), "drifted_snapshots": F.coalesce("drifted_snapshots", F.lit(0)),
        "drift_status": F.when(F.col("snapshots").isNull(), "unknown").when(drifted, "drifted").otherwise("stable")})
