"""Scores, risk tiers, alerts and serving metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.numeric import clip, round_dp
from riskloom.operators.ranking import latest_per_key
from riskloom.schemas import FEATURES, FEATURE_TYPES

LOW_CUT, HIGH_CUT, CRITICAL_CUT = 0.30, 0.60, 0.85

# Histogram bounds in seconds.
SCORING_BOUNDS = [0.001, 0.005, 0.010, 0.025, 0.050, 0.100, 0.150, 0.250, 0.500]
FETCH_BOUNDS = [0.0005, 0.001, 0.002, 0.005, 0.010, 0.025, 0.050]
INVESTIGATION_BOUNDS = [0.5, 1.0, 2.0, 3.0, 4.0, 5.0, 7.5, 10.0, 15.0]


def model_input(features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The 17 columns as doubles in contract order; absent columns become 0.0."""
    columns = [(F.col(f).cast("double") if f in features.columns else F.lit(0.0)).alias(f)
               for f in FEATURES]
    return features.select(*keep, *columns)


def prepare_xy(features: DataFrame, label: str = "is_fraud", keep: Sequence[str] = ()) -> DataFrame:
    """Training columns: missing -> 0, infinities -> +-1e6, label as int (absent -> 0)."""
    missing = [f for f in FEATURES if f not in features.columns]
    if missing:
        raise KeyError(f"missing feature columns: {missing}")
    def clean(f: str) -> Column:
        x = F.col(f).cast("double")
        return (F.when(x.isNull() | F.isnan(x), F.lit(0.0))
                .when(x == float("inf"), F.lit(1e6)).when(x == float("-inf"), F.lit(-1e6))
                .otherwise(x))
    y = F.coalesce(F.col(label).cast("int"), F.lit(0)) if label in features.columns else F.lit(0)
    return features.select(*keep, *[clean(f).alias(f) for f in FEATURES], y.alias("y"))


def score(features: DataFrame, model, version: str, keep: Sequence[str] = ("transaction_id",)
          ) -> DataFrame:
    """Fraud probability of a fitted MLlib pipeline, clipped to [0, 1], 4 places."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(model_input(features, keep))
    p = clip(vector_to_array("probability")[1], 0.0, 1.0)
    return scored.select(*keep, p.alias("p"), round_dp(p, 4).alias("risk_score"),
                         F.lit(version).alias("model_version"))


def risk_label(p: Column, low: float = LOW_CUT, high: float = HIGH_CUT,
               critical: float = CRITICAL_CUT) -> Column:
    return (F.when(p < F.lit(low), "low").when(p < F.lit(high), "medium")
            .when(p < F.lit(critical), "high").otherwise("critical"))


def risk_tier(df: DataFrame, low: float = LOW_CUT, high: float = HIGH_CUT,
              critical: float = CRITICAL_CUT) -> DataFrame:
    """Adds risk_label, was_flagged and threshold_used from risk_score."""
    p = F.col("risk_score")
    return df.withColumns({
        "risk_label": risk_label(p, low, high, critical),
        "was_flagged": p >= F.lit(high),
        "threshold_used": F.when(p < F.lit(low), F.lit(low)).when(p < F.lit(critical), F.lit(high))
        .otherwise(F.lit(critical)),
    })


def alert_priority(label: Column) -> Column:
    return F.when(label == "critical", "URGENT").otherwise("NORMAL")


def flagged_events(scored: DataFrame, feature_columns: Sequence[str] = ()) -> DataFrame:
    """Keyed JSON alerts of flagged rows, ready for a topic (key, value)."""
    payload = F.struct(
        "transaction_id", "risk_score", "risk_label",
        alert_priority(F.col("risk_label")).alias("priority"),
        F.struct(*feature_columns).alias("features") if feature_columns
        else F.lit("{}").alias("features"))
    return scored.where("was_flagged").select(F.col("transaction_id").alias("key"),
                                              F.to_json(payload).alias("value"))


def fraud_scores(scored: DataFrame) -> DataFrame:
    """The eight audit columns of a score; absent latencies become 0.0."""
    zero = lambda c: F.col(c) if c in scored.columns else F.lit(0.0).alias(c)
    return scored.select("transaction_id", "model_version", "risk_score", "risk_label",
                         "threshold_used", "was_flagged", zero("scoring_latency_ms"),
                         zero("feature_fetch_latency_ms"))


def append_scores(scored: DataFrame, path: str, batch_id: int) -> None:
    """Adds the scores of a batch to the audit table; a repeated batch replaces its own rows and no others."""
    fraud_scores(scored).write.mode("overwrite").parquet(f"{path}/batch={int(batch_id)}")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """The audit table with the ``batch`` of each row."""
    return spark.read.parquet(path)


def tier_counts(scores: DataFrame) -> DataFrame:
    return scores.groupBy("risk_label", "model_version").agg(F.count(F.lit(1)).alias("n"))


def latency_histogram(df: DataFrame, seconds: Column, bounds: Sequence[float], by: Sequence[str]
                      ) -> DataFrame:
    """Cumulative bucket counts with sum and count, one row per group and bound.

    All bounds are conditional sums of one aggregation; the last bucket is +Inf.
    """
    rows = df.select(*by, seconds.alias("_s"))
    aggs = [F.sum(F.when(F.col("_s") <= F.lit(b), 1).otherwise(0)).cast("bigint").alias(f"_b{i}")
            for i, b in enumerate(bounds)]
    wide = rows.groupBy(*by).agg(
        *aggs, F.count("_s").alias("n"),
        # whole microseconds, so the sum does not depend on row order
        F.sum(F.floor(F.col("_s") * F.lit(1e6) + F.lit(0.5)).cast("bigint")).alias("total_us"))
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_b{i}").alias("bucket_count"))
             for i, b in enumerate(bounds)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("n").alias("bucket_count")))
    return wide.select(*by, "n", "total_us", F.inline(F.array(*cells)))


def pattern_breakdown(df: DataFrame) -> DataFrame:
    """Rows and share per fraud pattern; ``overall_fraud_pct`` repeats on each row."""
    counts = df.groupBy(F.coalesce("fraud_pattern", F.lit("none")).alias("fraud_pattern")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_fraud").cast("bigint")).alias("f"))
    total = counts.agg((F.sum("f").cast("double") * F.lit(100.0) / F.sum("n").cast("double")).alias("pct"))
    return counts.select("fraud_pattern", "n", total.scalar().alias("overall_fraud_pct"))


# Online feature rows ------------------------------------------------------------------

# Defaults of a stored online feature row.
ONLINE_DEFAULTS = {f: ("1" if t == "bigint" else "0.0" if t == "double" else "False")
                   for f, t in FEATURE_TYPES.items()} | {"hour_of_day": "12"}


def publish_online(features: DataFrame, now: Column, ttl_seconds: int = 86400) -> DataFrame:
    """Online rows: string-valued fields per transaction and an expiry time."""
    def text(name: str) -> Column:
        kind = FEATURE_TYPES.get(name)
        if kind == "boolean":
            return F.when(F.col(name), "True").otherwise("False")
        return F.col(name).cast("string")
    names = ["transaction_id", "customer_id", *FEATURES, "feature_version"]
    fields = F.create_map(*[x for n in names for x in (F.lit(n), text(n))])
    return features.select("transaction_id", fields.alias("fields"),
                           (now + F.expr(f"INTERVAL {ttl_seconds} SECONDS")).alias("expires_at"))


def live_online(store: DataFrame, as_of: Column) -> DataFrame:
    """The store as its readers see it: expired rows gone, the latest publication per transaction.

    Publications that expire at the same moment are told apart by their fields, so the
    choice does not depend on the order of the rows.
    """
    live = store.where(F.col("expires_at") > as_of).withColumn("_text", F.to_json("fields"))
    return latest_per_key(live, ["transaction_id"], ["expires_at", "_text"]).drop("_text")


def lookup_online(ids: DataFrame, store: DataFrame, as_of: Column) -> DataFrame:
    """Live online rows of the wanted ids, cast back with per-field defaults."""
    live = live_online(store, as_of).select("transaction_id", "fields")
    return online_values(ids.select("transaction_id").join(live, "transaction_id", "left"))


def online_values(found: DataFrame) -> DataFrame:
    """transaction_id and ``fields`` (null where nothing is stored) to typed features, with per-field defaults."""
    columns = []
    for name in FEATURES:
        raw = F.coalesce(F.col("fields")[name], F.lit(ONLINE_DEFAULTS[name]))
        value = (F.lower(raw) == "true") if FEATURE_TYPES[name] == "boolean" else raw.cast(
            FEATURE_TYPES[name])
        columns.append(F.when(F.col("fields").isNotNull(), value).alias(name))
    return found.select("transaction_id", F.col("fields")["customer_id"].alias("customer_id"),
                        *columns, F.col("fields").isNotNull().alias("found"))


def fetch_or_fallback(events: DataFrame, store: DataFrame) -> DataFrame:
    """Stored features of each event, or safe defaults made from the event itself.

    A transaction stored more than once counts with its latest row, by the first of
    ``computed_at`` and ``expires_at`` that the store has, then by the features.
    """
    order = [c for c in ("computed_at", "expires_at") if c in store.columns][:1]
    once = latest_per_key(store.select("transaction_id", *order, *FEATURES), ["transaction_id"], [*order, *FEATURES])
    stored = once.select("transaction_id", F.struct(*FEATURES).alias("_s"))
    one = F.lit(1).cast("bigint")
    fallback = {f: (one if t == "bigint" else F.lit(0.0) if t == "double" else F.lit(False))
                for f, t in FEATURE_TYPES.items()}
    fallback |= {
        "avg_amount_1hr": F.col("amount"), "max_amount_24hr": F.col("amount"),
        "merchant_avg_amount": F.lit(500.0), "merchant_fraud_rate": F.lit(0.015),
        "is_international": F.coalesce("is_international", F.lit(False)),
        "hour_of_day": F.hour("timestamp").cast("bigint"),
        "is_weekend": F.weekday("timestamp") >= 5}
    hit = F.col("_s").isNotNull()
    return events.join(stored, "transaction_id", "left").select(
        "transaction_id", "customer_id",
        *[F.when(hit, F.col(f"_s.{f}")).otherwise(fallback[f]).alias(f) for f in FEATURES],
        (~hit).alias("is_fallback"))
