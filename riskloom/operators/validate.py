"""Validation and normalisation of events and feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.schemas import CHANNELS, FEATURE_TYPES

REQUIRED = ["transaction_id", "customer_id", "merchant_id", "device_fingerprint", "amount", "timestamp"]


def normalize_currency(df: DataFrame) -> DataFrame:
    return df.withColumn("currency", F.upper(F.trim("currency")))


def with_defaults(df: DataFrame) -> DataFrame:
    """Missing optional fields get their defaults."""
    return df.withColumns({
        "currency": F.coalesce("currency", F.lit("INR")),
        "channel": F.coalesce("channel", F.lit("upi")),
        "merchant_category": F.coalesce("merchant_category", F.lit("general_retail")),
        "is_international": F.coalesce("is_international", F.lit(False))})


def _with_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    return df.withColumn("violations", F.array_compact(F.array(*[
        F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()])))


def _split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.size("violations") == 0
    return df.where(ok).drop("violations"), df.where(~ok)


def _finite(x: Column) -> Column:
    """False for NaN and the infinities, which sort above or below every number."""
    number = x.cast("double")
    return ~(F.isnan(number) | (F.abs(number) == float("inf")))


def event_violations(df: DataFrame) -> DataFrame:
    """Adds the list of broken rules of each event."""
    c = F.col
    rules = {f"{name} is required": c(name).isNull() for name in REQUIRED}
    rules |= {
        "amount must be positive": ~(c("amount") > 0),
        "amount must be finite": ~_finite(c("amount")),
        "currency is too long": F.length("currency") > 3,
        "channel is unknown": ~c("channel").isin(CHANNELS),
        "latitude out of range": ~c("location_lat").between(-90.0, 90.0),
        "longitude out of range": ~c("location_lng").between(-180.0, 180.0)}
    return _with_violations(df, rules)


def validate(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with reasons); the currency is normalised first."""
    return _split(event_violations(normalize_currency(df)))


def feature_violations(features: DataFrame) -> DataFrame:
    c = F.col
    floors = ["txn_count_1min", "txn_count_5min", "txn_count_1hr", "txn_count_24hr", "avg_amount_1hr",
              "max_amount_24hr", "device_txn_count", "merchant_avg_amount", "distance_from_last_txn"]
    rules = {f"{name} is negative": c(name) < 0 for name in floors}
    rules |= {f"{name} is not finite": ~_finite(c(name)) for name, kind in FEATURE_TYPES.items() if kind == "double"}
    rules |= {"unique_devices_1hr below 1": c("unique_devices_1hr") < 1,
              "merchant_fraud_rate out of range": ~c("merchant_fraud_rate").between(0.0, 1.0),
              "hour_of_day out of range": ~c("hour_of_day").between(0, 23)}
    return _with_violations(features, rules)


def validate_features(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(feature_violations(features))
