"""Maps the star-schema ``events`` table to payment transactions.

Deterministic integer arithmetic only, so that the same mapping in another SQL
engine yields the same values bit for bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.schemas import CATEGORY_RISK

BASE_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000
MIDDLE_US = BASE_US + 15 * DAY_US

# Home places form a lattice of quarter degrees, by user_id % 7; one place stands for abroad.
CITIES = [(8.0 + 3.25 * i, 70.0 + 4.5 * i) for i in range(7)]
ABROAD = (50.5, 1.25)
PATTERNS = ["velocity_burst", "impossible_travel", "account_takeover"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_as_transactions(events: DataFrame) -> DataFrame:
    """TXN columns plus us, cents, risk_score, candidate_score and latency_ms."""
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("bigint")
    # Days stay as they are; the time of day shrinks to 24 minutes in an hour of the user's own. So bursts survive,
    # day-long windows expire, and every hour and weekday occurs.
    since = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(BASE_US)
    day = F.call_function("div", since, F.lit(DAY_US))
    us = (F.lit(BASE_US) + day * F.lit(DAY_US) + (F.col("user_id") % 24) * F.lit(HOUR_US)
          + F.call_function("div", since - day * F.lit(DAY_US), F.lit(60).cast("bigint")))
    e = events.select(
        "event_id", "user_id", "event_type", k.alias("k"),
        us.alias("us"),
        F.floor((F.col("value") - F.lit(2.0)) * F.lit(100.0) + F.lit(0.5)).cast("bigint")
        .alias("cents"),
    )
    categories = F.array(*[F.lit(c) for c in CATEGORY_RISK])
    city = F.element_at(
        F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")) for a, b in CITIES]),
        (F.col("user_id") % 7 + 1).cast("int"))
    nudge = (F.col("k") % 10).cast("double") / F.lit(100.0)
    fraud = (F.col("k") < 3).cast("int")
    spread = F.col("event_id") * F.lit(7919) + F.col("k") * F.lit(31)
    spread_b = F.col("event_id") * F.lit(6007) + F.col("k") * F.lit(17)

    def place(i: str, away: float):
        return (F.when(F.col("k") % 13 == 0, F.lit(None).cast("double"))
                .when(F.col("k") % 25 == 0, F.lit(away))
                .otherwise(city[i] + nudge))

    return e.select(
        F.concat(F.lit("txn_"), F.col("event_id").cast("string")).alias("transaction_id"),
        F.concat(F.lit("cust_"), F.col("user_id").cast("string")).alias("customer_id"),
        F.concat(F.lit("merch_"), ((F.col("event_id") * 7 + F.col("k")) % 50).cast("string"))
        .alias("merchant_id"),
        (F.col("cents").cast("double") / F.lit(100.0)).alias("amount"),
        F.lit("INR").alias("currency"),
        F.when(F.col("event_type").isin("click", "view"), "upi")
        .when(F.col("event_type") == "purchase", "card")
        .when(F.col("event_type") == "signup", "imps")
        .when(F.col("event_type") == "error", "neft").alias("channel"),
        # One user in four shares devices, another one in four shares addresses.
        F.when(F.col("user_id") % 4 == 0, F.concat(
            F.lit("dev_"), ((F.col("user_id") + (F.col("k") % 3) * 11) % 97).cast("string")))
        .otherwise(F.concat(F.lit("own_"), F.col("user_id").cast("string"), F.lit("_"),
                            (F.col("k") % 3).cast("string"))).alias("device_fingerprint"),
        F.when(F.col("k") % 17 != 0, F.when(F.col("user_id") % 4 == 1, F.concat(
            F.lit("192.168."), (F.col("user_id") % 5).cast("string"), F.lit("."), (F.col("k") % 50).cast("string")))
            .otherwise(F.concat(F.lit("10."), F.col("user_id").cast("string"), F.lit("."), (F.col("k") % 5).cast("string"))))
        .alias("ip_address"),
        place("lat", ABROAD[0]).alias("location_lat"),
        place("lng", ABROAD[1]).alias("location_lng"),
        F.element_at(categories, (F.col("k") % 10 + 1).cast("int")).alias("merchant_category"),
        (F.col("k") % 25 == 0).alias("is_international"),
        F.timestamp_micros("us").alias("timestamp"),
        fraud.alias("is_fraud"),
        F.when(F.col("k") < 3, F.element_at(F.array(*[F.lit(p) for p in PATTERNS]),
                                            (F.col("k") + 1).cast("int"))).alias("fraud_pattern"),
        "us",
        "cents",
        (F.least(F.lit(10000), F.lit(6) * (spread % 1000) + F.lit(4000) * fraud).cast("double")
         / F.lit(10000.0)).alias("risk_score"),
        (F.least(F.lit(10000), F.lit(7) * (spread_b % 1000) + F.lit(3000) * fraud).cast("double")
         / F.lit(10000.0)).alias("candidate_score"),
        (((F.col("event_id") * 13 + F.col("k") * 7) % 1200).cast("double") / F.lit(100.0))
        .alias("latency_ms"),
        "event_id",
        "k",
    )


def raw_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_transactions(read_table(spark, sf_dir, "events"))


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions with a positive amount (the others fail validation)."""
    return raw_transactions(spark, sf_dir).where(F.col("cents") > 0)
