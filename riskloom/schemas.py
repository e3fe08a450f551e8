"""Explicit schemas, the feature contract and the fixed reference tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


TXN_DDL = """transaction_id string not null, customer_id string not null, merchant_id string not null,
 amount double not null, currency string, channel string, device_fingerprint string not null,
 ip_address string, location_lat double, location_lng double, merchant_category string,
 is_international boolean, timestamp timestamp not null, is_fraud int, fraud_pattern string"""

# Allowed channels of a payment event.
CHANNELS = ["card", "upi", "neft", "imps"]

# Merchant category -> (average amount, fraud rate).
CATEGORY_RISK = {
    "grocery": (450.0, 0.005),
    "fuel": (1500.0, 0.010),
    "dining": (850.0, 0.012),
    "electronics": (12000.0, 0.045),
    "pharmacy": (600.0, 0.008),
    "travel": (18000.0, 0.035),
    "crypto_exchange": (25000.0, 0.120),
    "luxury_jewelry": (45000.0, 0.095),
    "gambling": (8000.0, 0.150),
    "online_services": (999.0, 0.020),
}
UNKNOWN_CATEGORY_RISK = (1000.0, 0.015)

# Fixed values: (name, entity, window seconds, aggregation, source field, default, type),
# in the contractual model input order.
FEATURE_CATALOG = [
    ("txn_count_1min", "customer_id", 60, "count", None, "1", "int"),
    ("txn_count_5min", "customer_id", 300, "count", None, "1", "int"),
    ("txn_count_1hr", "customer_id", 3600, "count", None, "1", "int"),
    ("txn_count_24hr", "customer_id", 86400, "count", None, "1", "int"),
    ("avg_amount_1hr", "customer_id", 3600, "mean", "amount", "0.0", "float"),
    ("max_amount_24hr", "customer_id", 86400, "max", "amount", "0.0", "float"),
    ("amount_zscore", "customer_id", None, "zscore", "amount", "0.0", "float"),
    ("unique_devices_1hr", "customer_id", 3600, "nunique", "device_fingerprint", "1", "int"),
    ("device_txn_count", "device_fingerprint", 3600, "count", None, "1", "int"),
    ("is_new_device", "customer_id", 604800, "is_new", "device_fingerprint", "False", "bool"),
    ("merchant_avg_amount", "merchant_id", 86400, "mean", "amount", "500.0", "float"),
    ("merchant_fraud_rate", "merchant_id", None, "ratio", None, "0.01", "float"),
    ("is_new_merchant", "customer_id", 604800, "is_new", "merchant_id", "False", "bool"),
    ("distance_from_last_txn", "customer_id", None, "haversine", None, "0.0", "float"),
    ("is_international", None, None, "passthrough", "is_international", "False", "bool"),
    ("hour_of_day", None, None, "extract_hour", "timestamp", "12", "int"),
    ("is_weekend", None, None, "extract_weekend", "timestamp", "False", "bool"),
]
FEATURES = [row[0] for row in FEATURE_CATALOG]
FEATURE_TYPES = {row[0]: {"int": "bigint", "float": "double", "bool": "boolean"}[row[6]]
                 for row in FEATURE_CATALOG}
FEATURE_VERSION = "1.0.0"

CATALOG_DDL = ("feature string, entity string, window_seconds int, aggregation string, "
               "source_field string, default_value string, dtype string")

# Model risk labels, case states, verdicts, registry states.
RISK_LABELS = ["low", "medium", "high", "critical"]
CASE_STATUSES = ["pending", "investigating", "resolved"]
DECISIONS = ["approved", "rejected", "escalated"]
MODEL_STATUSES = ["candidate", "canary", "production", "retired"]

SCORES_DDL = """transaction_id string, model_version string, risk_score double, risk_label string,
 threshold_used double, was_flagged boolean, scoring_latency_ms double, feature_fetch_latency_ms double"""
LABELED_DDL = """transaction_id string, features string, risk_score double, analyst_label string,
 label_source string, created_at timestamp"""
SNAPSHOT_DDL = "transaction_id string, features string, feature_version string"
ONLINE_DDL = "transaction_id string, fields map<string,string>, expires_at timestamp"

SNAPSHOT_FEATURES = T.StructType([T.StructField(name, T.DoubleType()) for name in FEATURES])


def feature_catalog(spark: SparkSession) -> DataFrame:
    """The feature catalog as a table (17 rows)."""
    return spark.createDataFrame(FEATURE_CATALOG, CATALOG_DDL)
