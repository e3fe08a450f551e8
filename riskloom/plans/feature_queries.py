"""Queries C and D: window features, lookups and the identity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions.numeric import mean_of_cents
from riskloom.operators import entities as E
from riskloom.operators import features as C
from riskloom.operators.trailing import (Trailing, trailing, trailing_count, trailing_max,
                                         trailing_nunique)
from riskloom.plans.sql_base import (RISK_MAP, frame, haversine, rdp, tcount, with_features,
                                     with_txn)
from riskloom.schemas import FEATURES
from riskloom.sources.adapter import transactions

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def _count_query(name, key, seconds):
    @query(name, with_txn(f"SELECT transaction_id, greatest(1, {tcount(key, seconds)}) AS {name} FROM txn"))
    def run(spark, sf):
        df = trailing_count(transactions(spark, sf), key, seconds, name)
        return df.withColumn(name, F.greatest(F.lit(1).cast("bigint"), name))
    return run


_count_query("txn_count_1min", "customer_id", 60)
_count_query("txn_count_5min", "customer_id", 300)
_count_query("txn_count_1hr", "customer_id", 3600)
_count_query("txn_count_24hr", "customer_id", 86400)
_count_query("device_txn_count", "device_fingerprint", 3600)


@query("avg_amount_1hr", with_features("SELECT transaction_id, avg_amount_1hr FROM features"))
def avg_amount_1hr(spark, sf):
    df = trailing(transactions(spark, sf), "customer_id",
                  [Trailing("s", "sum", "cents", 3600), Trailing("n", "count", None, 3600)])
    return df.select("transaction_id", mean_of_cents(F.col("s"), F.col("n")).alias("avg_amount_1hr"))


@query("max_amount_24hr", with_txn(
    f"SELECT transaction_id, (max(cents) {frame('customer_id', 86400)})::double / 100.0::double "
    "AS max_amount_24hr FROM txn"))
def max_amount_24hr(spark, sf):
    df = trailing_max(transactions(spark, sf), "customer_id", "cents", 86400, "m")
    return df.select("transaction_id",
                     (F.col("m").cast("double") / F.lit(100.0)).alias("max_amount_24hr"))


@query("unique_devices_1hr", with_txn(
    f"SELECT transaction_id, count(DISTINCT device_fingerprint) {frame('customer_id', 3600)} "
    "AS unique_devices_1hr FROM txn"))
def unique_devices_1hr(spark, sf):
    return trailing_nunique(transactions(spark, sf), "customer_id", "device_fingerprint", 3600,
                            "unique_devices_1hr")


_BASELINES = f"""
baselines AS (
  SELECT customer_id, count(*) AS n_txns,
    {rdp('sum(cents)::double / count(*)::double / 100.0::double', 4)} AS mean_amount,
    {rdp('sqrt((count(*)::hugeint * sum(cents::hugeint * cents) - sum(cents)::hugeint * sum(cents)::hugeint)::double) / count(*)::double / 100.0::double', 4)}
      AS std_amount
  FROM txn GROUP BY customer_id)"""


@query("amount_zscore", with_features(f"""
  SELECT b.transaction_id, {rdp('(b.amount - greatest(10.0::double, l.mean_amount)) / greatest(10.0::double, greatest(5.0::double, l.std_amount))', 3)}
    AS amount_zscore
  FROM base_features b JOIN baselines l USING (customer_id)""", _BASELINES))
def amount_zscore(spark, sf):
    t = transactions(spark, sf)
    return C.amount_zscore(t, E.register_baselines(E.customer_baselines(t)))


@query("amount_zscore_event_baseline", with_features(f"""
  SELECT b.transaction_id, {rdp("""(b.amount - CASE WHEN k % 3 = 0 THEN 120.0::double WHEN k % 2 = 0 THEN greatest(10.0::double, l.mean_amount) ELSE mean_1hr END)
    / greatest(10.0::double, CASE WHEN k % 3 = 0 THEN 40.0::double WHEN k % 2 = 0 THEN greatest(5.0::double, l.std_amount)
      ELSE greatest(10.0::double, mean_1hr * 0.5::double) END)""", 3)} AS amount_zscore, merchant_fraud_rate
  FROM (SELECT *, sum_1hr::double / (txn_count_1hr::double * 100.0::double) AS mean_1hr FROM base_features) b
  JOIN baselines l USING (customer_id) JOIN (SELECT transaction_id, merchant_fraud_rate FROM features) USING (transaction_id)""", _BASELINES)
    .replace("k % 2 = 0", "customer_id < 'cust_5'"))
def amount_zscore_event_baseline(spark, sf):
    """Rows with their own baseline, customers with a registered one, and cold starts, in one feature build."""
    t = transactions(spark, sf)
    own = F.col("k") % 3 == 0
    mixed = t.withColumns({"event_baseline_mean": F.when(own, 120.0),
                           "event_baseline_std": F.when(own, 40.0).when(F.col("k") % 3 == 1, F.lit(None).cast("double")).otherwise(9.0)})
    known = E.register_baselines(E.customer_baselines(t.where(F.col("customer_id") < "cust_5")))
    return C.build_feature_vector(mixed, known).select("transaction_id", "amount_zscore", "merchant_fraud_rate")


@query("amount_zscore_cold_start",
       with_features("SELECT transaction_id, amount_zscore FROM features"))
def amount_zscore_cold_start(spark, sf):
    return C.amount_zscore(transactions(spark, sf))


@query("is_new_device", with_features("SELECT transaction_id, is_new_device FROM features"))
def is_new_device(spark, sf):
    return C.is_first_seen(transactions(spark, sf), "device_fingerprint", "is_new_device")


@query("is_new_merchant", with_features("SELECT transaction_id, is_new_merchant FROM features"))
def is_new_merchant(spark, sf):
    return C.is_first_seen(transactions(spark, sf), "merchant_id", "is_new_merchant")


@query("is_new_lookback", with_txn("""
  SELECT transaction_id, coalesce(us - lag(us) OVER (PARTITION BY customer_id, device_fingerprint
    ORDER BY us, transaction_id) > 604800000000, true) AS is_new_device_lookback FROM txn"""))
def is_new_lookback(spark, sf):
    return C.is_new_within(transactions(spark, sf), "device_fingerprint", 7 * 86400, "is_new_device_lookback")


@query("last_known_location", with_features(
    "SELECT transaction_id, last_lat, last_lng, last_us FROM base_features"))
def last_known_location(spark, sf):
    return (C.last_known_location(transactions(spark, sf))
            .select("transaction_id", "last_lat", "last_lng", "last_us"))


@query("distance_from_last_txn",
       with_features("SELECT transaction_id, distance_from_last_txn FROM features"))
def distance_from_last_txn(spark, sf):
    return C.distance_from_last_txn(transactions(spark, sf))


@query("travel_speed_kmh", with_features(f"""
  SELECT transaction_id, distance_km, coalesce(speed, 0.0::double) AS speed_kmh,
    CASE WHEN elapsed = 0 THEN distance_km > 0 ELSE coalesce(speed > 800.0::double, false) END
      AS impossible_travel
  FROM (SELECT transaction_id, distance_km, elapsed, CASE WHEN elapsed > 0 THEN
          {rdp('distance_km * 3600000000.0::double / elapsed::double', 1)} END AS speed
        FROM (SELECT transaction_id, us - last_us AS elapsed,
                {haversine('last_lat', 'last_lng', 'location_lat', 'location_lng')} AS distance_km
              FROM base_features))"""))
def travel_speed_kmh(spark, sf):
    return C.with_travel_speed(transactions(spark, sf))


@query("hour_of_day", with_txn("SELECT transaction_id, hour(timestamp)::BIGINT AS hour_of_day FROM txn"))
def hour_of_day(spark, sf):
    return transactions(spark, sf).select(
        "transaction_id", C.hour_of_day(F.col("timestamp")).cast("bigint").alias("hour_of_day"))


@query("is_weekend", """
  SELECT event_id, isodow(ts) >= 6 AS is_weekend FROM events""")
def is_weekend(spark, sf):
    from riskloom.sources.adapter import read_table
    return read_table(spark, sf, "events").select(
        "event_id", C.is_weekend(F.col("ts")).alias("is_weekend"))


@query("is_international", with_txn("SELECT transaction_id, is_international FROM txn"))
def is_international(spark, sf):
    return transactions(spark, sf).select("transaction_id", "is_international")


@query("feature_vector", with_features(
    f"SELECT transaction_id, customer_id, {', '.join(FEATURES)}, feature_version FROM features"))
def feature_vector(spark, sf):
    return C.build_feature_vector(transactions(spark, sf))


# D: lookups and graph -----------------------------------------------------------------

_PROFILES = f"""
profiles AS (
  SELECT merchant_id, count(*) AS n_txns,
    {rdp('sum(cents)::double / count(*)::double / 100.0::double', 2)} AS profile_avg_amount,
    {rdp('sum(is_fraud)::double / count(*)::double', 4)} AS profile_fraud_rate
  FROM txn GROUP BY merchant_id)"""


@query("merchant_risk_lookup", with_txn(f"""
  SELECT transaction_id,
    {rdp('coalesce(p.profile_avg_amount, risk_avg, 1000.0::double)', 2)} AS merchant_avg_amount,
    {rdp('coalesce(p.profile_fraud_rate, risk_rate, 0.015::double)', 4)} AS merchant_fraud_rate
  FROM txn LEFT JOIN (SELECT * FROM profiles WHERE substr(merchant_id, 7)::BIGINT % 5 <> 0) p USING (merchant_id)
  LEFT JOIN {RISK_MAP} ON category = merchant_category""", _PROFILES))
def merchant_risk_lookup(spark, sf):
    t = transactions(spark, sf)
    # Every fifth merchant has no profile yet and falls back to its category.
    profiles = E.merchant_profiles(t).where(F.substring("merchant_id", 7, 20).cast("bigint") % 5 != 0)
    return E.merchant_risk(t, profiles).select(
        "transaction_id", "merchant_avg_amount", "merchant_fraud_rate")


@query("customer_baselines", with_txn("SELECT * FROM baselines", _BASELINES))
def customer_baselines(spark, sf):
    return E.customer_baselines(transactions(spark, sf))


@query("customer_baseline_lookup", with_txn("""
  SELECT transaction_id, greatest(10.0::double, mean_amount) AS baseline_mean,
    greatest(5.0::double, std_amount) AS baseline_std
  FROM txn LEFT JOIN baselines USING (customer_id)""", _BASELINES))
def customer_baseline_lookup(spark, sf):
    t = transactions(spark, sf)
    return (E.with_baseline(t.select("transaction_id", "customer_id"), E.customer_baselines(t))
            .select("transaction_id", "baseline_mean", "baseline_std"))


@query("merchant_profiles", with_txn("SELECT * FROM profiles", _PROFILES))
def merchant_profiles(spark, sf):
    return E.merchant_profiles(transactions(spark, sf))


@query("merchant_profiles_as_of", with_txn(f"""
  SELECT transaction_id,
    CASE WHEN n > 1 THEN {rdp('(s - cents)::double / (n - 1)::double / 100.0::double', 2)} END
      AS merchant_avg_before,
    CASE WHEN ln > 1 THEN {rdp('(lf - is_fraud)::double / (ln - 1)::double', 4)} END
      AS merchant_fraud_before
  FROM (SELECT *, {tcount('merchant_id', 86400)} AS n,
      sum(cents) {frame('merchant_id', 86400)}
      - (sum(cents) OVER (PARTITION BY merchant_id, us)
         - sum(cents) OVER (PARTITION BY merchant_id, us ORDER BY transaction_id
                            ROWS UNBOUNDED PRECEDING)) AS s,
      row_number() OVER life AS ln, sum(is_fraud) OVER (life ROWS UNBOUNDED PRECEDING) AS lf
    FROM txn WINDOW life AS (PARTITION BY merchant_id ORDER BY us, transaction_id))"""))
def merchant_profiles_as_of(spark, sf):
    return E.merchant_profiles_as_of(transactions(spark, sf))


_EDGES = """
edges AS (
  SELECT kind, value, customer_id, min(us) AS first_seen_us FROM (
    SELECT 'device' AS kind, device_fingerprint AS value, customer_id, us FROM txn
    UNION ALL SELECT 'ip', ip_address, customer_id, us FROM txn
      WHERE ip_address IS NOT NULL AND ip_address <> '') GROUP BY ALL)"""


@query("identity_edges", with_txn("SELECT * FROM edges", _EDGES))
def identity_edges(spark, sf):
    return E.identity_edges(transactions(spark, sf))


_LINKED = """
members AS (SELECT kind, value, list(customer_id) AS m FROM edges GROUP BY ALL),
linked AS (
  SELECT transaction_id, customer_id, list_sort(list_filter(list_distinct(
      list_concat(coalesce(d.m, []), coalesce(i.m, []))), lambda x: x <> customer_id)) AS ids
  FROM txn LEFT JOIN members d ON d.kind = 'device' AND d.value = device_fingerprint
  LEFT JOIN members i ON i.kind = 'ip' AND i.value = ip_address)"""


@query("linked_accounts", with_txn(
    "SELECT transaction_id, len(ids)::BIGINT AS linked_count FROM linked", _EDGES, _LINKED))
def linked_counts(spark, sf):
    return E.linked_counts(transactions(spark, sf))


@query("linked_accounts_list", with_txn("""
  SELECT transaction_id, array_to_string(ids, ',') AS linked_ids, len(ids)::BIGINT AS linked_count
  FROM linked JOIN txn USING (transaction_id) WHERE risk_score >= 0.6::double""", _EDGES, _LINKED))
def linked_accounts_list(spark, sf):
    t = transactions(spark, sf)
    flagged = t.where(F.col("risk_score") >= 0.6)
    return E.linked_accounts(t, flagged).select(
        "transaction_id", F.array_join("linked_customer_ids", ",").alias("linked_ids"), "linked_count")


@query("linked_accounts_as_of", with_txn("""
  SELECT t.transaction_id, count(DISTINCT o.customer_id)
    FILTER (o.customer_id <> t.customer_id AND (o.us, o.transaction_id) <= (t.us, t.transaction_id))
    AS linked_count
  FROM txn t LEFT JOIN (
    SELECT 'd' || device_fingerprint AS e, customer_id, us, transaction_id FROM txn
    UNION ALL SELECT 'i' || ip_address, customer_id, us, transaction_id FROM txn
      WHERE ip_address IS NOT NULL) o
  ON o.e = 'd' || t.device_fingerprint OR o.e = 'i' || t.ip_address
  GROUP BY t.transaction_id"""))
def linked_accounts_as_of(spark, sf):
    return E.linked_counts_as_of(transactions(spark, sf))
