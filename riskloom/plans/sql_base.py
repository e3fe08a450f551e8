"""Shared SQL text: the events-to-transactions mapping and the feature columns."""

from __future__ import annotations

from riskloom.schemas import CATEGORY_RISK
from riskloom.sources.adapter import ABROAD, BASE_US, CITIES, DAY_US, HOUR_US, PATTERNS


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _place(i: int) -> str:
    cities = "[" + ", ".join(f"{c[i]}::double" for c in CITIES) + "]"
    return (f"CASE WHEN k % 13 = 0 THEN NULL WHEN k % 25 = 0 THEN {ABROAD[i]}::double "
            f"ELSE {cities}[(user_id % 7 + 1)::int] + (k % 10)::double / 100.0::double END")


TXN_CTE = f"""
ev AS (
  SELECT event_id, user_id, event_type,
    CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
    {BASE_US} + (epoch_us(ts) - {BASE_US}) // {DAY_US} * {DAY_US} + (user_id % 24) * {HOUR_US}
      + ((epoch_us(ts) - {BASE_US}) % {DAY_US}) // 60 AS us,
    CAST(floor((value - 2.0::double) * 100.0::double + 0.5::double) AS BIGINT) AS cents
  FROM events),
txn_all AS (
  SELECT 'txn_' || event_id AS transaction_id, 'cust_' || user_id AS customer_id,
    'merch_' || ((event_id * 7 + k) % 50) AS merchant_id,
    cents::double / 100.0::double AS amount, 'INR' AS currency,
    CASE WHEN event_type IN ('click', 'view') THEN 'upi' WHEN event_type = 'purchase' THEN 'card'
         WHEN event_type = 'signup' THEN 'imps' WHEN event_type = 'error' THEN 'neft' END AS channel,
    CASE WHEN user_id % 4 = 0 THEN 'dev_' || ((user_id + (k % 3) * 11) % 97)
      ELSE 'own_' || user_id || '_' || (k % 3) END AS device_fingerprint,
    CASE WHEN k % 17 <> 0 THEN CASE WHEN user_id % 4 = 1 THEN '192.168.' || (user_id % 5) || '.' || (k % 50)
      ELSE '10.' || user_id || '.' || (k % 5) END END AS ip_address,
    {_place(0)} AS location_lat, {_place(1)} AS location_lng,
    {_list(CATEGORY_RISK)}[(k % 10 + 1)::int] AS merchant_category,
    k % 25 = 0 AS is_international, make_timestamp(us) AS timestamp,
    CASE WHEN k < 3 THEN 1 ELSE 0 END AS is_fraud,
    CASE WHEN k < 3 THEN {_list(PATTERNS)}[(k + 1)::int] END AS fraud_pattern,
    us, cents,
    least(10000, 6 * ((event_id * 7919 + k * 31) % 1000) + CASE WHEN k < 3 THEN 4000 ELSE 0 END)::double
      / 10000.0::double AS risk_score,
    least(10000, 7 * ((event_id * 6007 + k * 17) % 1000) + CASE WHEN k < 3 THEN 3000 ELSE 0 END)::double
      / 10000.0::double AS candidate_score,
    ((event_id * 13 + k * 7) % 1200)::double / 100.0::double AS latency_ms,
    event_id, k
  FROM ev),
txn AS (SELECT * FROM txn_all WHERE cents > 0)"""


def with_txn(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([TXN_CTE, *ctes]) + "\n" + body


def rdp(x: str, places: int) -> str:
    return f"(format('{{:.{places}f}}', ({x})::double)::double + 0.0::double)"


def frame(key: str, seconds: int) -> str:
    return (f"OVER (PARTITION BY {key} ORDER BY us RANGE BETWEEN {seconds * 1_000_000} "
            "PRECEDING AND CURRENT ROW)")


def tcount(key: str, seconds: int) -> str:
    """Trailing count that leaves out later rows of the same microsecond."""
    return (f"(count(*) {frame(key, seconds)} - (count(*) OVER (PARTITION BY {key}, us) "
            f"- row_number() OVER (PARTITION BY {key}, us ORDER BY transaction_id)))::BIGINT")


RISK_MAP = "(SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {a}::double, {r}::double)" for c, (a, r) in CATEGORY_RISK.items()
) + ") AS r(category, risk_avg, risk_rate))"


def haversine(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    s1 = f"sin(radians({lat2} - {lat1}) / 2)"
    s2 = f"sin(radians({lng2} - {lng1}) / 2)"
    a = (f"least(greatest({s1} * {s1} + cos(radians({lat1})) * cos(radians({lat2})) * {s2} * {s2}, "
         "0.0::double), 1.0::double)")
    km = f"12742.0::double * atan2(sqrt({a}), sqrt(1.0::double - {a}))"
    return f"coalesce({rdp(km, 3)}, 0.0::double)"


_LAST = ("last_value(CASE WHEN location_lat IS NOT NULL AND location_lng IS NOT NULL THEN {c} END "
         "IGNORE NULLS) OVER (PARTITION BY customer_id ORDER BY us, transaction_id "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")

FEATURE_CTE = f"""
base_features AS (
  SELECT t.*,
    {tcount('customer_id', 60)} AS txn_count_1min,
    {tcount('customer_id', 300)} AS txn_count_5min,
    {tcount('customer_id', 3600)} AS txn_count_1hr,
    {tcount('customer_id', 86400)} AS txn_count_24hr,
    sum(cents) {frame('customer_id', 3600)} AS sum_1hr,
    max(cents) {frame('customer_id', 86400)} AS max_24hr,
    count(DISTINCT device_fingerprint) {frame('customer_id', 3600)} AS unique_devices_1hr,
    {tcount('device_fingerprint', 3600)} AS device_txn_count,
    row_number() OVER (PARTITION BY customer_id, device_fingerprint ORDER BY us, transaction_id) = 1
      AS is_new_device,
    row_number() OVER (PARTITION BY customer_id, merchant_id ORDER BY us, transaction_id) = 1
      AS is_new_merchant,
    {_LAST.format(c='location_lat')} AS last_lat, {_LAST.format(c='location_lng')} AS last_lng,
    {_LAST.format(c='us')} AS last_us
  FROM txn t),
features AS (
  SELECT transaction_id, customer_id, txn_count_1min, txn_count_5min, txn_count_1hr, txn_count_24hr,
    {rdp('sum_1hr::double / 100.0::double / txn_count_1hr::double', 2)} AS avg_amount_1hr,
    max_24hr::double / 100.0::double AS max_amount_24hr,
    {rdp("(amount - mean_1hr) / greatest(10.0::double, greatest(10.0::double, mean_1hr * 0.5::double))", 3)}
      AS amount_zscore,
    unique_devices_1hr, device_txn_count, is_new_device,
    {rdp('risk_avg', 2)} AS merchant_avg_amount, {rdp('risk_rate', 4)} AS merchant_fraud_rate,
    is_new_merchant,
    {haversine('last_lat', 'last_lng', 'location_lat', 'location_lng')} AS distance_from_last_txn,
    is_international, hour(timestamp)::BIGINT AS hour_of_day, isodow(timestamp) >= 6 AS is_weekend,
    '1.0.0' AS feature_version
  FROM (SELECT *, sum_1hr::double / (txn_count_1hr::double * 100.0::double) AS mean_1hr
        FROM base_features) b JOIN {RISK_MAP} ON category = merchant_category)"""


def with_features(body: str, *ctes: str) -> str:
    return with_txn(body, FEATURE_CTE, *ctes)
