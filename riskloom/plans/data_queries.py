"""Queries A, B, I, L: tables, validation, datasets, training and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import scoring as E
from riskloom.operators import training as TR
from riskloom.operators import validate as V
from riskloom.plans.governance_queries import LABEL, features
from riskloom.plans.sql_base import rdp, tcount, with_features, with_txn
from riskloom.plans.stored import stored
from riskloom.schemas import FEATURE_CATALOG, FEATURE_TYPES, FEATURES, TXN_DDL, feature_catalog
from riskloom.session import work_dir
from riskloom.sources import tables as A
from riskloom.sources.adapter import MIDDLE_US, raw_transactions, read_table, transactions
from riskloom.streaming import jobs as L

QUERIES = {}
SQL = {}
TXN_COLS = [f.strip().split()[0] for f in TXN_DDL.replace("\n", " ").split(",")]


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def history(spark, sf):
    """The transaction history written as Parquet by day and read back with its schema."""
    key = "history"
    from riskloom.plans import stored as S
    memo = (spark.sparkContext.applicationId, sf, key)
    if memo not in S._WRITTEN:
        path = work_dir(spark, key)
        A.write_transactions(transactions(spark, sf).select(*TXN_COLS), path)
        S._WRITTEN[memo] = A.read_transactions(spark, path + "-missing", alt=path)
    return S._WRITTEN[memo]


_READ = """SELECT transaction_id, customer_id, merchant_id, amount, channel, device_fingerprint, ip_address,
  merchant_category, is_international, epoch_us(timestamp) AS us, is_fraud, fraud_pattern FROM txn"""


def _plain(df):
    return df.select("transaction_id", "customer_id", "merchant_id", "amount", "channel", "device_fingerprint",
                     "ip_address", "merchant_category", "is_international", F.unix_micros("timestamp").alias("us"),
                     "is_fraud", "fraud_pattern")


@query("read_transactions", with_txn(_READ))
def read_transactions(spark, sf):
    return _plain(history(spark, sf))


@query("write_transactions", with_txn("SELECT CAST(timestamp AS DATE) AS day, count(*) AS n, sum(cents)::BIGINT AS cents FROM txn GROUP BY 1"))
def write_transactions(spark, sf):
    from riskloom.functions.numeric import cents
    return history(spark, sf).groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(cents(F.col("amount"))).alias("cents"))


@query("append_new_transactions", with_txn("SELECT transaction_id, 1::BIGINT AS n, cents > 0 AS was_stored FROM txn_all"))
def append_new_transactions(spark, sf):
    """Stores the valid rows, then appends all rows twice over: each is there once."""
    path, batch = work_dir(spark, "appended"), raw_transactions(spark, sf)
    A.append_new(batch.where("cents > 0"), path)
    A.append_new(batch.unionByName(batch), path)
    return spark.read.parquet(path).groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("cents") > 0).alias("was_stored"))


@query("write_feature_snapshots", with_features("SELECT transaction_id, '1.0.0' AS feature_version, txn_count_24hr::double AS txn_count_24hr, "
                                                "amount_zscore, is_new_device::INT::double AS is_new_device FROM features"))
def write_feature_snapshots(spark, sf):
    path = work_dir(spark, "snapshots")
    A.write_feature_snapshots(features(spark, sf), path)
    snaps = spark.read.parquet(path)
    get = lambda f: F.get_json_object("features", f"$.{f}").cast("double").alias(f)
    return snaps.select("transaction_id", "feature_version", *[get(f) for f in ("txn_count_24hr", "amount_zscore", "is_new_device")])


_FEEDBACK = "labels_t AS (SELECT transaction_id, us, CASE WHEN is_fraud = 1 THEN 'fraud' ELSE 'legitimate' END AS analyst_label FROM txn WHERE channel = 'neft')"


def labeled(spark, sf):
    """Verdicts on all error events, with their feature snapshots."""
    verdict = F.when(F.col("is_fraud") == 1, "fraud").otherwise("legitimate")
    t = transactions(spark, sf).where(F.col("channel") == "neft").select(
        "transaction_id", "risk_score", verdict.alias("analyst_label"), F.lit("analyst").alias("label_source"), F.col("timestamp").alias("created_at"))
    kept = ("risk_score", "analyst_label", "label_source", "created_at")
    # Joined as typed columns: only the rows with a verdict become text.
    snaps = A.feature_snapshots(t.join(features(spark, sf).select("transaction_id", *FEATURES), "transaction_id"), kept)
    return snaps.select("transaction_id", "features", *kept)


@query("read_feedback", with_features("""SELECT transaction_id, amount_zscore, unique_devices_1hr::double AS unique_devices_1hr,
  (analyst_label = 'fraud')::INT AS is_fraud FROM labels_t JOIN features USING (transaction_id)""", _FEEDBACK))
def read_feedback(spark, sf):
    path = work_dir(spark, "labels")
    labeled(spark, sf).write.parquet(path)
    return A.read_feedback(spark, path).select("transaction_id", "amount_zscore", "unique_devices_1hr", "is_fraud")


@query("publish_online_features", with_features("""SELECT transaction_id, txn_count_1hr::varchar AS txn_count_1hr, avg_amount_1hr::varchar AS avg_amount_1hr,
  CASE WHEN is_new_device THEN 'True' ELSE 'False' END AS is_new_device, us + 86400000000 AS expires_us FROM features JOIN (SELECT transaction_id, us FROM txn) USING (transaction_id)"""))
def publish_online_features(spark, sf):
    rows = E.publish_online(features(spark, sf), F.col("timestamp"))
    return rows.select("transaction_id", *[F.col("fields")[f].alias(f) for f in ("txn_count_1hr", "avg_amount_1hr", "is_new_device")],
                       F.unix_micros("expires_at").alias("expires_us"))


_LIVE_US = MIDDLE_US


@query("lookup_online_features", with_features(f"""SELECT t.transaction_id, t.us + 86400000000 > {_LIVE_US} AS found,
  CASE WHEN t.us + 86400000000 > {_LIVE_US} THEN f.amount_zscore END AS amount_zscore, CASE WHEN t.us + 86400000000 > {_LIVE_US} THEN f.is_weekend END AS is_weekend
  FROM txn t JOIN features f USING (transaction_id)"""))
def lookup_online_features(spark, sf):
    store = E.publish_online(features(spark, sf), F.col("timestamp"))
    found = E.lookup_online(transactions(spark, sf), store, F.timestamp_micros(F.lit(_LIVE_US)))
    return found.select("transaction_id", "found", "amount_zscore", "is_weekend")


@query("fetch_or_fallback", with_features("""SELECT t.transaction_id, t.cents <= 0 AS is_fallback, coalesce(f.txn_count_1hr, 1) AS txn_count_1hr,
  coalesce(f.avg_amount_1hr, t.amount) AS avg_amount_1hr, coalesce(f.merchant_fraud_rate, 0.015::double) AS merchant_fraud_rate,
  coalesce(f.hour_of_day, hour(t.timestamp)) AS hour_of_day FROM txn_all t LEFT JOIN features f USING (transaction_id)"""))
def fetch_or_fallback(spark, sf):
    return E.fetch_or_fallback(raw_transactions(spark, sf), features(spark, sf)).select(
        "transaction_id", "is_fallback", "txn_count_1hr", "avg_amount_1hr", "merchant_fraud_rate", "hour_of_day")


@query("write_flagged_stream", with_txn(f"""SELECT transaction_id AS key, risk_score, {LABEL} AS risk_label,
  CASE WHEN risk_score >= 0.85::double THEN 'URGENT' ELSE 'NORMAL' END AS priority FROM txn WHERE risk_score >= 0.6::double"""))
def write_flagged_stream(spark, sf):
    alerts = L.stream_score(transactions(spark, sf))
    get = lambda f: F.get_json_object("value", f"$.{f}")
    return alerts.select("key", get("risk_score").cast("double").alias("risk_score"), get("risk_label").alias("risk_label"),
                         get("priority").alias("priority"))


@query("append_fraud_scores", with_txn(f"""SELECT transaction_id, 'baseline_v1' AS model_version, risk_score, {LABEL} AS risk_label,
  CASE WHEN risk_score < 0.3::double THEN 0.3::double WHEN risk_score < 0.85::double THEN 0.6::double ELSE 0.85::double END AS threshold_used,
  risk_score >= 0.6::double AS was_flagged, latency_ms AS scoring_latency_ms, 0.0::double AS feature_fetch_latency_ms FROM txn"""))
def append_fraud_scores(spark, sf):
    """Three batches are appended, the second one twice; the audit table is read back."""
    t = transactions(spark, sf).withColumns({"model_version": F.lit("baseline_v1"), "scoring_latency_ms": F.col("latency_ms")})
    path, batch = work_dir(spark, "scores"), F.pmod(F.xxhash64("transaction_id"), F.lit(3))
    for number in (0, 1, 2, 1):
        E.append_scores(E.risk_tier(t.where(batch == number)), path, number)
    return E.read_scores(spark, path).drop("batch")


# B -----------------------------------------------------------------------------------

def messy(spark, sf):
    """All events, with odd currencies on some and no channel on others."""
    t = raw_transactions(spark, sf)
    return t.withColumns({
        "currency": F.when(F.col("k") % 7 == 0, "inr ").when(F.col("k") % 11 == 0, "rupee"),
        "channel": F.when(F.col("k") % 5 != 0, F.col("channel")),
        "location_lat": F.when(F.col("k") % 19 == 0, F.lit(120.0)).otherwise(F.col("location_lat"))})


_MESSY = """messy AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'inr ' WHEN k % 11 = 0 THEN 'rupee' END AS cur,
  CASE WHEN k % 5 <> 0 THEN channel END AS chan, CASE WHEN k % 19 = 0 THEN 120.0::double ELSE location_lat END AS lat FROM txn_all),
judged AS (SELECT *, (cents <= 0)::INT + coalesce((length(trim(cur)) > 3)::INT, 0) + coalesce((lat > 90)::INT, 0) AS n_bad FROM messy)"""


@query("validate_transactions", with_txn("SELECT transaction_id FROM judged WHERE n_bad = 0", _MESSY))
def validate_transactions(spark, sf):
    return V.validate(messy(spark, sf))[0].select("transaction_id")


@query("rejected_transactions", with_txn("SELECT transaction_id, n_bad::BIGINT AS n_violations FROM judged WHERE n_bad > 0", _MESSY))
def rejected_transactions(spark, sf):
    return V.validate(messy(spark, sf))[1].select("transaction_id", F.size("violations").cast("bigint").alias("n_violations"))


@query("normalize_currency", with_txn("SELECT transaction_id, upper(trim(cur)) AS currency FROM messy", _MESSY))
def normalize_currency(spark, sf):
    return V.normalize_currency(messy(spark, sf)).select("transaction_id", "currency")


@query("apply_event_defaults", with_txn("SELECT transaction_id, coalesce(cur, 'INR') AS currency, coalesce(chan, 'upi') AS channel FROM messy", _MESSY))
def apply_event_defaults(spark, sf):
    return V.with_defaults(messy(spark, sf)).select("transaction_id", "currency", "channel")


@query("validate_features", with_features("SELECT transaction_id FROM features"))
def validate_features(spark, sf):
    return V.validate_features(features(spark, sf))[0].select("transaction_id")


def broken_features(spark, sf):
    """The feature table with values that no build would give on some rows."""
    key = F.substring("transaction_id", 5, 20).cast("bigint")
    return features(spark, sf).withColumns({
        "hour_of_day": F.when(key % 5 == 0, F.lit(24).cast("bigint")).otherwise(F.col("hour_of_day")),
        "txn_count_1hr": F.when(key % 7 == 0, -F.col("txn_count_1hr")).otherwise(F.col("txn_count_1hr")),
        "amount_zscore": F.when(key % 11 == 0, F.lit(float("nan"))).otherwise(F.col("amount_zscore")),
        "merchant_fraud_rate": F.when(key % 13 == 0, F.col("merchant_fraud_rate") + 1).otherwise(F.col("merchant_fraud_rate"))})


@query("rejected_features", with_features("""SELECT transaction_id, reasons FROM (SELECT transaction_id, list_filter([
  CASE WHEN i % 5 = 0 THEN 'hour_of_day out of range' END, CASE WHEN i % 7 = 0 THEN 'txn_count_1hr is negative' END,
  CASE WHEN i % 11 = 0 THEN 'amount_zscore is not finite' END, CASE WHEN i % 13 = 0 AND merchant_fraud_rate > 0 THEN 'merchant_fraud_rate out of range' END],
  lambda x: x IS NOT NULL).list_sort().array_to_string('; ') AS reasons FROM (SELECT *, substr(transaction_id, 5)::BIGINT AS i FROM features)) WHERE reasons <> ''"""))
def rejected_features(spark, sf):
    return V.validate_features(broken_features(spark, sf))[1].select(
        "transaction_id", F.array_join(F.array_sort("violations"), "; ").alias("reasons"))


@query("build_features_from_history", with_features(
    "SELECT f.transaction_id, is_fraud, " + ", ".join(f"f.{x}" for x in FEATURES) + " FROM features f JOIN (SELECT transaction_id, is_fraud FROM txn) USING (transaction_id)"))
def build_features_from_history(spark, sf):
    """A table without the feature columns: they are built first."""
    return TR.build_features(transactions(spark, sf)).select("transaction_id", "is_fraud", *FEATURES)


@query("feature_catalog", with_features("WITH_CATALOG"))
def catalog(spark, sf):
    """The catalog with the number of rows at each feature's default value."""
    f = features(spark, sf)
    cells = F.array(*[F.struct(F.lit(n).alias("feature"), (F.col(n) == F.lit(d).cast(FEATURE_TYPES[n])).cast("bigint").alias("hit"))
                      for n, *_, d, _ in FEATURE_CATALOG])
    used = f.select(F.inline(cells)).groupBy("feature").agg(F.sum("hit").alias("n_at_default"))
    return feature_catalog(spark).join(used, "feature").select(
        "feature", "entity", "window_seconds", "aggregation", "default_value", "dtype", "n_at_default")


_lit = lambda v: "NULL" if v is None else (str(v) if isinstance(v, int) else f"'{v}'")
SQL["feature_catalog"] = with_features(" UNION ALL ".join(
    f"SELECT '{n}' AS feature, {_lit(e)} AS entity, {_lit(w)}::INT AS window_seconds, '{a}' AS aggregation, '{d}' AS default_value, "
    f"'{t}' AS dtype, count(*) FILTER ({n} = '{d.lower()}'::{FEATURE_TYPES[n]}) AS n_at_default FROM features"
    for n, e, w, a, s, d, t in FEATURE_CATALOG))


def _as_double(f):
    return f"{f}::INT::double AS {f}" if FEATURE_TYPES[f] == "boolean" else f"{f}::double AS {f}"


@query("model_input", with_features(f"SELECT transaction_id, {', '.join(map(_as_double, FEATURES))} FROM features"))
def model_input(spark, sf):
    return E.model_input(features(spark, sf), ["transaction_id"])


@query("prepare_xy", with_features(f"SELECT transaction_id, {', '.join(map(_as_double, FEATURES))}, is_fraud AS y FROM features JOIN (SELECT transaction_id, is_fraud FROM txn) USING (transaction_id)"))
def prepare_xy(spark, sf):
    return E.prepare_xy(features(spark, sf), keep=["transaction_id"])


@query("build_features", with_features("SELECT transaction_id, amount_zscore, txn_count_24hr FROM features"))
def build_features(spark, sf):
    return TR.build_features(features(spark, sf)).select("transaction_id", "amount_zscore", "txn_count_24hr")


# I -----------------------------------------------------------------------------------

def _ranked(label, seed=42, id_col="transaction_id", table="txn"):
    by = f"PARTITION BY {label} " if label else ""
    return (f"SELECT *, row_number() OVER ({by}ORDER BY md5('{seed}:' || {id_col}), {id_col}) AS rnk FROM {table}")


_STRAT = f"""sizes AS (SELECT is_fraud, n, sum(n) OVER (ORDER BY is_fraud) AS e FROM (SELECT is_fraud, count(*) AS n FROM txn GROUP BY 1)),
cuts AS (SELECT is_fraud, floor(e::double * 0.7::double + 0.5) - floor((e - n)::double * 0.7::double + 0.5) AS c1,
  floor(e::double * {0.70 + 0.15!r}::double + 0.5) - floor((e - n)::double * {0.70 + 0.15!r}::double + 0.5) AS c2 FROM sizes)"""


@query("stratified_split", with_txn(f"""SELECT transaction_id, is_fraud, CASE WHEN rnk <= c1 THEN 'train' WHEN rnk <= c2 THEN 'val' ELSE 'test' END AS split
  FROM ({_ranked('is_fraud')}) JOIN cuts USING (is_fraud)""", _STRAT))
def stratified_split(spark, sf):
    return TR.stratified_split(transactions(spark, sf).select("transaction_id", "is_fraud"))


@query("random_split", f"""SELECT doc_id, CASE WHEN rnk <= n - held THEN 'train' WHEN rnk <= n - ceil(held / 2.0::double) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, ceil(round(n::double * 0.2::double, 6)) AS held FROM (SELECT *, count(*) OVER () AS n FROM ({_ranked(None, id_col='doc_id', table='documents')})))""")
def random_split(spark, sf):
    return TR.random_split(read_table(spark, sf, "documents").select("doc_id"), id_col="doc_id")


@query("stratified_kfold", with_txn(f"SELECT transaction_id, is_fraud, ((rnk - 1) % 3)::INT AS fold FROM ({_ranked('is_fraud')})"))
def stratified_kfold(spark, sf):
    return TR.stratified_kfold(transactions(spark, sf).select("transaction_id", "is_fraud"))


@query("merge_feedback", with_features("""SELECT transaction_id, f.amount_zscore, coalesce((l.analyst_label = 'fraud')::INT, 0) AS is_fraud
  FROM features f LEFT JOIN labels_t l USING (transaction_id)""", _FEEDBACK))
def merge_feedback(spark, sf):
    hist = E.prepare_xy(features(spark, sf), keep=["transaction_id"]).withColumn("is_fraud", F.lit(0)).drop("y")
    return TR.merge_feedback(hist, A.expand_feedback(labeled(spark, sf))).select("transaction_id", "amount_zscore", "is_fraud")


@query("write_instruction_jsonl", """SELECT split, count(*) AS n FROM (SELECT CASE WHEN rnk <= n - ceil(round(n::double * 0.2::double, 6)) THEN 'train'
  WHEN rnk <= n - ceil(ceil(round(n::double * 0.2::double, 6)) / 2.0::double) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT row_number() OVER () AS rnk, count(*) OVER () AS n FROM documents)) GROUP BY 1""")
def write_instruction_jsonl(spark, sf):
    docs = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("output"))
    path = work_dir(spark, "instructions")
    A.write_instructions(TR.random_split(docs), path)
    return spark.read.schema("id bigint, output string, split string").json(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


_MODELS = {}


def training_splits(spark, sf):
    return stored(spark, sf, "splits", lambda: TR.stratified_split(
        E.prepare_xy(features(spark, sf), keep=("transaction_id",)), label="y"), features(spark, sf).count)


def trained(spark, sf):
    """The boosted model with the operator's own rounds and depth, fitted once per application and input."""
    splits = training_splits(spark, sf)
    part = lambda name: splits.where(F.col("split") == name)
    key = (spark.sparkContext.applicationId, sf)
    if key not in _MODELS:
        _MODELS[key] = TR.train_model(part("train"), part("val"))
    return _MODELS[key], splits


@query("train_model")
def train_model(spark, sf):
    model, splits = trained(spark, sf)
    return TR.predict(model, splits, "transaction_id")


@query("score_transactions")
def score_transactions(spark, sf):
    model, _ = trained(spark, sf)
    return E.risk_tier(E.score(features(spark, sf), model, "gbt_v1"))


@query("training_metadata")
def training_metadata(spark, sf):
    return TR.training_metadata(*trained(spark, sf), "gbt_v1")


@query("tune_model")
def tune_model(spark, sf):
    splits = training_splits(spark, sf)
    history = TR.tune_model(splits.where(F.col("split") == "train").drop("split"))
    return spark.createDataFrame(history, "candidate_idx int, stepSize double, maxDepth int, subsamplingRate double, "
                                 "featureSubsetStrategy string, minInstancesPerNode int, mean_pr_auc double, mean_roc_auc double")


# L -----------------------------------------------------------------------------------

def _run_halves(spark, sf, name, transform):
    """The stored history through ``transform`` as a stream into a table: its early half lands and is run, then the rest.

    A half lands in as many files as its scan has tasks, whatever its size; rows without a time belong to the first.
    """
    from riskloom.sources.streams import read_txn_stream
    landing, out = work_dir(spark, "stream-in"), work_dir(spark, name)
    early = F.coalesce(F.col("timestamp") < F.timestamp_micros(F.lit(MIDDLE_US)), F.lit(True))
    for part in (early, ~early):
        history(spark, sf).where(part).write.mode("append").parquet(landing)
        made = transform(read_txn_stream(spark, "parquet", path=landing))
        (made.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-ckpt")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(made.schema).parquet(out)


@query("stream_features", with_features("SELECT transaction_id, txn_count_1hr, unique_devices_1hr, is_new_device, amount_zscore, distance_from_last_txn FROM features"))
def stream_features(spark, sf):
    from riskloom.sources.streams import read_txn_stream
    root, landing = work_dir(spark, "stream-out"), work_dir(spark, "stream-in")
    early = F.col("timestamp") < F.timestamp_micros(F.lit(MIDDLE_US))
    for part in (early, ~early):  # land half the rows, run, land the rest, resume
        history(spark, sf).where(part).write.mode("append").parquet(landing)
        L.stream_features(read_txn_stream(spark, "parquet", path=landing), root, root + "-ckpt")
    return spark.read.parquet(root + "/features").select(
        "transaction_id", "txn_count_1hr", "unique_devices_1hr", "is_new_device", "amount_zscore", "distance_from_last_txn")


@query("micro_batch_features", with_features("""SELECT transaction_id, txn_count_24hr, is_new_merchant FROM features JOIN (SELECT transaction_id, us FROM txn) USING (transaction_id)
  WHERE us >= """ + str(MIDDLE_US)))
def micro_batch_features(spark, sf):
    t = transactions(spark, sf)
    late = F.col("us") >= MIDDLE_US
    return L.micro_batch_features(t.where(late), t.where(~late)).select("transaction_id", "txn_count_24hr", "is_new_merchant")


def halves(spark, df):
    """Lands the rows before the middle of the month, then the rest; yields the landing folder after each."""
    landing = work_dir(spark, "stream-in")
    early = F.col("us") < MIDDLE_US
    for part in (early, ~early):
        df.where(part).write.mode("append").parquet(landing)
        yield landing


@query("stream_device_count", with_txn(f"SELECT transaction_id, {tcount('device_fingerprint', 3600)} AS device_txn_count FROM txn"))
def stream_device_count(spark, sf):
    t, root = transactions(spark, sf), work_dir(spark, "device-out")
    for landing in halves(spark, t):
        L.stream_device_counts(spark.readStream.schema(t.schema).parquet(landing), root, root + "-ckpt")
    return spark.read.parquet(root + "/counts").select("transaction_id", "device_txn_count")


@query("state_ttl", with_txn("SELECT transaction_id FROM txn WHERE us >= (SELECT max(us) FROM txn) - 7200000000"))
def state_ttl(spark, sf):
    t = transactions(spark, sf)
    return L.live_history(t, t.agg(F.max("us")).scalar(), L.DEVICE_TTL_SECONDS).select("transaction_id")


@query("sliding_rate_limit", with_txn(f"SELECT transaction_id, requests, requests > 2 AS limited FROM (SELECT *, {tcount('customer_id', 60)} AS requests FROM txn)"))
def sliding_rate_limit(spark, sf):
    return L.rate_limit_audit(transactions(spark, sf), limit=2).select("transaction_id", "requests", "limited")


@query("stream_dedupe", with_txn("SELECT transaction_id, customer_id FROM txn"))
def stream_dedupe(spark, sf):
    return _run_halves(spark, sf, "dedupe", lambda s: L.stream_dedupe(s.unionByName(s))).select("transaction_id", "customer_id")


@query("stream_score_and_flag", with_txn("SELECT transaction_id AS key FROM txn WHERE amount > 200 AND is_fraud = 1"))
def stream_score_and_flag(spark, sf):
    # A rule score keeps the check exact; a fitted model's transform is used the same way.
    risk = F.when((F.col("amount") > 200) & (F.col("is_fraud") == 1), 0.9).otherwise(0.1)
    return _run_halves(spark, sf, "alerts", lambda s: L.stream_score(s.withColumn("risk_score", risk))).select("key")


@query("stream_dual_write", with_features("SELECT transaction_id, 1::BIGINT AS online, 1::BIGINT AS offline, txn_count_1hr FROM features"))
def stream_dual_write(spark, sf):
    root, made = work_dir(spark, "dual"), features(spark, sf)
    landing = work_dir(spark, "dual-in")
    made.write.parquet(landing)
    for attempt in range(2):  # a stream that starts over repeats its batch, which replaces its own output
        L.stream_dual_write(spark.readStream.schema(made.schema).parquet(landing), root, f"{root}-ckpt{attempt}")
    on, off = (spark.read.parquet(f"{root}/{x}") for x in ("online", "offline"))
    count = lambda df, name, *more: df.groupBy("transaction_id").agg(F.count(F.lit(1)).alias(name), *more)
    value = F.max(F.col("fields")["txn_count_1hr"].cast("bigint")).alias("txn_count_1hr")
    return count(on, "online", value).join(count(off, "offline"), "transaction_id").select("transaction_id", "online", "offline", "txn_count_1hr")


def _canary_sql():
    from riskloom.plans.governance_queries import SQL as governance

    return governance["rollback_decision"].replace("risk_score >= 0.6::double AS was_flagged FROM txn)",
                                                   f"risk_score >= 0.6::double AS was_flagged FROM txn WHERE us < {MIDDLE_US})")


@query("stream_canary_monitor", f"""SELECT 0::BIGINT AS batch, canary_version, champion_version, samples, reason, p99_latency_ms, error_rate,
  0.0::double AS percentage_after FROM ({_canary_sql()}) WHERE rolled_back""")
def stream_canary_monitor(spark, sf):
    """Two batches: the first one trips and resets the split, the second one finds no canary."""
    from riskloom.operators import lifecycle as K
    from riskloom.plans.governance_queries import observations
    root, seen = work_dir(spark, "canary"), observations(spark, sf)
    first = spark.range(1).select(F.lit(0).cast("bigint").alias("us"), F.lit(0).cast("bigint").alias("event_id"),
                                  F.lit("candidate_v2").alias("canary_version"), F.lit(30.0).alias("canary_percentage"), F.lit(False).alias("shadow_mode"))
    first.write.parquet(f"{root}/config/batch=-1")
    for landing in halves(spark, seen):
        L.stream_canary_monitor(spark.readStream.schema(seen.schema).parquet(landing), root, root + "-ckpt")
    after = K.current_split(spark.read.parquet(f"{root}/config"))
    return spark.read.parquet(f"{root}/audit").select(
        F.col("batch").cast("bigint").alias("batch"), "canary_version", "champion_version", "samples", "reason", "p99_latency_ms", "error_rate",
        after.select("canary_percentage").scalar().alias("percentage_after"))
