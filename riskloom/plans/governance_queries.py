"""Queries E, H, J, K: scores, evaluation, drift and model lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import drift as J
from riskloom.operators import evaluation as H
from riskloom.operators import lifecycle as K
from riskloom.operators import scoring as E
from riskloom.operators.features import build_feature_vector
from riskloom.plans.stored import stored
from riskloom.plans.sql_base import rdp, with_features, with_txn
from riskloom.schemas import FEATURES, FEATURE_TYPES
from riskloom.session import work_dir
from riskloom.sources.adapter import BASE_US, read_table, transactions

QUERIES = {}
SQL = {}
MODEL = "baseline_v1"


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


def predictions(spark, sf, column="risk_score"):
    return transactions(spark, sf).select(
        "transaction_id", F.col("is_fraud").alias("y"), F.col(column).alias("p"))


PRED = "pred AS (SELECT transaction_id, is_fraud AS y, risk_score AS p, candidate_score AS p2 FROM txn)"

# E -----------------------------------------------------------------------------------

LABEL = ("CASE WHEN risk_score < 0.3::double THEN 'low' WHEN risk_score < 0.6::double THEN 'medium' "
         "WHEN risk_score < 0.85::double THEN 'high' ELSE 'critical' END")


@query("risk_tier", with_txn(f"""
  SELECT transaction_id, risk_score, {LABEL} AS risk_label, risk_score >= 0.6::double AS was_flagged,
    CASE WHEN risk_score < 0.3::double THEN 0.3::double WHEN risk_score < 0.85::double THEN 0.6::double
      ELSE 0.85::double END AS threshold_used FROM txn"""))
def risk_tier(spark, sf):
    return E.risk_tier(transactions(spark, sf).select("transaction_id", "risk_score"))


@query("alert_priority", with_txn("""
  SELECT transaction_id, CASE WHEN risk_score >= 0.85::double THEN 'URGENT' ELSE 'NORMAL' END
    AS priority FROM txn WHERE risk_score >= 0.6::double"""))
def alert_priority(spark, sf):
    scored = E.risk_tier(transactions(spark, sf).select("transaction_id", "risk_score"))
    return scored.where("was_flagged").select(
        "transaction_id", E.alert_priority(F.col("risk_label")).alias("priority"))


def scores(spark, sf):
    t = transactions(spark, sf).withColumn("model_version", F.concat(
        F.lit("v"), (F.col("k") % 3).cast("string")))
    return E.risk_tier(t)


@query("tier_counts", with_txn(f"""
  SELECT {LABEL} AS risk_label, 'v' || (k % 3) AS model_version, count(*) AS n FROM txn GROUP BY ALL"""))
def tier_counts(spark, sf):
    return E.tier_counts(scores(spark, sf))


def _hist_sql(bounds, scale):
    le = ", ".join(f"('{b}', {b!r}::double)" for b in bounds)
    return with_txn(f"""
  SELECT model_version, n, total_us, le, bucket_count FROM (
    SELECT model_version, le, count(*) FILTER (s <= b) AS bucket_count
    FROM lat, (VALUES {le}, ('+Inf', 'inf'::double)) AS bounds(le, b) GROUP BY ALL)
  JOIN (SELECT model_version, count(*) AS n,
          sum(floor(s * 1000000.0::double + 0.5::double)::BIGINT)::BIGINT AS total_us
        FROM lat GROUP BY ALL) USING (model_version)""",
        f"lat AS (SELECT 'v' || (k % 3) AS model_version, latency_ms / {scale}::double AS s FROM txn)")


@query("latency_histogram", _hist_sql(E.SCORING_BOUNDS, "1000.0"))
def latency_histogram(spark, sf):
    return E.latency_histogram(scores(spark, sf), F.col("latency_ms") / F.lit(1000.0),
                               E.SCORING_BOUNDS, ["model_version"])


@query("fetch_latency_histogram", _hist_sql(E.FETCH_BOUNDS, "10000.0"))
def fetch_latency_histogram(spark, sf):
    return E.latency_histogram(scores(spark, sf), F.col("latency_ms") / F.lit(10000.0),
                               E.FETCH_BOUNDS, ["model_version"])


@query("investigation_latency_histogram", _hist_sql(E.INVESTIGATION_BOUNDS, "1.0"))
def investigation_latency_histogram(spark, sf):
    return E.latency_histogram(scores(spark, sf), F.col("latency_ms") / F.lit(1.0),
                               E.INVESTIGATION_BOUNDS, ["model_version"])


@query("pattern_breakdown", with_txn("""
  SELECT coalesce(fraud_pattern, 'none') AS fraud_pattern, count(*) AS n,
    (SELECT sum(is_fraud)::double * 100.0::double / count(*)::double FROM txn) AS overall_fraud_pct
  FROM txn GROUP BY ALL"""))
def pattern_breakdown(spark, sf):
    return E.pattern_breakdown(transactions(spark, sf))


# H -----------------------------------------------------------------------------------

CONF = """conf AS (SELECT count(*) FILTER (p >= 0.5::double AND y = 1) AS tp,
  count(*) FILTER (p >= 0.5::double AND y = 0) AS fp, count(*) FILTER (p < 0.5::double AND y = 0) AS tn,
  count(*) FILTER (p < 0.5::double AND y = 1) AS fn FROM pred)"""


@query("confusion_matrix", with_txn("SELECT * FROM conf", PRED, CONF))
def confusion_matrix(spark, sf):
    return H.confusion_matrix(predictions(spark, sf))


_PRF = f"""{rdp('coalesce(tp::double / nullif(tp + fp, 0)::double, 0.0::double)', 4)} AS precision,
  {rdp('coalesce(tp::double / nullif(tp + fn, 0)::double, 0.0::double)', 4)} AS recall,
  {rdp('coalesce((2 * tp)::double / nullif(2 * tp + fp + fn, 0)::double, 0.0::double)', 4)} AS f1_score"""


@query("precision_recall_f1", with_txn(f"SELECT *, {_PRF} FROM conf", PRED, CONF))
def precision_recall_f1(spark, sf):
    return H.precision_recall_f1(H.confusion_matrix(predictions(spark, sf)))


@query("label_confusion", """
  SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp,
    count(*) FILTER (quality = 0 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 1) AS fn
  FROM labels""")
def label_confusion(spark, sf):
    return H.confusion_matrix(read_table(spark, sf, "labels").select(
        F.col("toxic").alias("y"), F.col("quality").cast("double").alias("p")))


def curve_cte(p: str, name: str) -> str:
    return f"""{name}_pts AS (
  SELECT p, pos, neg, sum(pos) OVER (ORDER BY p DESC)::BIGINT AS cp, sum(neg) OVER (ORDER BY p DESC)::BIGINT AS cn,
    sum(pos) OVER ()::BIGINT AS np, sum(neg) OVER ()::BIGINT AS nn
  FROM (SELECT {p} AS p, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM pred GROUP BY 1)),
{name}_curve AS (
  SELECT any_value(np) AS np, any_value(nn) AS nn,
    sum(neg::hugeint * (2 * cp - pos))::double / (any_value(np)::double * any_value(nn)::double * 2.0::double) AS auc,
    sum(pos * (cp::double / (cp + cn)::double)) / any_value(np)::double AS ap,
    coalesce(max(cp::double / (cp + cn)::double) FILTER (cp::double / np::double >= 0.9::double), 0.0::double) AS p90,
    coalesce(max(cp::double / np::double) FILTER (cn::double / nn::double <= 0.01::double), 0.0::double) AS r1
  FROM {name}_pts)"""


CURVE = curve_cte("p", "m")


@query("roc_auc", with_txn(f"SELECT {rdp('auc', 4)} AS auc_roc FROM m_curve", PRED, CURVE))
def roc_auc(spark, sf):
    return H.roc_auc(predictions(spark, sf))


@query("pr_auc", with_txn(f"SELECT {rdp('ap', 4)} AS pr_auc FROM m_curve", PRED, CURVE))
def pr_auc(spark, sf):
    return H.average_precision(predictions(spark, sf))


@query("precision_at_recall", with_txn(f"SELECT {rdp('p90', 4)} AS precision_at_recall FROM m_curve",
                                       PRED, CURVE))
def precision_at_recall(spark, sf):
    return H.precision_at_recall(predictions(spark, sf))


@query("recall_at_fpr", with_txn(f"SELECT {rdp('r1', 4)} AS recall_at_fpr FROM m_curve", PRED, CURVE))
def recall_at_fpr(spark, sf):
    return H.recall_at_fpr(predictions(spark, sf))


def metrics_cte(p: str, name: str) -> str:
    conf = CONF.replace("conf AS", f"{name}_conf AS").replace("p >=", f"{p} >=").replace("p <", f"{p} <")
    return f"""{curve_cte(p, name)}, {conf},
{name}_metrics AS (SELECT {rdp('auc', 4)} AS auc_roc, {rdp('ap', 4)} AS pr_auc, 0.5::double AS threshold,
  {_PRF}, {rdp('p90', 4)} AS precision_at_90_recall, {rdp('r1', 4)} AS recall_at_1_fpr,
  tp AS true_positives, fp AS false_positives, tn AS true_negatives, fn AS false_negatives,
  np + nn AS total_samples FROM {name}_curve, {name}_conf)"""


@query("all_metrics", with_txn("SELECT * FROM m_metrics", PRED, metrics_cte("p", "m")))
def all_metrics(spark, sf):
    return H.all_metrics(predictions(spark, sf))


def _q(q):
    pos = f"{q}::double * (n - 1)::double"
    at = lambda f: f"max(v) FILTER (r = {f}({pos})::BIGINT)"
    return f"({at('floor')} + ({at('ceil')} - {at('floor')}) * any_value({pos} - floor({pos})))"


LATENCY = f"""lat AS (SELECT latency_ms AS v, row_number() OVER (ORDER BY latency_ms) - 1 AS r,
  count(*) OVER () AS n FROM txn),
lat_q AS (SELECT {rdp(_q('0.5'), 3)} AS latency_p50_ms, {rdp(_q('0.95'), 3)} AS latency_p95_ms,
  {rdp(_q('0.99'), 3)} AS latency_p99_ms,
  {rdp("sum(round(v * 1000000.0::double)::BIGINT)::double / count(*)::double / 1000000.0::double", 3)}
    AS latency_mean_ms FROM lat)"""


@query("latency_percentiles", with_txn("SELECT * FROM lat_q", LATENCY))
def latency_percentiles(spark, sf):
    return H.latency_percentiles(transactions(spark, sf))


def _with_latency(spark, sf, column, p99):
    return H.all_metrics(predictions(spark, sf, column)).withColumn("latency_p99_ms", p99)


def _both(spark, sf):
    t = transactions(spark, sf)
    p99 = H.latency_percentiles(t).select("latency_p99_ms").scalar()
    return (_with_latency(spark, sf, "candidate_score", F.lit(4.5)),
            _with_latency(spark, sf, "risk_score", p99))


_GATES = f"""cand AS (SELECT *, 4.5::double AS latency_p99_ms FROM c_metrics),
prod AS (SELECT m.*, l.latency_p99_ms FROM m_metrics m, lat_q l),
g1 AS (SELECT *, CASE WHEN auc_roc < 0.85::double THEN 1 ELSE 0 END + CASE WHEN pr_auc < 0.7::double THEN 1 ELSE 0 END
  + CASE WHEN recall_at_1_fpr < 0.6::double THEN 1 ELSE 0 END
  + CASE WHEN latency_p99_ms > 10.0::double THEN 1 ELSE 0 END AS n_violations FROM cand),
g2 AS (SELECT {rdp('c.auc_roc - p.auc_roc', 4)} AS delta_auc_roc, {rdp('c.pr_auc - p.pr_auc', 4)} AS delta_pr_auc,
  {rdp('c.recall_at_1_fpr - p.recall_at_1_fpr', 4)} AS delta_recall_at_1_fpr,
  {rdp('c.f1_score - p.f1_score', 4)} AS delta_f1_score,
  {rdp('c.precision_at_90_recall - p.precision_at_90_recall', 4)} AS delta_p90,
  {rdp('c.latency_p99_ms - p.latency_p99_ms', 3)} AS delta_latency_p99_ms, c.latency_p99_ms AS cl FROM cand c, prod p),
g2r AS (SELECT *, (delta_pr_auc < 0)::INT + (delta_auc_roc < -0.005::double)::INT + (delta_recall_at_1_fpr < 0)::INT
  + (cl > 10.0::double)::INT + (delta_latency_p99_ms > 1.0::double)::INT AS n_reasons FROM g2)"""
_GATE_CTES = (PRED, metrics_cte("p", "m"), metrics_cte("p2", "c"), LATENCY, _GATES)


@query("gate1_benchmark", with_txn(
    "SELECT auc_roc, pr_auc, recall_at_1_fpr, latency_p99_ms, n_violations::BIGINT AS n_violations, "
    "n_violations = 0 AS passed FROM g1", *_GATE_CTES))
def gate1_benchmark(spark, sf):
    gate = H.gate1_benchmark(_both(spark, sf)[0])
    return gate.select("auc_roc", "pr_auc", "recall_at_1_fpr", "latency_p99_ms",
                       F.size("violations").cast("bigint").alias("n_violations"), "passed")


@query("gate2_regression", with_txn(
    "SELECT delta_auc_roc, delta_pr_auc, delta_recall_at_1_fpr, delta_f1_score, delta_latency_p99_ms, "
    "n_reasons::BIGINT AS n_reasons, n_reasons = 0 AS is_promotable FROM g2r", *_GATE_CTES))
def gate2_regression(spark, sf):
    gate = H.gate2_regression(*_both(spark, sf))
    return gate.select("delta_auc_roc", "delta_pr_auc", "delta_recall_at_1_fpr", "delta_f1_score",
                       "delta_latency_p99_ms",
                       F.size("regression_reasons").cast("bigint").alias("n_reasons"), "is_promotable")


_V = lambda gate, m, v, ref, st: (f"SELECT {gate} AS gate, '{m}' AS metric, {v}::double AS value, "
                                  f"{ref}::double AS reference, {st} AS status FROM g1, g2r")
_ST = lambda cond, bad: f"CASE WHEN {cond} THEN 'PASS' ELSE '{bad}' END"


@query("promotion_verdict", with_txn(f"""
  SELECT CASE WHEN (SELECT n_violations = 0 FROM g1) AND (SELECT n_reasons = 0 FROM g2r)
    THEN 'APPROVED FOR PROMOTION' ELSE 'PROMOTION BLOCKED' END AS decision, v.* FROM (
  {_V(1, 'auc_roc', 'auc_roc', '0.85', _ST('auc_roc >= 0.85::double', 'FAIL'))} UNION ALL
  {_V(1, 'pr_auc', 'pr_auc', '0.7', _ST('pr_auc >= 0.7::double', 'FAIL'))} UNION ALL
  {_V(1, 'recall_at_1_fpr', 'recall_at_1_fpr', '0.6', _ST('recall_at_1_fpr >= 0.6::double', 'FAIL'))} UNION ALL
  {_V(1, 'latency_p99_ms', 'latency_p99_ms', '10.0', _ST('latency_p99_ms <= 10.0::double', 'FAIL'))} UNION ALL
  {_V(2, 'pr_auc', 'delta_pr_auc', '0.0', _ST('delta_pr_auc >= 0', 'REGRESSED'))} UNION ALL
  {_V(2, 'auc_roc', 'delta_auc_roc', '(-0.005)', _ST('delta_auc_roc >= -0.005::double', 'REGRESSED'))} UNION ALL
  {_V(2, 'recall_at_1_fpr', 'delta_recall_at_1_fpr', '0.0', _ST('delta_recall_at_1_fpr >= 0', 'REGRESSED'))} UNION ALL
  {_V(2, 'precision_at_90_recall', 'delta_p90', 'NULL', "'Informational'")} UNION ALL
  {_V(2, 'f1_score', 'delta_f1_score', 'NULL', "'Informational'")} UNION ALL
  {_V(2, 'latency_p99_ms', 'delta_latency_p99_ms', '1.0', _ST('delta_latency_p99_ms <= 1.0::double', 'REGRESSED'))}) v""",
                                     *_GATE_CTES))
def promotion_verdict(spark, sf):
    cand, prod = _both(spark, sf)
    return H.promotion_verdict(H.gate1_benchmark(cand), H.gate2_regression(cand, prod))


@query("financial_cost", with_txn("""
  SELECT (fn * 500 + fp * 10)::double AS total_financial_loss, fn AS false_negatives, fp AS false_positives,
    tp AS true_positives, tn AS true_negatives,
    (fn * 500 + fp * 10)::double / greatest(1, tp + fp + tn + fn)::double AS cost_per_transaction
  FROM conf""", PRED, CONF))
def financial_cost(spark, sf):
    return H.financial_cost(predictions(spark, sf))


_GRID = "[" + ", ".join(f"{t!r}::double" for t in H.threshold_grid()) + "]"
_COSTS = f"""costs AS (
  SELECT step, cutoff, count(*) FILTER (p >= cutoff AND y = 1) AS tp, count(*) FILTER (p >= cutoff AND y = 0) AS fp,
    count(*) FILTER (p < cutoff AND y = 0) AS tn, count(*) FILTER (p < cutoff AND y = 1) AS fn
  FROM pred, (SELECT unnest(range(100)) AS step, unnest({_GRID}) AS cutoff) GROUP BY ALL)"""


@query("threshold_costs", with_txn("""
  SELECT step, cutoff, tp AS true_positives, fp AS false_positives, tn AS true_negatives,
    fn AS false_negatives, (fn * 500 + fp * 10)::double AS total_financial_loss FROM costs""", PRED, _COSTS))
def threshold_costs(spark, sf):
    return H.threshold_costs(predictions(spark, sf))


@query("cost_optimal_threshold", with_txn(f"""
  SELECT {rdp('cutoff', 3)} AS optimal_threshold, (fn * 500 + fp * 10)::double AS total_financial_loss,
    fn AS false_negatives, fp AS false_positives, tp AS true_positives, tn AS true_negatives,
    (fn * 500 + fp * 10)::double / (tp + fp + tn + fn)::double AS cost_per_transaction
  FROM costs ORDER BY fn * 500 + fp * 10, step LIMIT 1""", PRED, _COSTS))
def cost_optimal_threshold(spark, sf):
    return H.cost_optimal_threshold(predictions(spark, sf))


@query("class_weight", with_txn("""
  SELECT sum(y)::BIGINT AS n_pos, sum(1 - y)::BIGINT AS n_neg,
    sum(1 - y)::double / sum(y)::double AS scale_pos_weight FROM pred""", PRED))
def class_weight(spark, sf):
    return H.class_weight(predictions(spark, sf))


@query("head_to_head", with_txn(
    "SELECT transaction_id, y, p2 AS candidate_p, p AS production_p FROM pred", PRED))
def head_to_head(spark, sf):
    return H.head_to_head(predictions(spark, sf, "candidate_score"), predictions(spark, sf))


# J -----------------------------------------------------------------------------------

HALF_US = BASE_US + 6 * 3600 * 1_000_000


def features(spark, sf):
    """The offline feature table with label and time, stored once."""
    return stored(spark, sf, "features", lambda: build_feature_vector(
        transactions(spark, sf), keep=("us", "is_fraud", "timestamp", "amount")), read_table(spark, sf, "events").count)


def halves(spark, sf):
    f = features(spark, sf)
    early = F.col("us") < F.lit(HALF_US)
    return f.where(early).select(*FEATURES), f.where(~early).select(*FEATURES)


_CELLS = " UNION ALL ".join(
    f"SELECT {i} AS fi, '{f}' AS feature, "
    f"{f + '::INT::double' if FEATURE_TYPES[f] == 'boolean' else f + '::double'} AS v, early FROM fx"
    for i, f in enumerate(FEATURES))
_EDGE_POS = "(q::double / 10.0::double) * (n - 1)::double"
DRIFT = f"""fx AS (SELECT f.*, t.us < {HALF_US} AS early FROM features f JOIN txn t USING (transaction_id)),
cells AS ({_CELLS}),
sizes AS (SELECT feature, count(*) FILTER (early) AS rn, count(*) FILTER (NOT early) AS cn FROM cells GROUP BY 1),
ranked AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS r,
  count(*) OVER (PARTITION BY feature) AS n FROM cells WHERE early),
qs AS (SELECT feature, q, max(v) FILTER (r = floor({_EDGE_POS})::BIGINT) AS a,
  max(v) FILTER (r = ceil({_EDGE_POS})::BIGINT) AS b, any_value({_EDGE_POS} - floor({_EDGE_POS})) AS t
  FROM ranked, (SELECT unnest(range(11)) AS q) GROUP BY feature, q),
edges AS (SELECT feature, list_sort(list(DISTINCT a + (b - a) * t)) AS e FROM qs GROUP BY feature),
bins AS (SELECT feature, e[2:len(e) - 1] AS inner_e, len(e) - 1 AS nb FROM edges),
counted AS (SELECT feature, bin, count(*) FILTER (early) AS r, count(*) FILTER (NOT early) AS c FROM (
  SELECT c.feature, early, (SELECT count(*) FROM (SELECT unnest(inner_e) AS x) WHERE x <= v) AS bin
  FROM cells c JOIN bins USING (feature)) GROUP BY ALL),
grid AS (SELECT feature, nb, unnest(range(nb)) AS bin FROM bins),
shares AS (SELECT feature, (coalesce(r, 0)::double + 0.0001::double) / (rn::double + 0.0001::double * nb::double) AS rp,
  (coalesce(c, 0)::double + 0.0001::double) / (cn::double + 0.0001::double * nb::double) AS cp
  FROM grid LEFT JOIN counted USING (feature, bin) JOIN sizes USING (feature)),
psi AS (SELECT s.feature, least(greatest(coalesce(x, 0.0::double), 0.0::double), 10.0::double) AS psi FROM sizes s
  LEFT JOIN (SELECT feature, sum((cp - rp) * ln(cp / rp)) AS x FROM shares GROUP BY 1) USING (feature)
  WHERE rn >= 5 AND cn >= 5),
vals AS (SELECT feature, v, count(*) FILTER (early) AS r, count(*) FILTER (NOT early) AS c FROM cells GROUP BY ALL),
cdf AS (SELECT feature, lead(v) OVER w - v AS gap, sum(r) OVER w AS cr, sum(c) OVER w AS cc FROM vals
  WINDOW w AS (PARTITION BY feature ORDER BY v)),
emd AS (SELECT feature, coalesce(sum(gap * abs(cr::double / rn::double - cc::double / cn::double)), 0.0::double) AS emd
  FROM cdf JOIN sizes USING (feature) WHERE rn >= 5 AND cn >= 5 GROUP BY 1)"""


@query("psi", with_features(f"SELECT feature, {rdp('psi', 4)} AS psi FROM psi", DRIFT))
def psi(spark, sf):
    return J.psi(*halves(spark, sf))


@query("wasserstein", with_features(f"SELECT feature, {rdp('emd', 4)} AS wasserstein_dist FROM emd", DRIFT))
def wasserstein(spark, sf):
    return J.wasserstein(*halves(spark, sf))


_SEV = ("CASE WHEN psi >= 0.25::double THEN 'SEVERE' WHEN psi >= 0.1::double THEN 'MODERATE' "
        "ELSE 'NONE' END")


@query("drift_severity", with_features(f"SELECT feature, {_SEV} AS severity FROM psi", DRIFT))
def drift_severity(spark, sf):
    return J.drift_report(*halves(spark, sf))[0].select("feature", "severity")


@query("drift_report", with_features(f"""
  SELECT feature, {rdp('psi', 4)} AS psi, {rdp('emd', 4)} AS wasserstein_dist,
    psi >= 0.1::double AS is_drifted, {_SEV} AS severity FROM psi JOIN emd USING (feature)""", DRIFT))
def drift_report(spark, sf):
    return J.drift_report(*halves(spark, sf))[0]


@query("drift_summary", with_features(f"""
  SELECT max(psi) >= 0.1::double OR avg(psi) >= 0.1::double AS overall_drift_detected,
    {rdp('avg(psi)', 4)} AS mean_psi, 17::BIGINT AS features_monitored,
    coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (psi >= 0.1::double), '') AS drifted_features
  FROM psi""", DRIFT))
def drift_summary(spark, sf):
    summary = J.drift_report(*halves(spark, sf))[1]
    return summary.withColumn("drifted_features", F.array_join("drifted_features", ","))


@query("drift_snapshot_append", with_features(f"""
  SELECT 'risk_gbt' AS model_name, 'feature_drift' AS snapshot_type,
    max(psi) >= 0.1::double OR avg(psi) >= 0.1::double AS drift_detected,
    {rdp('avg(psi)', 4)} AS drift_score, count(*) AS n_details FROM psi""", DRIFT))
def drift_snapshot_append(spark, sf):
    rows, summary = J.drift_report(*halves(spark, sf))
    path = work_dir(spark, "drift")
    J.append_drift(rows, summary, path, "risk_gbt")
    return spark.read.parquet(path).select("model_name", "snapshot_type", "drift_detected", "drift_score",
                         F.json_array_length("details").cast("bigint").alias("n_details"))


# K -----------------------------------------------------------------------------------

BUCKET = "(" + "(((" + "{0} % 100) * 96 + {1}) % 100 * 96 + {2}) % 100 * 96 + {3}) % 100"


def bucket_sql(col: str) -> str:
    chunk = lambda i: f"('0x' || substr(md5({col}), {i}, 8))::BIGINT"
    return "(" + BUCKET.format(*[chunk(i) for i in (1, 9, 17, 25)]) + ")"


@query("canary_bucket", with_txn(
    f"SELECT DISTINCT customer_id, {bucket_sql('customer_id')} AS bucket FROM txn"))
def canary_bucket(spark, sf):
    from riskloom.functions.hashing import canary_bucket as bucket
    return transactions(spark, sf).select("customer_id").distinct().withColumn(
        "bucket", bucket(F.col("customer_id")))


def split_requests(spark, sf):
    """Events read as requests to change the canary split."""
    return transactions(spark, sf).select(
        "event_id", "us", (F.col("k") * 11).cast("double").alias("pct10"), "k").select(
        "event_id", "us", (F.col("pct10") / F.lit(10.0)).alias("canary_percentage"),
        F.when(F.col("k") % 5 != 0, F.concat(F.lit("v"), F.col("k").cast("string"))).alias("canary_version"),
        (F.col("k") % 11 == 0).alias("shadow_mode"))


_SPLIT = """reqs AS (SELECT event_id, us, (k * 11)::double / 10.0::double AS pct,
  CASE WHEN k % 5 <> 0 THEN 'v' || k END AS ver, k % 11 = 0 AS shadow FROM txn),
config AS (SELECT 'baseline_v1' AS champion_version,
  arg_max(ver, (us, event_id)) FILTER (ver IS NOT NULL) AS canary_version,
  arg_max(pct, (us, event_id)) AS canary_percentage, arg_max(shadow, (us, event_id)) AS shadow_mode
  FROM reqs WHERE pct BETWEEN 0 AND 100)"""


@query("update_split", with_txn(
    "SELECT *, canary_percentage > 0 OR shadow_mode AS is_active FROM config", _SPLIT))
def update_split(spark, sf):
    return K.current_split(K.split_log(split_requests(spark, sf))[0])


@query("canary_route", with_txn(f"""
  SELECT transaction_id, CASE WHEN c THEN 'candidate_v2' ELSE 'baseline_v1' END AS model_version, c AS is_canary
  FROM (SELECT transaction_id, {bucket_sql('customer_id')} < 30 AS c FROM txn)"""))
def canary_route(spark, sf):
    config = K.split_config(spark, "candidate_v2", 30.0)
    return K.canary_route(transactions(spark, sf).select("transaction_id", "customer_id"), config).drop(
        "customer_id")


@query("shadow_score", with_txn("""
  SELECT transaction_id, risk_score AS decision_score, candidate_score AS shadow_score FROM txn"""))
def shadow_score(spark, sf):
    config = K.split_config(spark, "candidate_v2", 0.0, shadow_mode=True)
    return K.shadow_score(transactions(spark, sf), config).select(
        "transaction_id", "decision_score", "shadow_score")


def observations(spark, sf):
    config = K.split_config(spark, "candidate_v2", 30.0)
    routed = K.canary_route(transactions(spark, sf), config)
    return routed.select(
        F.when(F.col("is_canary"), "canary").otherwise("champion").alias("arm"), "us",
        "transaction_id", "latency_ms", (F.col("k") == 7).alias("is_error"),
        (F.col("risk_score") >= 0.6).alias("was_flagged"))


_OBS = f"""obs AS (SELECT CASE WHEN {bucket_sql('customer_id')} < 30 THEN 'canary' ELSE 'champion' END AS arm, us,
  transaction_id, latency_ms, k = 7 AS is_error, risk_score >= 0.6::double AS was_flagged FROM txn),
health AS (SELECT arm, count(*) AS n, quantile_cont(latency_ms, 0.5) AS p50, quantile_cont(latency_ms, 0.99) AS p99,
  avg(is_error::INT::double) AS err, avg(was_flagged::INT::double) AS flag
  FROM (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY arm ORDER BY us DESC, transaction_id DESC) <= 200)
  GROUP BY arm)"""


@query("canary_health", with_txn(f"""
  SELECT arm, n, {rdp('p50', 2)} AS p50_latency_ms, {rdp('p99', 2)} AS p99_latency_ms,
    {rdp('err', 4)} AS error_rate, {rdp('flag', 4)} AS flag_rate FROM health""", _OBS))
def canary_health(spark, sf):
    return K.health_report(K.canary_health(observations(spark, sf)))


@query("rollback_decision", with_txn(f"""
  SELECT 'candidate_v2' AS canary_version, 'baseline_v1' AS champion_version, n AS samples,
    concat_ws('; ',
      CASE WHEN p99 > 10 THEN 'Canary p99 latency (' || printf('%.2f', p99) || 'ms) breached 10.0ms SLA' END,
      CASE WHEN err > 0.005::double THEN 'Canary error rate (' || printf('%.2f', err * 100) || '%) exceeded 0.50% threshold' END,
      CASE WHEN champ > 0 AND flag > champ * 3 THEN 'Canary false-positive rate (' || printf('%.2f', flag * 100)
        || '%) spiked >3.0x champion baseline (' || printf('%.2f', champ * 100) || '%)' END) AS reason,
    (p99 > 10 OR err > 0.005::double OR (champ > 0 AND flag > champ * 3)) AS rolled_back,
    {rdp('p99', 2)} AS p99_latency_ms, {rdp('err', 4)} AS error_rate, {rdp('flag', 4)} AS flag_rate,
    {rdp('champ', 4)} AS champ_flag_rate
  FROM (SELECT *, (SELECT flag FROM health WHERE arm = 'champion') AS champ FROM health WHERE arm = 'canary')""", _OBS))
def rollback_decision(spark, sf):
    return K.rollback_decision(K.canary_health(observations(spark, sf)),
                               K.split_config(spark, "candidate_v2", 30.0))


def registry_log(spark, sf):
    """Events read as registry actions of three models."""
    e = read_table(spark, sf, "events")
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("bigint")
    return e.select(
        F.concat(F.lit("model_"), (F.col("user_id") % 3).cast("string")).alias("model_name"),
        F.concat(F.lit("v"), k.cast("string")).alias("version"),
        F.when(F.col("event_type") == "purchase", "promote").when(F.col("event_type") == "error", "rollback")
        .when(F.col("event_type") == "click", "canary").otherwise("register").alias("action"),
        (k % 4 != 0).alias("gate_passed"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")


_REGISTRY = """log AS (SELECT 'model_' || (user_id % 3) AS model_name, 'v' || k AS version,
  CASE event_type WHEN 'purchase' THEN 'promote' WHEN 'error' THEN 'rollback' WHEN 'click' THEN 'canary'
    ELSE 'register' END AS action, k % 4 <> 0 AS gate_passed, epoch_us(ts) AS us, event_id
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events)),
eff AS (SELECT *, action = 'rollback' OR (action = 'promote' AND gate_passed) AS takes FROM log),
ver AS (SELECT model_name, version, max(us) FILTER (takes) AS promoted_us, bool_or(action = 'canary') AS canary,
  count(*) FILTER (action = 'promote' AND NOT gate_passed) AS blocked_promotions FROM eff GROUP BY ALL),
prod AS (SELECT model_name, arg_max(version, (us, event_id)) AS p FROM eff WHERE takes GROUP BY 1)"""


@query("model_registry", "WITH " + _REGISTRY + """
  SELECT v.model_name, version, CASE WHEN version = p THEN 'production' WHEN promoted_us IS NOT NULL THEN 'retired'
    WHEN canary THEN 'canary' ELSE 'candidate' END AS status, blocked_promotions, promoted_us
  FROM ver v LEFT JOIN prod USING (model_name)""")
def model_registry(spark, sf):
    return K.registry_state(registry_log(spark, sf))


@query("current_production", "WITH " + _REGISTRY + " SELECT model_name, p AS version FROM prod")
def current_production(spark, sf):
    return K.current_production(registry_log(spark, sf))


_INTERVALS = _REGISTRY + """,
chg AS (SELECT *, lag(version) OVER (PARTITION BY model_name ORDER BY us, event_id) AS prev FROM eff WHERE takes),
iv AS (SELECT model_name, version, us AS from_us, event_id,
  lead(us) OVER (PARTITION BY model_name ORDER BY us, event_id) AS to_us FROM chg WHERE prev IS DISTINCT FROM version)"""


@query("production_intervals", "WITH " + _INTERVALS + " SELECT * FROM iv")
def production_intervals(spark, sf):
    return K.production_intervals(registry_log(spark, sf))


def registry_snapshots(spark, sf):
    """Events without a registry action read as drift snapshots of the three models."""
    e = read_table(spark, sf, "events").where("event_type NOT IN ('purchase', 'error', 'click')")
    score = (F.col("user_id") % 50) / F.lit(100.0)
    return e.select(
        F.concat(F.lit("model_"), (F.col("user_id") % 3).cast("string")).alias("model_name"),
        F.when(F.col("event_id") % 2 == 0, "feature_drift").otherwise("prediction_drift").alias("snapshot_type"),
        (score >= 0.25).alias("drift_detected"), score.alias("drift_score"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id")


@query("version_drift", "WITH " + _INTERVALS + """,
snap AS (SELECT 'model_' || (user_id % 3) AS model_name, event_id % 2 = 0 AS is_feature, (user_id % 50) / 100.0 >= 0.25 AS hit,
  CAST(user_id % 50 AS DOUBLE) / 100.0 AS score, epoch_us(ts) AS us, event_id
  FROM events WHERE event_type NOT IN ('purchase', 'error', 'click')),
seen AS (SELECT model_name, version, count(*) AS snapshots, count(*) FILTER (hit) AS drifted_snapshots,
  arg_max(hit, (s.us, s.event_id)) FILTER (is_feature) AS feature_drift_detected,
  arg_max(hit, (s.us, s.event_id)) FILTER (NOT is_feature) AS prediction_drift_detected,
  arg_max(score, (s.us, s.event_id)) AS drift_score
  FROM snap s JOIN iv USING (model_name) WHERE s.us >= from_us AND (to_us IS NULL OR s.us < to_us) GROUP BY ALL),
times AS (SELECT model_name, version, count(*) AS times_in_production, min(from_us) AS first_us,
  CAST(coalesce(sum(to_us - from_us), 0) AS BIGINT) AS closed_us, bool_or(to_us IS NULL) AS is_production FROM iv GROUP BY ALL)
  SELECT t.*, coalesce(snapshots, 0) AS snapshots, coalesce(drifted_snapshots, 0) AS drifted_snapshots,
    feature_drift_detected, prediction_drift_detected, drift_score,
    CASE WHEN snapshots IS NULL THEN 'unknown' WHEN feature_drift_detected OR prediction_drift_detected THEN 'drifted'
      ELSE 'stable' END AS drift_status
  FROM times t LEFT JOIN seen USING (model_name, version)""")
def version_drift(spark, sf):
    return K.version_drift(registry_log(spark, sf), registry_snapshots(spark, sf))
