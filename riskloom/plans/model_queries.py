"""Queries around models: everything after a fit, with scorecards in place of trees so that SQL can follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import lifecycle as K
from riskloom.operators import scoring as E
from riskloom.operators import training as TR
from riskloom.operators.scorecard import scorecard
from riskloom.plans.data_queries import _STRAT, _ranked, halves, training_splits
from riskloom.plans.governance_queries import LABEL, _GRID, bucket_sql, curve_cte, features
from riskloom.plans.sql_base import rdp, with_features
from riskloom.schemas import FEATURES
from riskloom.session import work_dir
from riskloom.sources.adapter import MIDDLE_US, transactions
from riskloom.streaming import jobs as L

QUERIES = {}
SQL = {}


def query(name, sql):
    def register(fn):
        QUERIES[name] = fn
        SQL[name] = sql
        return fn
    return register


#: Parameters of the scorecards: what a point of each feature adds.
CARDS = {"card_v1": (0.02, 0.3, 0.001), "card_v2": (0.05, 0.1, 0.002), "card_v3": (0.01, 0.5, 0.0005)}


def card_formula(per_txn: float, new_device: float, per_rupee: float, base: float = 0.05) -> str:
    return (f"{base!r}D + {per_txn!r}D * txn_count_24hr + {new_device!r}D * is_new_device + {per_rupee!r}D * max_amount_24hr")


def card_sql(per_txn: float, new_device: float, per_rupee: float, base: str = "0.05::double") -> str:
    return (f"greatest(least({base} + {per_txn!r}::double * txn_count_24hr::double + {new_device!r}::double * is_new_device::INT::double"
            f" + {per_rupee!r}::double * max_amount_24hr, 1.0::double), 0.0::double)")


def _tiers(p):
    return LABEL.replace("risk_score", p)


@query("score_transactions_card", with_features(f"""SELECT transaction_id, p, {rdp('p', 4)} AS risk_score, 'card_v1' AS model_version,
  {_tiers(rdp('p', 4))} AS risk_label, {rdp('p', 4)} >= 0.6::double AS was_flagged, CASE WHEN {rdp('p', 4)} < 0.3::double THEN 0.3::double
  WHEN {rdp('p', 4)} < 0.85::double THEN 0.6::double ELSE 0.85::double END AS threshold_used
  FROM (SELECT transaction_id, {card_sql(*CARDS['card_v1'])} AS p FROM features)"""))
def score_transactions_card(spark, sf):
    return E.risk_tier(E.score(features(spark, sf), scorecard(card_formula(*CARDS["card_v1"])), "card_v1"))


_SPLIT = f"""split AS (SELECT transaction_id, is_fraud AS y, CASE WHEN rnk <= c1 THEN 'train' WHEN rnk <= c2 THEN 'val' ELSE 'test' END AS split
  FROM ({_ranked('is_fraud')}) JOIN cuts USING (is_fraud)),
scored AS (SELECT s.*, {card_sql(*CARDS['card_v1'])} AS p FROM split s JOIN features USING (transaction_id))"""
_BEST = f"""best AS (SELECT {rdp('cutoff', 3)} AS cut FROM (SELECT step, cutoff, count(*) FILTER (p < cutoff AND y = 1) * 500
  + count(*) FILTER (p >= cutoff AND y = 0) * 10 AS cost FROM (SELECT * FROM scored WHERE split = 'val'),
  (SELECT unnest(range(100)) AS step, unnest({_GRID}) AS cutoff) GROUP BY ALL) ORDER BY cost, step LIMIT 1),
pred AS (SELECT y, p FROM scored WHERE split = 'test'),
at_best AS (SELECT count(*) FILTER (p >= cut AND y = 1) AS tp, count(*) FILTER (p >= cut AND y = 0) AS fp,
  count(*) FILTER (p < cut AND y = 1) AS fn FROM pred, best),
at_half AS (SELECT count(*) FILTER (p >= 0.5::double AND y = 1) AS tp, count(*) FILTER (p >= 0.5::double AND y = 0) AS fp,
  count(*) FILTER (p < 0.5::double AND y = 1) AS fn FROM pred)"""
_RATE = lambda top, bottom, of: rdp(f"(SELECT coalesce(({top})::double / nullif({bottom}, 0)::double, 0.0::double) FROM {of})", 4)


@query("training_metadata_card", with_features(f"""SELECT 'card_v1' AS model_version, (SELECT count(*) FROM scored WHERE split = 'train') AS train_samples,
  (SELECT count(*) FROM scored WHERE split = 'val') AS val_samples, (SELECT count(*) FROM scored WHERE split = 'test') AS test_samples,
  (SELECT sum(1 - y)::double / sum(y)::double FROM scored WHERE split = 'train') AS scale_pos_weight, (SELECT cut FROM best) AS optimal_threshold,
  {rdp('(SELECT auc FROM m_curve)', 4)} AS auc_roc, {rdp('(SELECT ap FROM m_curve)', 4)} AS pr_auc,
  {_RATE('2 * tp', '2 * tp + fp + fn', 'at_half')} AS f1_score_standard_05, {_RATE('2 * tp', '2 * tp + fp + fn', 'at_best')} AS f1_score_optimal,
  {_RATE('tp', 'tp + fp', 'at_best')} AS precision_optimal, {_RATE('tp', 'tp + fn', 'at_best')} AS recall_optimal,
  (SELECT (fn * 500 + fp * 10)::double FROM at_best) AS financial_loss, (SELECT fn FROM at_best) AS missed_fraud_count,
  (SELECT fp FROM at_best) AS false_alarms_count""", _STRAT, _SPLIT, _BEST, curve_cte("p", "m")))
def training_metadata_card(spark, sf):
    """Sizes, weight, cut-off on the validation rows, metrics and cost on the test rows."""
    return TR.training_metadata(scorecard(card_formula(*CARDS["card_v1"])), training_splits(spark, sf), "card_v1")


def fit_card(train, held, params, rounds, seed):
    """A scorecard whose base is the share of fraud in the training rows."""
    return scorecard(card_formula(*params["points"], train.agg(F.avg("y")).head()[0]))


def _tuning_sql():
    case = " ".join(f"WHEN {i} THEN {card_sql(*points, base='base')}" for i, points in enumerate(CARDS.values()))
    return with_features(f"""SELECT candidate_idx, {rdp('sum(ap) / 3.0::double', 4)} AS mean_pr_auc, {rdp('sum(auc) / 3.0::double', 4)} AS mean_roc_auc
  FROM (SELECT candidate_idx, fold, {rdp('sum(neg::hugeint * (2 * cp - pos))::double / (any_value(np)::double * any_value(nn)::double * 2.0::double)', 4)} AS auc,
    {rdp('sum(pos * (cp::double / (cp + cn)::double)) / any_value(np)::double', 4)} AS ap FROM points GROUP BY ALL) GROUP BY candidate_idx""",
        _STRAT, _SPLIT.split("\nscored AS")[0].rstrip(","),
        f"folded AS (SELECT transaction_id, y, (rnk - 1) % 3 AS fold FROM ({_ranked('y', table='split WHERE split = $$train$$')}))",
        "bases AS (SELECT f.fold, avg(g.y) AS base FROM (SELECT unnest(range(3)) AS fold) f JOIN folded g ON g.fold <> f.fold GROUP BY 1)",
        f"""held AS (SELECT candidate_idx, fold, y, CASE candidate_idx {case} END AS p FROM folded JOIN bases USING (fold)
  JOIN features USING (transaction_id), (SELECT unnest(range(3)) AS candidate_idx))""",
        """points AS (SELECT candidate_idx, fold, pos, neg, sum(pos) OVER (up)::BIGINT AS cp, sum(neg) OVER (up)::BIGINT AS cn,
  sum(pos) OVER (PARTITION BY candidate_idx, fold)::BIGINT AS np, sum(neg) OVER (PARTITION BY candidate_idx, fold)::BIGINT AS nn
  FROM (SELECT candidate_idx, fold, p, sum(y)::BIGINT AS pos, sum(1 - y)::BIGINT AS neg FROM held GROUP BY ALL)
  WINDOW up AS (PARTITION BY candidate_idx, fold ORDER BY p DESC))""")


@query("tune_cards", _tuning_sql())
def tune_cards(spark, sf):
    """Three candidates by three folds, nine fits side by side; the areas of all folds in one grouped pass."""
    rows = training_splits(spark, sf).where(F.col("split") == "train").drop("split")
    points = [{"points": p} for p in CARDS.values()]
    return TR.tuning_history(TR.fold_scores(rows, 3, points, parallelism=9, fit=fit_card))


_SERVED = f"""served AS (SELECT f.*, us, CASE WHEN us < {MIDDLE_US} THEN CASE WHEN b < 30 THEN 2 ELSE 1 END
    ELSE CASE WHEN b < 50 THEN 3 ELSE 2 END END AS v FROM features f
  JOIN (SELECT transaction_id, us, {bucket_sql('customer_id')} AS b FROM txn) USING (transaction_id)),
judged AS (SELECT *, {rdp('p', 4)} AS risk_score FROM (SELECT *, CASE v {' '.join(f'WHEN {i} THEN {card_sql(*points)}' for i, points in enumerate(CARDS.values(), 1))} END AS p FROM served))"""


@query("stream_versioned_alerts", with_features(f"""SELECT transaction_id AS key, 'card_v' || v AS model_version, (us < {MIDDLE_US} AND v = 2) OR (us >= {MIDDLE_US} AND v = 3) AS is_canary,
  risk_score, {LABEL} AS risk_label, CASE WHEN risk_score >= 0.85::double THEN 'URGENT' ELSE 'NORMAL' END AS priority,
  txn_count_24hr, max_amount_24hr, is_new_device FROM judged WHERE risk_score >= 0.6::double""", _SERVED))
def stream_versioned_alerts(spark, sf):
    """Two batches of the feature stream; between them a promotion and a new canary share reach the running job."""
    root, models = work_dir(spark, "serving"), work_dir(spark, "models")
    for version, points in CARDS.items():
        scorecard(card_formula(*points)).write().save(f"{models}/{version}")
    made = features(spark, sf)
    registry, split = f"{root}/registry", f"{root}/split"
    share = lambda us, version, pct: spark.range(1).select(
        F.lit(us).cast("bigint").alias("us"), F.lit(0).cast("bigint").alias("event_id"), F.lit(version).alias("canary_version"),
        F.lit(pct).alias("canary_percentage"), F.lit(False).alias("shadow_mode")).write.mode("append").parquet(split)
    changes = [("card_v1", "card_v2", 30.0), ("card_v2", "card_v3", 50.0)]
    for at, (landing, (champion, canary, pct)) in enumerate(zip(halves(spark, made), changes)):
        K.append_registry(K.rollback_event(spark, "fraud", champion, at, at), registry)
        share(at, canary, pct)
        L.stream_versioned_alerts(spark.readStream.schema(made.schema).parquet(landing), L.saved_models(models),
                                  "fraud", registry, split, FEATURES, root, root + "-ckpt")
    alerts = spark.read.parquet(f"{root}/alerts")
    get = lambda f: F.get_json_object("value", f"$.{f}")
    return alerts.select(
        "key", "model_version", "is_canary", get("risk_score").cast("double").alias("risk_score"), get("risk_label").alias("risk_label"),
        get("priority").alias("priority"), get("features.txn_count_24hr").cast("bigint").alias("txn_count_24hr"),
        get("features.max_amount_24hr").cast("double").alias("max_amount_24hr"), get("features.is_new_device").cast("boolean").alias("is_new_device"))
