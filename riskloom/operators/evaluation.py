"""Classification metrics, costs and promotion gates as aggregations.

Inputs have a label column ``y`` (0/1) and a score column ``p``; ``by`` names
optional grouping columns (for example the model), so several models are
evaluated in the same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numeric import round_dp, safe_ratio
from riskloom.operators.ranking import running_totals, stage_ordered

COST_FN = 500.0
COST_FP = 10.0
LOWEST_CUT, HIGHEST_CUT = 0.05, 0.95


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def confusion_matrix(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    hit, fraud = F.col("p") >= F.lit(threshold), F.col("y") == 1
    zero = F.lit(0).cast("bigint")
    return df.groupBy(*by).agg(
        F.coalesce(_count_if(hit & fraud), zero).alias("tp"),
        F.coalesce(_count_if(hit & ~fraud), zero).alias("fp"),
        F.coalesce(_count_if(~hit & ~fraud), zero).alias("tn"),
        F.coalesce(_count_if(~hit & fraud), zero).alias("fn"))


def _precision() -> Column:
    return safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def _recall() -> Column:
    return safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def _f1() -> Column:
    return safe_ratio(F.col("tp") * F.lit(2), F.col("tp") * F.lit(2) + F.col("fp") + F.col("fn"))


def precision_recall_f1(confusion: DataFrame) -> DataFrame:
    """Adds precision, recall and f1_score (4 places, 0 where undefined)."""
    return confusion.withColumns({
        "precision": round_dp(_precision(), 4), "recall": round_dp(_recall(), 4),
        "f1_score": round_dp(_f1(), 4)})


def score_points(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score, staged in score order.

    The only pass over the predictions: curves, confusion counts and totals all
    come from this table, in which tied scores are one row.
    """
    points = df.groupBy(*by, "p").agg(F.sum(F.col("y").cast("bigint")).alias("pos"),
                                      F.sum((1 - F.col("y")).cast("bigint")).alias("neg"))
    return stage_ordered(points, by, "p")


def _curve_summary(points: DataFrame, by: Sequence[str], target_recall: float = 0.90,
                   max_fpr: float = 0.01, threshold: float = 0.5) -> DataFrame:
    """AUC, average precision, both operating points and the confusion counts."""
    by = list(by)
    curve = running_totals(points, by, "p", ["pos", "neg"], descending=True)
    totals = points.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    if by:
        curve = curve.join(totals, by)
    else:
        curve = curve.select("*", *[totals.select(c).scalar().alias(c) for c in ("n_pos", "n_neg")])
    # Twice the trapezoid area in whole pairs: exact integers up to 38 digits.
    tp_before = (F.col("cum_pos") * 2 - F.col("pos")).cast("decimal(19,0)")
    pairs2 = F.sum((F.col("neg").cast("decimal(19,0)") * tp_before).cast("decimal(38,0)"))
    precision = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    recall = safe_ratio(F.col("cum_pos"), F.col("n_pos"))
    fpr = safe_ratio(F.col("cum_neg"), F.col("n_neg"))
    hit = F.col("p") >= F.lit(threshold)
    count = lambda cond, c: F.sum(F.when(cond, F.col(c)).otherwise(0)).alias
    return curve.groupBy(*by).agg(
        F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"),
        pairs2.cast("double").alias("pairs2"),
        F.sum(F.col("pos") * precision).alias("ap_sum"),
        F.max(F.when(recall >= F.lit(target_recall), precision)).alias("p_at_r"),
        F.max(F.when(fpr <= F.lit(max_fpr), recall)).alias("r_at_fpr"),
        count(hit, "pos")("tp"), count(hit, "neg")("fp"),
        count(~hit, "neg")("tn"), count(~hit, "pos")("fn"),
    ).select(
        *by, "n_pos", "n_neg", "tp", "fp", "tn", "fn",
        safe_ratio(F.col("pairs2"), F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
                   * F.lit(2.0)).alias("auc_roc"),
        safe_ratio(F.col("ap_sum"), F.col("n_pos")).alias("pr_auc"),
        F.coalesce("p_at_r", F.lit(0.0)).alias("precision_at_recall"),
        F.coalesce("r_at_fpr", F.lit(0.0)).alias("recall_at_fpr"))


def roc_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _curve_summary(score_points(df, by), by).select(*by, round_dp(F.col("auc_roc"), 4).alias("auc_roc"))


def average_precision(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return _curve_summary(score_points(df, by), by).select(*by, round_dp(F.col("pr_auc"), 4).alias("pr_auc"))


def precision_at_recall(df: DataFrame, target: float = 0.90, by: Sequence[str] = ()) -> DataFrame:
    return _curve_summary(score_points(df, by), by, target).select(
        *by, round_dp(F.col("precision_at_recall"), 4).alias("precision_at_recall"))


def recall_at_fpr(df: DataFrame, max_fpr: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    return _curve_summary(score_points(df, by), by, max_fpr=max_fpr).select(
        *by, round_dp(F.col("recall_at_fpr"), 4).alias("recall_at_fpr"))


METRICS = ["auc_roc", "pr_auc", "threshold", "precision", "recall", "f1_score",
           "precision_at_90_recall", "recall_at_1_fpr", "true_positives", "false_positives",
           "true_negatives", "false_negatives", "total_samples"]


def all_metrics(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), points: DataFrame | None = None) -> DataFrame:
    """The 13 metrics, one row per group. ``points``: the :func:`score_points` of ``df`` where they are there already."""
    by = list(by)
    points = score_points(df, by) if points is None else points
    both = precision_recall_f1(_curve_summary(points, by, threshold=threshold))
    return both.select(
        *by,
        round_dp(F.col("auc_roc"), 4).alias("auc_roc"), round_dp(F.col("pr_auc"), 4).alias("pr_auc"),
        F.lit(round(threshold, 3)).alias("threshold"), "precision", "recall", "f1_score",
        round_dp(F.col("precision_at_recall"), 4).alias("precision_at_90_recall"),
        round_dp(F.col("recall_at_fpr"), 4).alias("recall_at_1_fpr"),
        F.col("tp").alias("true_positives"), F.col("fp").alias("false_positives"),
        F.col("tn").alias("true_negatives"), F.col("fn").alias("false_negatives"),
        (F.col("n_pos") + F.col("n_neg")).alias("total_samples"))


def quantiles(totals: DataFrame, group: Sequence[str], value: str, n: str, size: str,
              fractions: Sequence[float]) -> DataFrame:
    """Linear-interpolated quantiles (group, q_index, q_value) from running counts.

    ``totals`` has, per distinct value, its count ``n``, the running count
    ``cum_<n>`` and the group size ``size``. Each value covers a range of ranks;
    the two ranks around every requested position are picked out. Memory per task
    does not grow with the number of distinct values, unlike an exact percentile
    aggregate.
    """
    group = list(group)
    targets = F.array(*[
        F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col(size) - 1).cast("double")).alias("pos"))
        for i, q in enumerate(fractions)])
    first, last = F.col(f"cum_{n}") - F.col(n), F.col(f"cum_{n}") - 1
    covers = lambda rank: (rank >= first) & (rank <= last)
    hits = F.filter(targets, lambda t: covers(F.floor(t["pos"])) | covers(F.ceil(t["pos"])))
    rows = (totals.where((F.col(n) > 0) & (F.size(hits) > 0))
            .select(*group, value, first.alias("_f"), last.alias("_l"), F.inline(hits)))
    below, above = F.floor("pos"), F.ceil("pos")
    inside = lambda rank: (rank >= F.col("_f")) & (rank <= F.col("_l"))
    pairs = rows.groupBy(*group, "i").agg(
        F.max(F.when(inside(below), F.col(value))).alias("a"),
        F.max(F.when(inside(above), F.col(value))).alias("b"),
        F.first(F.col("pos") - F.floor("pos").cast("double")).alias("t"))
    return pairs.select(*group, F.col("i").alias("q_index"),
                        (F.col("a") + (F.col("b") - F.col("a")) * F.col("t")).alias("q_value"))


def latency_percentiles(df: DataFrame, latency: str = "latency_ms", by: Sequence[str] = ()
                        ) -> DataFrame:
    """p50, p95, p99 (linear interpolation) and mean, 3 places."""
    by = list(by)
    counts = stage_ordered(df.groupBy(*by, latency).agg(F.count(F.lit(1)).alias("n")), by, latency)
    # Micro-units keep the mean independent of summation order.
    sizes = counts.groupBy(*by).agg(
        F.sum("n").alias("size"), round_dp(
            F.sum(F.round(F.col(latency) * 1e6).cast("bigint") * F.col("n")).cast("double")
            / F.sum("n").cast("double") / F.lit(1e6), 3).alias("latency_mean_ms"))
    totals = running_totals(counts, by, latency, ["n"])
    if by:
        totals = totals.join(sizes, by)
    else:
        totals = totals.select("*", sizes.select("size").scalar().alias("size"))
    q = quantiles(totals, by, latency, "n", "size", [0.5, 0.95, 0.99])
    pick = lambda i: round_dp(F.max(F.when(F.col("q_index") == i, F.col("q_value"))), 3)
    wide = q.groupBy(*by).agg(pick(0).alias("latency_p50_ms"), pick(1).alias("latency_p95_ms"),
                              pick(2).alias("latency_p99_ms"))
    if by:
        return wide.join(sizes.drop("size"), by)
    return wide.select("*", sizes.select("latency_mean_ms").scalar().alias("latency_mean_ms"))


# Gates --------------------------------------------------------------------------------

GATE1 = {"auc_roc": 0.85, "pr_auc": 0.70, "recall_at_1_fpr": 0.60}
MAX_P99_MS = 10.0
GATE2 = {"delta_pr_auc": 0.0, "delta_auc_roc": -0.005, "delta_recall_at_1_fpr": 0.0}
MAX_P99_RISE_MS = 1.0


def _text(x: Column) -> Column:
    return x.cast("string")


def gate1_benchmark(metrics: DataFrame) -> DataFrame:
    """Absolute gate over all_metrics rows that carry latency_p99_ms."""
    names = {"auc_roc": "AUC-ROC", "pr_auc": "PR-AUC", "recall_at_1_fpr": "Recall@1% FPR"}
    fails = [F.when(F.col(m) < F.lit(low),
                    F.concat(F.lit(names[m] + " "), _text(F.col(m)), F.lit(f" < required {low}")))
             for m, low in GATE1.items()]
    fails.append(F.when(F.col("latency_p99_ms") > F.lit(MAX_P99_MS), F.concat(
        F.lit("Latency p99 "), _text(F.col("latency_p99_ms")), F.lit(f"ms > required {MAX_P99_MS}ms"))))
    return (metrics.withColumn("violations", F.array_compact(F.array(*fails)))
            .withColumn("passed", F.size("violations") == 0))


def gate2_regression(candidate: DataFrame, production: DataFrame) -> DataFrame:
    """Candidate minus production on one-row (or keyed by ``on``) metric tables."""
    cols = ["auc_roc", "pr_auc", "recall_at_1_fpr", "f1_score", "precision_at_90_recall",
            "latency_p99_ms"]
    row = candidate.select(*[F.col(c).alias(f"cand_{c}") for c in cols]).select(
        "*", *[production.select(c).scalar().alias(f"prod_{c}") for c in cols])
    delta = lambda c, places=4: round_dp(F.col(f"cand_{c}") - F.col(f"prod_{c}"), places)
    row = row.withColumns({
        "delta_auc_roc": delta("auc_roc"), "delta_pr_auc": delta("pr_auc"),
        "delta_recall_at_1_fpr": delta("recall_at_1_fpr"), "delta_f1_score": delta("f1_score"),
        "delta_latency_p99_ms": delta("latency_p99_ms", 3)})
    reason = lambda cond, text: F.when(cond, F.lit(text))
    reasons = F.array_compact(F.array(
        reason(F.col("delta_pr_auc") < GATE2["delta_pr_auc"], "PR-AUC regressed"),
        reason(F.col("delta_auc_roc") < GATE2["delta_auc_roc"], "AUC-ROC dropped"),
        reason(F.col("delta_recall_at_1_fpr") < GATE2["delta_recall_at_1_fpr"],
               "Recall@1% FPR dropped"),
        reason(F.col("cand_latency_p99_ms") > MAX_P99_MS, "p99 latency above the hard limit"),
        reason(F.col("delta_latency_p99_ms") > MAX_P99_RISE_MS, "p99 latency degraded")))
    return row.withColumn("regression_reasons", reasons).withColumn(
        "is_promotable", F.size("regression_reasons") == 0)


def promotion_verdict(gate1: DataFrame, gate2: DataFrame) -> DataFrame:
    """One row per checked metric with its status, and the overall decision."""
    both = gate2.select("*", gate1.select("passed").scalar().alias("gate1_passed"))
    status = lambda ok, bad: F.when(ok, "PASS").otherwise(bad)
    def row(gate, metric, value, reference, verdict):
        return F.struct(F.lit(gate).alias("gate"), F.lit(metric).alias("metric"),
                        value.cast("double").alias("value"), reference.cast("double").alias("reference"),
                        verdict.alias("status"))
    c = F.col
    rows = [row(1, m, c(f"cand_{m}"), F.lit(low), status(c(f"cand_{m}") >= low, "FAIL"))
            for m, low in GATE1.items()]
    rows.append(row(1, "latency_p99_ms", c("cand_latency_p99_ms"), F.lit(MAX_P99_MS),
                    status(c("cand_latency_p99_ms") <= MAX_P99_MS, "FAIL")))
    rows += [row(2, m, c(f"delta_{m}"), F.lit(GATE2[f"delta_{m}"]),
                 status(c(f"delta_{m}") >= GATE2[f"delta_{m}"], "REGRESSED"))
             for m in ("pr_auc", "auc_roc", "recall_at_1_fpr")]
    for m in ("precision_at_90_recall", "f1_score"):
        rows.append(row(2, m, round_dp(c(f"cand_{m}") - c(f"prod_{m}"), 4), F.lit(None),
                        F.lit("Informational")))
    rows.append(row(2, "latency_p99_ms", c("delta_latency_p99_ms"), F.lit(MAX_P99_RISE_MS),
                    status(c("delta_latency_p99_ms") <= MAX_P99_RISE_MS, "REGRESSED")))
    decision = F.when(c("gate1_passed") & c("is_promotable"), "APPROVED FOR PROMOTION").otherwise(
        "PROMOTION BLOCKED")
    return both.select(decision.alias("decision"), F.inline(F.array(*rows)))


# Costs --------------------------------------------------------------------------------

def financial_cost(df: DataFrame, threshold: float = 0.5, cost_fn: float = COST_FN,
                   cost_fp: float = COST_FP, by: Sequence[str] = ()) -> DataFrame:
    rows = confusion_matrix(df, threshold, by)
    total = F.col("fn") * F.lit(cost_fn) + F.col("fp") * F.lit(cost_fp)
    n = F.greatest(F.lit(1), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn"))
    return rows.select(
        *by, total.alias("total_financial_loss"), F.col("fn").alias("false_negatives"),
        F.col("fp").alias("false_positives"), F.col("tp").alias("true_positives"),
        F.col("tn").alias("true_negatives"), (total / n.cast("double")).alias("cost_per_transaction"))


def threshold_grid(steps: int = 100) -> list[float]:
    """Evenly spaced cut-offs from 0.05 to 0.95."""
    width = (HIGHEST_CUT - LOWEST_CUT) / (steps - 1)
    return [LOWEST_CUT + i * width for i in range(steps - 1)] + [HIGHEST_CUT]


def threshold_costs(df: DataFrame, steps: int = 100, cost_fn: float = COST_FN,
                    cost_fp: float = COST_FP) -> DataFrame:
    """Cost of every cut-off in one pass over the data.

    Each row is reduced to the number of cut-offs it reaches; at most steps + 1
    counts per label are shuffled, and the costs are running sums over them.
    """
    grid = threshold_grid(steps)
    width = (HIGHEST_CUT - LOWEST_CUT) / (steps - 1)
    cuts = F.array(*[F.lit(t) for t in grid])
    at = lambda i: F.element_at(cuts, (i + 1).cast("int"))
    guess = F.floor((F.col("p") - F.lit(LOWEST_CUT)) / F.lit(width)).cast("int")
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(steps - 1))
    # The division may be off by one at a cut-off; compare with the exact neighbours.
    reached = (F.when(F.col("p") < F.lit(grid[0]), 0)
               .when(F.col("p") < at(guess), guess)
               .when((guess < steps - 1) & (F.col("p") >= at(F.least(guess + 1, F.lit(steps - 1)))),
                     guess + 2)
               .otherwise(guess + 1))
    counts = (df.select("y", "p").withColumn("reached", reached).groupBy("reached").agg(
        F.sum(F.col("y").cast("bigint")).alias("pos"),
        F.sum((1 - F.col("y")).cast("bigint")).alias("neg")))
    # Cut-off i predicts fraud for rows that reach more than i cut-offs: at most 101 rows here.
    steps_hit = F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: F.struct(
        i.alias("step"), (F.col("reached") > i).alias("hit")))
    flat = counts.select("pos", "neg", F.inline(steps_hit))
    table = flat.groupBy("step").agg(
        F.sum(F.when(F.col("hit"), F.col("pos")).otherwise(0)).alias("true_positives"),
        F.sum(F.when(F.col("hit"), F.col("neg")).otherwise(0)).alias("false_positives"),
        F.sum(F.when(F.col("hit"), 0).otherwise(F.col("neg"))).alias("true_negatives"),
        F.sum(F.when(F.col("hit"), 0).otherwise(F.col("pos"))).alias("false_negatives"))
    total = F.col("false_negatives") * F.lit(cost_fn) + F.col("false_positives") * F.lit(cost_fp)
    return table.select(F.col("step").cast("bigint").alias("step"),
                        F.element_at(cuts, F.col("step") + 1).alias("cutoff"),
                        "true_positives", "false_positives", "true_negatives", "false_negatives",
                        total.alias("total_financial_loss"))


def cost_optimal_threshold(df: DataFrame, steps: int = 100) -> DataFrame:
    """The cheapest cut-off (the lowest wins ties) with its breakdown, one row."""
    costs = threshold_costs(df, steps)
    best = costs.agg(F.min_by(F.struct(*costs.columns),
                              F.struct("total_financial_loss", "step")).alias("b")).select("b.*")
    n = F.greatest(F.lit(1), F.col("true_positives") + F.col("false_positives")
                   + F.col("true_negatives") + F.col("false_negatives"))
    return best.select(
        round_dp(F.col("cutoff"), 3).alias("optimal_threshold"), "total_financial_loss",
        "false_negatives", "false_positives", "true_positives", "true_negatives",
        (F.col("total_financial_loss") / n.cast("double")).alias("cost_per_transaction"))


def class_weight(df: DataFrame, label: str = "y") -> DataFrame:
    """Negatives per positive; 1.0 without positives."""
    counts = df.agg(_count_if(F.col(label) == 1).alias("n_pos"), _count_if(F.col(label) == 0).alias("n_neg"))
    return counts.select("n_pos", "n_neg", F.when(
        F.col("n_pos") > 0, F.col("n_neg").cast("double") / F.col("n_pos").cast("double"))
        .otherwise(F.lit(1.0)).alias("scale_pos_weight"))


def head_to_head(candidate: DataFrame, production: DataFrame, on: str = "transaction_id") -> DataFrame:
    """Both models' scores on the same rows: inner join on the unique id."""
    return candidate.select(on, "y", F.col("p").alias("candidate_p")).join(
        production.select(on, F.col("p").alias("production_p")), on)
