"""Distribution drift between a reference and a current table, all features in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.functions.numeric import clip, round_dp
from riskloom.operators.evaluation import quantiles
from riskloom.operators.ranking import running_totals, stage_ordered
from riskloom.schemas import FEATURES

WARN, ALERT, BINS, EPS, MIN_ROWS = 0.10, 0.25, 10, 1e-4, 5


def monitored_features(reference: DataFrame, current: DataFrame) -> list[str]:
    """Common model features in contract order, then other common numeric columns."""
    common = [f for f in FEATURES if f in current.columns and f in reference.columns]
    extra = [f.name for f in current.schema.fields
             if f.name in reference.columns and f.name not in common
             and isinstance(f.dataType, T.NumericType)]
    return common + extra


def value_histogram(reference: DataFrame, current: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, ref_n, cur_n): distinct values with counts, staged in order.

    The only pass over both tables. Equal values combine before the shuffle, and a
    feature with very many distinct values is cut into many ranges. Nulls and NaN
    are dropped. The rows of that pass, one per cell, name the feature by its number.
    """
    def side(df: DataFrame, ref: int) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f).cast("double").alias("value"))
                          for i, f in enumerate(features, 1)])
        return df.select(F.inline(cells)).select(
            "_i", "value", F.lit(ref).cast("bigint").alias("r"),
            F.lit(1 - ref).cast("bigint").alias("c"))

    cells = side(reference, 1).unionByName(side(current, 0))
    hist = (cells.where(F.col("value").isNotNull() & ~F.isnan("value"))
            .groupBy("_i", "value").agg(F.sum("r").alias("ref_n"), F.sum("c").alias("cur_n"))
            .select(F.element_at(F.array(*map(F.lit, features)), F.col("_i")).alias("feature"), "value", "ref_n", "cur_n"))
    return stage_ordered(hist, ["feature"], "value")


def _sizes(hist: DataFrame) -> DataFrame:
    """Rows per feature and side; features too small on a side are left out."""
    return (hist.groupBy("feature").agg(F.sum("ref_n").alias("ref_size"),
                                        F.sum("cur_n").alias("cur_size"))
            .where((F.col("ref_size") >= MIN_ROWS) & (F.col("cur_size") >= MIN_ROWS)))


def _psi(hist: DataFrame, sizes: DataFrame, bins: int = BINS) -> DataFrame:
    totals = running_totals(hist, ["feature"], "value", ["ref_n"]).join(sizes, "feature")
    cuts = quantiles(totals, ["feature"], "value", "ref_n", "ref_size",
                     [i / bins for i in range(bins + 1)])
    # bins + 1 values per feature: a constant-size array
    edges = cuts.groupBy("feature").agg(F.array_sort(F.collect_set("q_value")).alias("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    per_feature = sizes.join(edges, "feature").select(
        "feature", "ref_size", "cur_size", inner.alias("inner"),
        (F.size("edges") - 1).alias("n_bins"))
    binned = hist.join(per_feature, "feature").withColumn(
        "bin", F.size(F.filter("inner", lambda e: e <= F.col("value"))))
    counts = binned.groupBy("feature", "bin").agg(
        F.sum("ref_n").alias("r"), F.sum("cur_n").alias("c"))
    # Bins without rows on either side still carry the smoothing mass.
    grid = per_feature.where("n_bins >= 1").select(
        "feature", "ref_size", "cur_size", "n_bins",
        F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin"))
    full = grid.join(counts, ["feature", "bin"], "left")
    share = lambda n, size: ((F.coalesce(F.col(n), F.lit(0)).cast("double") + F.lit(EPS))
                             / (F.col(size).cast("double") + F.lit(EPS) * F.col("n_bins").cast("double")))
    ref, cur = share("r", "ref_size"), share("c", "cur_size")
    psi = full.groupBy("feature").agg(F.sum((cur - ref) * F.log(cur / ref)).alias("psi"))
    return sizes.join(psi, "feature", "left").select(
        "feature", clip(F.coalesce("psi", F.lit(0.0)), 0.0, 10.0).alias("psi"))


def _wasserstein(hist: DataFrame, sizes: DataFrame) -> DataFrame:
    cum = running_totals(hist, ["feature"], "value", ["ref_n", "cur_n"], with_next=True)
    gap = F.col("next_value") - F.col("value")
    apart = F.abs(F.col("cum_ref_n").cast("double") / F.col("ref_size").cast("double")
                  - F.col("cum_cur_n").cast("double") / F.col("cur_size").cast("double"))
    return (cum.join(sizes, "feature").groupBy("feature")
            .agg(F.coalesce(F.sum(gap * apart), F.lit(0.0)).alias("wasserstein_dist")))


def psi(reference: DataFrame, current: DataFrame, features: Sequence[str] | None = None,
        bins: int = BINS) -> DataFrame:
    """Population stability index per feature over reference quantile bins."""
    hist = value_histogram(reference, current, features or monitored_features(reference, current))
    return _psi(hist, _sizes(hist), bins).select("feature", round_dp(F.col("psi"), 4).alias("psi"))


def wasserstein(reference: DataFrame, current: DataFrame, features: Sequence[str] | None = None
                ) -> DataFrame:
    """Exact one-dimensional earth mover's distance per feature."""
    hist = value_histogram(reference, current, features or monitored_features(reference, current))
    return _wasserstein(hist, _sizes(hist)).select(
        "feature", round_dp(F.col("wasserstein_dist"), 4).alias("wasserstein_dist"))


def drift_severity(psi_value: Column, warn: float = WARN, alert: float = ALERT) -> Column:
    return (F.when(psi_value >= F.lit(alert), "SEVERE")
            .when(psi_value >= F.lit(warn), "MODERATE").otherwise("NONE"))


def drift_report(reference: DataFrame, current: DataFrame, features: Sequence[str] | None = None,
                 warn: float = WARN, alert: float = ALERT) -> tuple[DataFrame, DataFrame]:
    """(per-feature rows, one summary row). Severity uses the unrounded index."""
    features = list(features or monitored_features(reference, current))
    hist = value_histogram(reference, current, features)
    sizes = _sizes(hist)
    full = _psi(hist, sizes).join(_wasserstein(hist, sizes), "feature")
    rows = full.select(
        "feature", F.col("psi").alias("_psi"), round_dp(F.col("psi"), 4).alias("psi"),
        round_dp(F.col("wasserstein_dist"), 4).alias("wasserstein_dist"),
        (F.col("psi") >= F.lit(warn)).alias("is_drifted"),
        drift_severity(F.col("psi"), warn, alert).alias("severity"))
    summary = rows.agg(
        F.coalesce(F.avg("_psi"), F.lit(0.0)).alias("m"),
        F.coalesce(F.max(F.col("is_drifted").cast("int")), F.lit(0)).alias("any"),
        # at most one entry per monitored feature
        F.array_sort(F.collect_list(F.when(F.col("is_drifted"), F.col("feature"))))
        .alias("drifted_features"),
    ).select(((F.col("any") == 1) | (F.col("m") >= F.lit(warn))).alias("overall_drift_detected"),
             round_dp(F.col("m"), 4).alias("mean_psi"),
             F.lit(len(features)).cast("bigint").alias("features_monitored"), "drifted_features")
    return rows.drop("_psi"), summary


def drift_snapshot(rows: DataFrame, summary: DataFrame, model_name: str,
                   snapshot_type: str = "feature_drift") -> DataFrame:
    """The report as one append-only record with JSON details."""
    details = rows.agg(F.array_sort(F.collect_list(F.struct(
        "feature", "psi", "wasserstein_dist", "severity"))).alias("d"))
    return summary.select(
        F.lit(model_name).alias("model_name"), F.lit(snapshot_type).alias("snapshot_type"),
        F.col("overall_drift_detected").alias("drift_detected"), F.col("mean_psi").alias("drift_score"),
        F.to_json(details.scalar()).alias("details"))


def append_drift(rows: DataFrame, summary: DataFrame, path: str, model_name: str) -> None:
    drift_snapshot(rows, summary, model_name).write.mode("append").parquet(path)
