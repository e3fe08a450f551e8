"""Dataset building and model training on MLlib."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.hashing import shuffle_key
from riskloom.functions.numeric import round_dp
from riskloom.operators import evaluation as H
from riskloom.operators.ranking import hash_edges, hash_rank
from riskloom.operators.scoring import prepare_xy
from riskloom.schemas import FEATURES
from riskloom.session import bounded_tasks, owned_dir, stage

# Default boosting parameters and the three search candidates.
DEFAULTS = {"stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 20}
CANDIDATES = [
    {"stepSize": 0.05, "maxDepth": 6, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 20},
    {"stepSize": 0.08, "maxDepth": 7, "subsamplingRate": 0.85, "featureSubsetStrategy": "0.85", "minInstancesPerNode": 15},
    {"stepSize": 0.03, "maxDepth": 8, "subsamplingRate": 0.75, "featureSubsetStrategy": "0.75", "minInstancesPerNode": 30},
]

#: Rows that boosted fits side by side may hold together; a fit keeps its binned rows in memory, about 340 bytes each.
ROWS_SIDE_BY_SIDE = 12_000_000


def build_features(df: DataFrame) -> DataFrame:
    """Pass-through when all 17 feature columns exist, else the feature build."""
    if all(f in df.columns for f in FEATURES):
        return df
    from riskloom.operators.features import build_feature_vector
    return build_feature_vector(df, keep=("is_fraud",))


def _cut(n: Column, share: float) -> Column:
    return F.floor(n.cast("double") * F.lit(share) + F.lit(0.5)).cast("bigint")


def stratified_split(df: DataFrame, train: float = 0.70, val: float = 0.15, test: float = 0.15,
                     label: str = "is_fraud", seed: int = 42, id_col: str = "transaction_id"
                     ) -> DataFrame:
    """Adds ``split``: exact shares per label and in total.

    Cut points are rounded on the running total over the labels, so the totals are
    exact and every label is within one row of its share. Rows compare themselves with the
    row at each cut point of their label, so ``df`` is read three times and not shuffled.
    """
    if abs(train + val + test - 1.0) > 1e-8:
        raise ValueError(f"ratios must sum to 1, got {train + val + test}")
    if label not in df.columns:
        raise KeyError(f"target column {label!r} not found")
    # One row per label value.
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_m"))
    upto = Window.partitionBy(F.lit(0)).orderBy(label).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum("_m").over(upto)
    cuts = sizes.select(label, end.alias("_end"), "_m").select(
        label,
        (_cut(F.col("_end"), train) - _cut(F.col("_end") - F.col("_m"), train)).alias("_c1"),
        (_cut(F.col("_end"), train + val) - _cut(F.col("_end") - F.col("_m"), train + val)).alias("_c2"))
    edges = hash_edges(df, label, id_col, seed, cuts, ["_c1", "_c2"])
    place = F.struct(shuffle_key(F.col(id_col), seed), F.col(id_col))
    split = F.when(place <= F.col("_c1"), "train").when(place <= F.col("_c2"), "val").otherwise("test")
    return (df.where(F.col(id_col).isNotNull()).join(F.broadcast(edges), label)
            .withColumn("split", split).drop("_c1", "_c2"))


def random_split(df: DataFrame, train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: int = 42,
                 id_col: str = "id") -> DataFrame:
    """Adds ``split``: the held-out part is rounded up, then halved (test rounded up)."""
    ranked = hash_rank(df, None, id_col, seed)
    held = F.ceil(F.round(F.col("_n").cast("double") * F.lit(val + test), 6))
    tested = F.ceil(held / F.lit(2.0))
    split = (F.when(F.col("_n") < 3, F.raise_error(F.lit("at least 3 rows are needed to split")))
             .when(F.col("_rank") <= F.col("_n") - held, "train")
             .when(F.col("_rank") <= F.col("_n") - tested, "val").otherwise("test"))
    return ranked.withColumn("split", split.cast("string")).drop("_rank", "_n")


def stratified_kfold(df: DataFrame, k: int = 3, seed: int = 42, label: str = "is_fraud",
                     id_col: str = "transaction_id") -> DataFrame:
    """Adds ``fold`` 0..k-1, balanced within each label."""
    ranked = hash_rank(df, label, id_col, seed)
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int")).drop("_rank", "_n")


def merge_feedback(history: DataFrame, feedback: DataFrame) -> DataFrame:
    """History and label rows, one per transaction: feedback wins, then the latest."""
    rest = [c for c in history.columns if c != "transaction_id"]
    rows = history.withColumns({"_source": F.lit(0), "_at": F.lit(None).cast("timestamp")}).unionByName(
        feedback.withColumn("_source", F.lit(1)).withColumnRenamed("created_at", "_at"),
        allowMissingColumns=True)
    # A window carries only the columns that are used later; a much-labelled transaction stays one row per map task, as
    # Spark limits the rows of a group before the shuffle.
    newest = Window.partitionBy("transaction_id").orderBy(F.desc("_source"), F.coalesce("_at", F.timestamp_seconds(F.lit(0))).desc())
    return rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") == 1).select("transaction_id", *rest)


def train_model(train: DataFrame, val: DataFrame, params: dict | None = None, rounds: int = 150,
                weight: float | None = None, seed: int = 42):
    """Boosted trees with class weight and early stopping on the validation rows.

    ``train`` and ``val``: prepared columns (17 features and y). ``weight``
    defaults to negatives per positive of the training rows.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    if weight is None:
        weight = H.class_weight(train).head()["scale_pos_weight"]
    rows = train.withColumn("is_val", F.lit(False)).unionByName(val.withColumn("is_val", F.lit(True)))
    rows = rows.withColumn("w", F.when(F.col("y") == 1, F.lit(float(weight))).otherwise(F.lit(1.0)))
    gbt = GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", validationIndicatorCol="is_val",
                        maxIter=rounds, seed=seed, **{**DEFAULTS, **(params or {})})
    # A fit holds one partition of its binned rows per task, so these are cut by size.
    with bounded_tasks(train.sparkSession):
        return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="x"), gbt]).fit(rows)


def predict(model, rows: DataFrame, *keep: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).select(*keep, "y", vector_to_array("probability")[1].alias("p"))


def fold_scores(rows: DataFrame, k: int = 3, candidates: list[dict] | None = None, rounds: int = 80, seed: int = 42,
                parallelism: int = 3, fit=train_model) -> DataFrame:
    """candidate_idx, fold, y, p: every row scored by every candidate fitted on the other folds.

    ``parallelism`` fits run side by side, so small late rounds of one fit do not leave the cluster idle; boosted fits of
    many rows, which fill it alone, are fewer (ROWS_SIDE_BY_SIDE), so their cached rows are not evicted. Each writes its scores; no score reaches the driver. ``fit(train, held_out, params, rounds, seed=seed)`` returns an MLlib model.
    """
    from multiprocessing.pool import ThreadPool

    from pyspark.util import inheritable_thread_target

    spark = rows.sparkSession
    folded = stage(stratified_kfold(rows, k, seed, label="y"), "folds")
    path = owned_dir(spark, "fold_scores")

    def one(index: int, params: dict, fold: int):
        train, held = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
        model = fit(train, held, params, rounds, seed=seed)
        predict(model, held).write.mode("overwrite").parquet(f"{path}/candidate_idx={index}/fold={fold}")

    wrapped = inheritable_thread_target(spark)(one)
    tasks = [(index, params, fold) for index, params in enumerate(candidates or CANDIDATES) for fold in range(k)]
    if fit is train_model:
        parallelism = min(parallelism, ROWS_SIDE_BY_SIDE // max(1, folded.count()))
    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        pool.starmap(wrapped, tasks, chunksize=1)
    return spark.read.schema("y int, p double, candidate_idx int, fold int").parquet(path)


def tuning_history(scores: DataFrame) -> DataFrame:
    """candidate_idx, mean_pr_auc, mean_roc_auc over the folds of each candidate, one grouped pass over all scores."""
    by = ["candidate_idx", "fold"]
    areas = H.average_precision(scores, by).join(H.roc_auc(scores, by), by)
    mean = lambda c: round_dp(F.sum(c) / F.count(F.lit(1)), 4)
    return areas.groupBy("candidate_idx").agg(mean("pr_auc").alias("mean_pr_auc"), mean("auc_roc").alias("mean_roc_auc"))


def tune_model(rows: DataFrame, k: int = 3, candidates: list[dict] | None = None, rounds: int = 80,
               seed: int = 42, parallelism: int = 3, fit=train_model) -> list[dict]:
    """Candidate index, parameters and mean PR-AUC and ROC-AUC over k stratified folds, best PR-AUC first."""
    candidates = candidates or CANDIDATES
    # One row per candidate.
    means = tuning_history(fold_scores(rows, k, candidates, rounds, seed, parallelism, fit)).collect()
    history = [{"candidate_idx": m.candidate_idx, **candidates[m.candidate_idx], "mean_pr_auc": m.mean_pr_auc,
                "mean_roc_auc": m.mean_roc_auc} for m in means]
    return sorted(history, key=lambda h: (-h["mean_pr_auc"], h["candidate_idx"]))


def training_metadata(model, splits: DataFrame, version: str) -> DataFrame:
    """One row: sizes, class weight, chosen cut-off, test metrics and cost."""
    part = lambda name: splits.where(F.col("split") == name)
    best = stage(H.cost_optimal_threshold(predict(model, part("val"))), "cutoff")
    cut = best.head()["optimal_threshold"]
    test = stage(predict(model, part("test")), "test_scores")
    points = H.score_points(test)
    standard, optimal = (H.all_metrics(test, at, points=points).head() for at in (0.5, cut))
    cost, weight = H.financial_cost(test, cut).head(), H.class_weight(part("train")).head()
    # One row, so its parts meet here; each is computed once.
    found = {"scale_pos_weight": weight["scale_pos_weight"], "optimal_threshold": cut,
             "auc_roc": standard["auc_roc"], "pr_auc": standard["pr_auc"], "f1_score_standard_05": standard["f1_score"],
             "f1_score_optimal": optimal["f1_score"], "precision_optimal": optimal["precision"],
             "recall_optimal": optimal["recall"], "financial_loss": cost["total_financial_loss"]}
    counts = {"missed_fraud_count": cost["false_negatives"], "false_alarms_count": cost["false_positives"]}
    sizes = splits.agg(*[F.count_if(F.col("split") == s).alias(f"{s}_samples")
                         for s in ("train", "val", "test")])
    return sizes.select(F.lit(version).alias("model_version"), "*",
                        *[F.lit(v).cast("double").alias(n) for n, v in found.items()],
                        *[F.lit(v).cast("bigint").alias(n) for n, v in counts.items()])
