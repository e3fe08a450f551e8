"""Scorecards: a formula over the features as an MLlib pipeline, saved, loaded and applied like a fitted model."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler


def scorecard(formula: str) -> PipelineModel:
    """``formula``: SQL text over feature columns; its value, cut to [0, 1] and 0 for null, is the probability of fraud.

    It stays an expression of the plan, so scoring has no Python and no tree walk.
    """
    p = f"greatest(least(coalesce(CAST({formula} AS DOUBLE), 0.0D), 1.0D), 0.0D)"
    return PipelineModel([
        SQLTransformer(statement=f"SELECT *, 1.0D - {p} AS _legitimate, {p} AS _fraud FROM __THIS__"),
        VectorAssembler(inputCols=["_legitimate", "_fraud"], outputCol="probability")])
