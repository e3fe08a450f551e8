"""All registered queries, by operator key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom.plans import case_queries, data_queries, feature_queries, governance_queries, model_queries, state_queries

MODULES = [feature_queries, governance_queries, case_queries, data_queries, state_queries, model_queries]


def queries():
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-in-time features of every transaction with its risk tier."""
    from riskloom.operators.features import build_feature_vector
    from riskloom.operators.scoring import risk_tier
    from riskloom.sources.adapter import transactions

    features = build_feature_vector(transactions(spark, sf_dir), keep=("risk_score",))
    return risk_tier(features)
