"""Connected components of a link table by iterative Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.staging import own_exchange, stage

#: Rounds before the loop is taken for faulty; each halves the number of trees that are still linked.
MAX_ROUNDS = 60
#: Jumps per written table: trees of a depth up to 2**JUMPS are flat after one.
JUMPS = 3


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (columns a, b); the component is its smallest id.

    Each round hooks: every tree's root takes the smallest label that a link of one of its members leads to. Then labels
    jump to the label of their label until the trees are flat. A root with very many members is a key of minima that
    combine before the shuffle and of joins that adaptive execution splits. Each round is a written table, so its plan
    stays short and lost executors repeat one round. No links: an empty table.
    """
    edges = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    labels = edges.select(F.col("b").alias("id")).union(edges.select("a")).distinct().select("id", F.col("id").alias("component"))
    for _ in range(MAX_ROUNDS):
        if not edges.take(1):
            return labels
        hooks = own_exchange(edges.groupBy("b").agg(F.min("a").alias("up")), "b").withColumnRenamed("b", "component")
        labels = labels.join(hooks, "component", "left").select("id", F.coalesce("up", "component").alias("component"))
        moved = True
        while moved:
            for k in range(JUMPS):
                # A root is the label of others; its own row says where it went.
                roots = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
                labels = labels.join(roots, "component", "left").select(
                    "id", F.coalesce("up", "component").alias("component"),
                    (F.coalesce("up", "component") != F.col("component")).alias("moved"))
                if k < JUMPS - 1:
                    labels = labels.drop("moved")
            jumped = stage(labels, "components")
            moved = bool(jumped.where("moved").take(1))
            labels = jumped.select("id", "component")
        la = labels.select(F.col("id").alias("a"), F.col("component").alias("ca"))
        lb = labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        # Between trees only: links inside a tree are done with and leave the table.
        edges = stage(edges.join(la, "a").join(lb, "b").where("ca <> cb").select(
            F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "links")
    raise RuntimeError("components did not settle")
