"""Case bundles without and with the lists of linked customers."""

from pyspark.sql import functions as F

from riskloom.operators import cases as CS
from riskloom.operators import entities as E
from riskloom.operators import narrative as N
from riskloom.operators.features import build_feature_vector
from riskloom.operators.scoring import risk_tier
from riskloom.plans import case_queries as Q
from riskloom.sources.adapter import transactions

SF = "/root/testdata/sf0.01"


def flagged(spark):
    t = transactions(spark, SF)
    return t, risk_tier(t).where("was_flagged")


def test_stored_bundles_hold_counts_and_whole_ones_lists(spark):
    stored = Q.contexts(spark, SF)
    assert "linked_customer_ids" not in stored.select("context.linked_accounts_graph.*").columns
    t, some = flagged(spark)
    whole = CS.case_context(some, build_feature_vector(t), E.linked_accounts(t, some))
    key = lambda df: sorted(map(str, df.select("transaction_id", F.to_json("context").alias("c")).collect()))
    assert key(Q.whole_contexts(spark, SF)) == key(whole)


def test_counts_of_wanted_rows_without_device_or_address(spark):
    rows = spark.createDataFrame(
        [("t1", "a", 1, "d", ""), ("t2", "b", 2, "d", "i"), ("t3", "c", 3, None, "i"), ("t4", "c", 4, None, None), ("t5", "e", 5, "x", "i")],
        "transaction_id string, customer_id string, us bigint, device_fingerprint string, ip_address string")
    wanted = rows.where("transaction_id <> 't5'")
    lists = {r.transaction_id: r.linked_count for r in E.linked_accounts(rows, wanted).collect()}
    counts = {r.transaction_id: r.linked_count for r in E.linked_counts(rows, wanted).collect()}
    assert counts == lists == {"t1": 1, "t2": 3, "t3": 2, "t4": 0}


def test_a_narrative_that_cites_linked_customers_is_checked_against_the_list(spark):
    t, _ = flagged(spark)
    linked = F.col("context.linked_accounts_graph.shared_device_or_ip_count") > 0
    some = Q.whole_contexts(spark, SF).where(linked).select(
        F.col("transaction_id").alias("case_id"), "context",
        F.concat(F.lit("[Citing: linked_customer_ids="), F.col("context.linked_accounts_graph.linked_customer_ids")[0],
                 F.lit(", customer_ids=nobody, amount="), F.col("context.transaction_info.amount").cast("string"), F.lit("]")).alias("narrative"))
    light = some.withColumn("context", F.col("context").withField("linked_accounts_graph", F.struct("context.linked_accounts_graph.shared_device_or_ip_count")))
    light = light.withColumn("cites_list", N.cites(F.col("narrative"), "linked_accounts_graph.linked_customer_ids"))
    key = lambda df: sorted(map(str, df.select("case_id", "verified", "ungrounded", "grounding_score").collect()))
    got = Q._checked(spark, SF, light, lambda c: N.grounding(c).drop("context"))
    assert key(got) == key(N.grounding(some)) and len(key(got)) > 0
    assert light.where("NOT cites_list").isEmpty()
    assert not spark.range(1).select(N.cites(F.lit("[Citing: amount=3, merchant]"), "linked_accounts_graph.linked_customer_ids").alias("x")).head().x
