"""Lists of linked customers: what they hold, and that their work is dealt out and done once."""

from pyspark.sql import functions as F

from riskloom.operators import entities as E

DDL = "n int, customer_id string, dev string, ip string"


def wanted_lists(rows, events):
    on = lambda k, value: {e[1] for e in events if value and e[k] == value and e[1] is not None}
    return sorted((str(r), None if r[1] is None else sorted((on(2, r[2]) | on(3, r[3])) - {r[1]})) for r in rows)


def test_rows_of_one_device_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(E, "TASK_IDS", 500, raising=False)
    monkeypatch.setattr(E, "ROW_IDS", 0, raising=False)
    events = [(i, f"c{i}", "d", f"ip{i % 7}" if i % 2 else None) for i in range(60)]
    events += [(100, "c1", "e", ""), (101, "x", "", "ip1"), (102, None, "d", "ip1"), (103, "y", None, "ip1"), (104, "z", "own", "own")]
    rows = events + events[:3] + [(105, "c1", "nowhere", "nowhere"), (106, "stranger", "d", "ip2"), (107, "z", None, None)]
    df = spark.createDataFrame(events, DDL).selectExpr(
        "customer_id", "dev AS device_fingerprint", "ip AS ip_address", "CAST(n AS BIGINT) AS us")
    made = E.with_linked_ids(spark.createDataFrame(rows, DDL), df)
    got = made.withColumn("part", F.spark_partition_id()).collect()
    assert sorted((str((r.n, r.customer_id, r.dev, r.ip)), r.linked_customer_ids) for r in got) == wanted_lists(rows, events)
    assert len({r.part for r in got if r.dev == "d"}) > 4  # they were in one task of a join, or in the 4 of the rows


def test_facts_are_made_once(spark):
    from riskloom.plans import case_queries as Q

    df = Q.flatten_context(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "inline" in plan and "size(array(" not in plan  # a filter on the facts made all of them a second time
