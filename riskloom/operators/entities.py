"""Entity lookups, empirical profiles and the identity graph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numeric import round_dp
from riskloom.operators.trailing import Trailing, trailing
from riskloom.schemas import CATEGORY_RISK, UNKNOWN_CATEGORY_RISK
from riskloom.session import stage


def category_risk(category: Column) -> Column:
    """(avg_amount, fraud_rate) of a category, null when unlisted; a 10-entry constant map."""
    entries = []
    for name, (avg_amount, fraud_rate) in CATEGORY_RISK.items():
        entries += [F.lit(name), F.struct(F.lit(avg_amount).alias("avg_amount"),
                                          F.lit(fraud_rate).alias("fraud_rate"))]
    return F.element_at(F.create_map(*entries), category)


def merchant_risk(df: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Adds merchant_avg_amount and merchant_fraud_rate.

    Chain: registered profile, else category table, else the unknown default.
    ``profiles`` (merchant_id, profile_avg_amount, profile_fraud_rate) is joined
    without a hint: Spark broadcasts it only below its size threshold, and a hot
    merchant in a shuffle join is split by the adaptive skew rule.
    """
    if profiles is not None:
        df = df.join(profiles.select("merchant_id", "profile_avg_amount", "profile_fraud_rate"),
                     "merchant_id", "left")
        first = (F.col("profile_avg_amount"), F.col("profile_fraud_rate"))
    else:
        first = (F.lit(None).cast("double"), F.lit(None).cast("double"))
    risk = category_risk(F.col("merchant_category"))
    avg_amount = F.coalesce(first[0], risk["avg_amount"], F.lit(UNKNOWN_CATEGORY_RISK[0]))
    fraud_rate = F.coalesce(first[1], risk["fraud_rate"], F.lit(UNKNOWN_CATEGORY_RISK[1]))
    out = df.withColumns({"merchant_avg_amount": round_dp(avg_amount, 2),
                          "merchant_fraud_rate": round_dp(fraud_rate, 4)})
    return out.drop("profile_avg_amount", "profile_fraud_rate") if profiles is not None else out


def register_baselines(baselines: DataFrame) -> DataFrame:
    """Floors applied when a baseline is registered: mean at 10, spread at 5."""
    return baselines.select(
        "customer_id",
        F.greatest(F.lit(10.0), F.col("mean_amount")).alias("baseline_mean"),
        F.greatest(F.lit(5.0), F.col("std_amount")).alias("baseline_std"))


def customer_baselines(df: DataFrame) -> DataFrame:
    """Mean and population spread of each customer's amounts, from exact sums of cents."""
    wide = F.col("cents").cast("decimal(38,0)")
    sums = df.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("s"),
        F.sum(wide * wide).alias("ss"))
    n = F.col("n").cast("double")
    spread = (F.col("n").cast("decimal(38,0)") * F.col("ss").cast("decimal(38,0)")
              - F.col("s").cast("decimal(38,0)") * F.col("s").cast("decimal(38,0)"))
    return sums.select(
        "customer_id", F.col("n").alias("n_txns"),
        round_dp(F.col("s").cast("double") / n / F.lit(100.0), 4).alias("mean_amount"),
        round_dp(F.sqrt(spread.cast("double")) / n / F.lit(100.0), 4).alias("std_amount"))


def customer_profiles(df: DataFrame, home: str) -> DataFrame:
    """Profile of each customer for case contexts: spend, home (``home`` of the earliest row) and months since that row."""
    age = F.floor((F.max("us") - F.min("us")) / F.lit(30 * 86_400 * 1_000_000)).cast("int")
    known = df.groupBy("customer_id").agg(
        F.min_by(home, F.struct("us", "transaction_id")).alias("home_city"), age.alias("account_age_months"))
    spend = customer_baselines(df)
    return known.join(spend, "customer_id").select(
        "customer_id", F.col("mean_amount").alias("avg_amount"), "std_amount", "home_city", "account_age_months")


def with_baseline(df: DataFrame, baselines: DataFrame) -> DataFrame:
    """Left lookup of floored baselines; unknown customers keep nulls."""
    return df.join(register_baselines(baselines), "customer_id", "left")


def merchant_profiles(df: DataFrame) -> DataFrame:
    """Empirical mean amount and fraud ratio per merchant."""
    sums = df.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("s"),
        F.sum(F.col("is_fraud").cast("bigint")).alias("f"))
    n = F.col("n").cast("double")
    return sums.select(
        "merchant_id", F.col("n").alias("n_txns"),
        round_dp(F.col("s").cast("double") / n / F.lit(100.0), 2).alias("profile_avg_amount"),
        round_dp(F.col("f").cast("double") / n, 4).alias("profile_fraud_rate"))


def merchant_profiles_as_of(df: DataFrame, seconds: int = 86400) -> DataFrame:
    """Profile known just before each transaction: trailing mean, lifetime fraud ratio.

    The row itself is excluded; null when the merchant has no earlier rows.
    """
    df = df.withColumns({"one": F.lit(1).cast("bigint"),
                         "fraud": F.col("is_fraud").cast("bigint")})
    seen = trailing(df, "merchant_id", [
        Trailing("n", "count", None, seconds), Trailing("s", "sum", "cents", seconds),
        Trailing("life_n", "running_sum", "one"), Trailing("life_f", "running_sum", "fraud"),
    ], keep=["cents", "fraud"])
    n, s = F.col("n") - 1, F.col("s") - F.col("cents")
    life_n, life_f = F.col("life_n") - 1, F.col("life_f") - F.col("fraud")
    return seen.select(
        "transaction_id",
        F.when(n > 0, round_dp(s.cast("double") / n.cast("double") / F.lit(100.0), 2))
        .alias("merchant_avg_before"),
        F.when(life_n > 0, round_dp(life_f.cast("double") / life_n.cast("double"), 4))
        .alias("merchant_fraud_before"))


def has_ip(ip: Column) -> Column:
    return ip.isNotNull() & (ip != "")


def identity_edges(df: DataFrame) -> DataFrame:
    """Distinct customer-device and customer-IP edges with the first time seen.

    One pass: both identifiers of a row are laid out as edges, then aggregated
    with partial aggregation before the shuffle. Null or empty IPs give no edge.
    """
    edge = lambda kind, col: F.struct(F.lit(kind).alias("kind"), F.col(col).alias("value"))
    laid_out = df.select(
        "customer_id", "us",
        F.inline(F.array(edge("device", "device_fingerprint"), edge("ip", "ip_address"))))
    return (laid_out.where(has_ip(F.col("value")))
            .groupBy("kind", "value", "customer_id").agg(F.min("us").alias("first_seen_us")))


def _identities(df: DataFrame) -> DataFrame:
    return df.select("transaction_id", "customer_id", "us", F.col("device_fingerprint").alias("dev"),
                     F.when(has_ip(F.col("ip_address")), F.col("ip_address")).alias("ip"))


def _identity_rows(df: DataFrame) -> DataFrame:
    """The identifiers of every event, written once: the only reading of ``df`` that the link counts need."""
    return stage(_identities(df), "identities")


def _sized_edges(rows: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(kind, value, customer_id, first, degree): distinct edges with their first sighting and the value's customers.

    With ``wanted`` rows only the edges of their values, without first sightings.

    Written once; edges are few beside the events, and every branch below reads them instead of the events.
    """
    edge = lambda kind, col: F.struct(F.lit(kind).alias("kind"), F.col(col).alias("value"))
    laid_out = lambda own, *more: own.select(*more, F.inline(F.array(edge("device", "dev"), edge("ip", "ip")))).where(
        has_ip(F.col("value")))
    if wanted is None:
        edges = (laid_out(rows, "customer_id", "us", "transaction_id").groupBy("kind", "value", "customer_id")
                 .agg(F.min(F.struct("us", "transaction_id")).alias("first")))
    else:
        edges = (laid_out(rows, "customer_id").distinct().join(laid_out(wanted).distinct(), ["kind", "value"], "left_semi")
                 .withColumn("first", F.lit(None).cast("struct<us:bigint,transaction_id:string>")))
    edges = stage(edges, "edges")
    degrees = edges.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("degree"))
    return stage(edges.join(degrees, ["kind", "value"]), "sized_edges")


def _side(edges: DataFrame, kind: str, name: str) -> DataFrame:
    """One side's edges: the value, customer_id, first sighting and degree under names of that side."""
    return edges.where(F.col("kind") == kind).select(
        F.col("value").alias(name), "customer_id", F.col("first").alias(f"first_{name}"), F.col("degree").alias(f"n_{name}"))


def _pair_members(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(dev, ip, customer_id, first_dev, first_ip): customers tied to both sides of each given pair.

    For each pair the side with fewer customers is expanded and probed against
    the other side's edges, so a heavily shared IP is never expanded for a
    device that few customers use. No customer pairs are formed.
    """
    dev, ip = _side(edges, "device", "dev"), _side(edges, "ip", "ip")
    size = lambda side, name: side.groupBy(name).agg(F.max(f"n_{name}").alias(f"n_{name}"))
    sized = stage(pairs.join(size(dev, "dev"), "dev").join(size(ip, "ip"), "ip"), "pairs")
    by_device = (sized.where(F.col("n_dev") <= F.col("n_ip")).select("dev", "ip").join(dev.drop("n_dev"), "dev")
                 .join(ip.drop("n_ip"), ["ip", "customer_id"]))
    by_ip = (sized.where(F.col("n_dev") > F.col("n_ip")).select("dev", "ip").join(ip.drop("n_ip"), "ip")
             .join(dev.drop("n_dev"), ["dev", "customer_id"]))
    columns = ("dev", "ip", "customer_id", "first_dev", "first_ip")
    return by_device.select(*columns).unionByName(by_ip.select(*columns))


def linked_counts(df: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Other customers that ever shared the event's device or IP, per (``wanted``) transaction.

    |A or B| = |A| + |B| - |A and B|, less the customer itself, from edge
    degrees: no list of customers is built, whatever the sharing degree.
    """
    events = _identity_rows(df if wanted is None else wanted)
    edges = _sized_edges(events) if wanted is None else _sized_edges(_identities(df), events)
    combos = stage(events.select("dev", "ip").distinct(), "combos")
    overlap = (_pair_members(combos.where(F.col("ip").isNotNull()), edges)
               .groupBy("dev", "ip").agg(F.count(F.lit(1)).alias("both")))
    side = lambda kind, name: _side(edges, kind, name).groupBy(name).agg(F.max(f"n_{name}").alias(f"n_{name}"))
    zero = F.lit(0).cast("bigint")
    counts = (combos.join(side("device", "dev"), "dev", "left")
              .join(side("ip", "ip"), "ip", "left").join(overlap, ["dev", "ip"], "left")
              .select(F.col("dev").alias("c_dev"), F.col("ip").alias("c_ip"),
                      F.greatest(F.coalesce("n_dev", zero) + F.coalesce("n_ip", zero)
                                 - F.coalesce("both", zero) - F.lit(1), zero).alias("linked_count")))
    match = F.col("dev").eqNullSafe(F.col("c_dev")) & F.col("ip").eqNullSafe(F.col("c_ip"))
    return events.join(counts, match, "left").select("transaction_id", "linked_count")


def linked_accounts(df: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Sorted list and count of linked customers for the ``wanted`` transactions.

    The list is the result itself, one per row. Member lists are built once per
    shared device or IP that a wanted row uses (distinct edges, partial
    aggregation), not per transaction and never as customer pairs. For counts on
    all rows use :func:`linked_counts`.
    """
    rows = df if wanted is None else wanted
    rows = rows.select("transaction_id", "customer_id",
                       F.col("device_fingerprint").alias("dev"),
                       F.when(has_ip(F.col("ip_address")), F.col("ip_address")).alias("ip"))
    return with_linked_ids(rows, df).select("transaction_id", "customer_id", "linked_customer_ids",
                                            F.size("linked_customer_ids").cast("bigint").alias("linked_count"))


#: Ids that a task puts into the lists of its rows; a row counts as ``ROW_IDS`` besides.
TASK_IDS, ROW_IDS = 1_000_000, 100


def _members(rows: DataFrame, df: DataFrame) -> DataFrame:
    """(kind, value, ids, n, ids_made, groups): the sorted customers of every device and IP that ``rows`` use, written once.

    ``ids_made`` is what all rows of the value put into lists; they are dealt to ``groups`` of about ``TASK_IDS``.
    """
    side = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("value"))
    used = (rows.select(F.inline(F.array(side("device", "dev"), side("ip", "ip")))).where("value is not null")
            .groupBy("kind", "value").agg(F.count(F.lit(1)).alias("uses")))
    lists = (identity_edges(df).join(used, ["kind", "value"]).groupBy("kind", "value", "uses")
             .agg(F.sort_array(F.collect_set("customer_id")).alias("ids")))
    n = F.size("ids").cast("bigint")
    made = F.col("uses") * (n + ROW_IDS)
    groups = F.least(F.col("uses"), F.ceil(made / F.lit(TASK_IDS))).cast("int")
    return stage(lists.select("kind", "value", "ids", n.alias("n"), made.alias("ids_made"), groups.alias("groups")), "members")


def with_linked_ids(rows: DataFrame, df: DataFrame) -> DataFrame:
    """Adds linked_customer_ids to rows of customer_id, dev and ip: the customers of ``df`` on either, sorted, without the own.

    Lists are sorted once per device or IP. A row takes the shorter of its two lists along and meets the longer one last;
    there the rows of a value are dealt by groups to tasks of bounded output, so a long list moves once per group and not per row.
    """
    members = _members(rows, df)
    parts = math.ceil((members.agg(F.sum("ids_made")).head()[0] or 1) / TASK_IDS)
    size = lambda kind, name: members.where(F.col("kind") == kind).select(
        F.col("value").alias(name), F.col("n").alias(f"n_{name}"), F.col("groups").alias(f"g_{name}"))
    zero, empty = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    by_ip = F.coalesce("n_ip", zero) >= F.coalesce("n_dev", zero)
    pick = lambda device, ip, ip_first: F.when(by_ip == ip_first, ip).otherwise(device)
    dealt = F.pmod(F.xxhash64(*rows.columns), F.coalesce(pick(F.col("g_dev"), F.col("g_ip"), True), F.lit(1)))
    sized = (rows.join(size("device", "dev"), "dev", "left").join(size("ip", "ip"), "ip", "left").select(
        *rows.columns, dealt.cast("int").alias("group"), *[
            pick(device, ip, first).alias(f"{name}_{part}") for name, first in (("long", True), ("short", False))
            for part, device, ip in (("kind", F.lit("device"), F.lit("ip")), ("value", F.col("dev"), F.col("ip")))]))
    short = members.select(F.col("kind").alias("short_kind"), F.col("value").alias("short_value"), F.col("ids").alias("short_ids"))
    along = sized.join(short, ["short_kind", "short_value"], "left").withColumn(
        "short_ids", F.array_remove(F.coalesce("short_ids", empty), F.col("customer_id")))
    keys = ["long_kind", "long_value", "group"]
    long = members.select(F.col("kind").alias("long_kind"), F.col("value").alias("long_value"), "ids",
                          F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    joined = along.repartition(parts, *keys).join(long.repartition(parts, *keys), keys, "left")
    ids = F.coalesce("ids", empty)
    whole = F.when(F.size("short_ids") == 0, ids).otherwise(F.sort_array(F.array_union(ids, "short_ids")))
    return joined.select(*rows.columns, F.array_remove(whole, F.col("customer_id")).alias("linked_customer_ids"))


def linked_counts_as_of(df: DataFrame, slice_seconds: int = 3600) -> DataFrame:
    """Linked customers as known at each event: edges first seen no later than it.

    Every first sighting is a marker on the shared entity's timeline; the count
    at an event is the running number of markers on its device, plus its IP,
    minus those customers already on both, minus itself.
    """
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    rows = _identity_rows(df)
    edges = _sized_edges(rows)

    def running(col: str, kind: str) -> DataFrame:
        marks = _side(edges, kind, col).select(F.col(f"first_{col}.transaction_id").alias("transaction_id"), one.alias("mark"))
        seen = rows.where(F.col(col).isNotNull()).join(marks, "transaction_id", "left")
        return trailing(seen.withColumn("mark", F.coalesce("mark", zero)), col,
                        [Trailing(f"n_{col}", "running_sum", "mark")],
                        slice_seconds=slice_seconds)

    # A customer is on both sides of (dev, ip) from the later of its two first sightings.
    pairs = rows.where(F.col("ip").isNotNull()).select("dev", "ip").distinct()
    both = _pair_members(pairs, edges).select(
        "dev", "ip", F.greatest("first_dev", "first_ip").alias("at"), "customer_id")
    # Markers sort just before the event that completes the pair (same us and id).
    markers = both.select("dev", "ip", F.col("at.us").alias("us"),
                          F.struct(F.col("at.transaction_id").alias("t"), zero.alias("o"),
                                   F.col("customer_id").alias("c")).alias("pos"),
                          one.alias("mark"))
    probes = rows.where(F.col("ip").isNotNull()).select(
        "dev", "ip", "us",
        F.struct(F.col("transaction_id").alias("t"), one.alias("o"),
                 F.col("customer_id").alias("c")).alias("pos"), zero.alias("mark"))
    overlap = (trailing(markers.unionByName(probes), ["dev", "ip"],
                        [Trailing("n_both", "running_sum", "mark")],
                        slice_seconds=slice_seconds, id_col="pos")
               .where(F.col("pos.o") == 1)
               .select(F.col("pos.t").alias("transaction_id"), "n_both"))
    return (rows.select("transaction_id")
            .join(running("dev", "device"), "transaction_id", "left")
            .join(running("ip", "ip"), "transaction_id", "left")
            .join(overlap, "transaction_id", "left")
            .select("transaction_id",
                    (F.coalesce("n_dev", zero) + F.coalesce("n_ip", zero)
                     - F.coalesce("n_both", zero) - one).alias("linked_count")))
