"""The 17 point-in-time features, one definition for batch and micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.geo import known_location, raw_haversine_km
from riskloom.functions.numeric import cents, mean_of_cents, round_dp
from riskloom.operators.trailing import MICROS, Trailing, trailing
from riskloom.operators.entities import merchant_risk
from riskloom.schemas import FEATURE_CATALOG, FEATURE_VERSION, FEATURES

MIN_SIGMA = 10.0


def with_micros(df: DataFrame) -> DataFrame:
    """Adds ``us`` (integer microseconds) and ``cents`` when absent."""
    if "us" not in df.columns:
        df = df.withColumn("us", F.unix_micros("timestamp"))
    if "cents" not in df.columns:
        df = df.withColumn("cents", cents(F.col("amount")))
    return df


def hour_of_day(ts: Column) -> Column:
    """UTC hour; the session time zone is UTC."""
    return F.hour(ts)


def is_weekend(ts: Column) -> Column:
    """Saturday or Sunday."""
    return F.weekday(ts) >= 5


def catalog_windows(entity: str) -> list[Trailing]:
    """Trailing aggregates of one entity, read off the feature catalog.

    A mean is carried as an exact sum of cents and a count, so it can be rounded
    and reused unrounded by the z-score.
    """
    specs = []
    for name, owner, seconds, aggregation, source, *_ in FEATURE_CATALOG:
        if owner != entity or aggregation not in ("count", "mean", "max", "nunique"):
            continue
        column = "cents" if source == "amount" else source
        if aggregation == "mean":
            specs.append(Trailing(f"{name}__sum", "sum", column, seconds))
            specs.append(Trailing(f"{name}__n", "count", None, seconds))
        else:
            specs.append(Trailing(name, aggregation, column, seconds))
    return specs


def first_seen_ids(df: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """Ids of the rows where (customer, ``column``) occurs for the first time.

    A minimum per pair aggregates before the shuffle, so a pair that holds much
    of the data costs one row per map task. ``known`` pairs are not new.
    """
    first = (df.groupBy("customer_id", column)
             .agg(F.min(F.struct("us", "transaction_id")).alias("_first")))
    if known is not None:
        first = first.join(known.select("customer_id", column).distinct(),
                           ["customer_id", column], "left_anti")
    return first.select(F.col("_first.transaction_id").alias("transaction_id"))


def is_first_seen(df: DataFrame, column: str, name: str, known: DataFrame | None = None
                  ) -> DataFrame:
    """Lifetime novelty per transaction; joined on the unique id, so never skewed."""
    df = with_micros(df)
    new = first_seen_ids(df, column, known).withColumn(name, F.lit(True))
    return (df.select("transaction_id").join(new, "transaction_id", "left")
            .select("transaction_id", F.coalesce(name, F.lit(False)).alias(name)))


def is_new_within(df: DataFrame, column: str, seconds: int, name: str,
                  slice_seconds: int = 86400) -> DataFrame:
    """Catalog variant: not seen for this customer in the previous ``seconds``."""
    df = with_micros(df)
    seen = trailing(df, ["customer_id", column], [Trailing("_prev", "last", "us")],
                    slice_seconds=slice_seconds, keep=["us"])
    gap = F.lit(seconds * MICROS).cast("bigint")
    return seen.select(
        "transaction_id",
        (F.col("_prev").isNull() | (F.col("us") - F.col("_prev") > gap)).alias(name))


def _with_place(df: DataFrame) -> DataFrame:
    """Location of the row as a struct, null when unknown."""
    place = F.struct(F.col("location_lat").alias("lat"), F.col("location_lng").alias("lng"),
                     F.col("us").alias("us"))
    return df.withColumn("place", F.when(
        known_location(F.col("location_lat"), F.col("location_lng")), place))


def last_known_location(df: DataFrame) -> DataFrame:
    """Last known location of the customer strictly before each transaction."""
    located = trailing(_with_place(with_micros(df)), "customer_id",
                       [Trailing("last_place", "last", "place")], keep=["place", "us"])
    return located.select(
        "transaction_id", "us", "place",
        F.col("last_place.lat").alias("last_lat"),
        F.col("last_place.lng").alias("last_lng"),
        F.col("last_place.us").alias("last_us"))


def _located(df: DataFrame) -> DataFrame:
    """last_known_location with the unrounded distance as ``km``.

    Its own projection: rounding mentions its argument several times.
    """
    return last_known_location(df).withColumn("km", raw_haversine_km(
        F.col("last_lat"), F.col("last_lng"), F.col("place.lat"), F.col("place.lng")))


def distance_from_last_txn(df: DataFrame) -> DataFrame:
    return _located(df).select("transaction_id",
                               round_dp(F.col("km"), 3).alias("distance_from_last_txn"))


def with_travel_speed(df: DataFrame, max_kmh: float = 800.0) -> DataFrame:
    """Implied speed since the last known location and the impossible-travel flag.

    Moving a positive distance in no time has no finite speed and is flagged.
    """
    rows = _located(df).select("transaction_id", round_dp(F.col("km"), 3).alias("distance_km"),
                               (F.col("us") - F.col("last_us")).alias("elapsed_us"))
    speed = F.when(F.col("elapsed_us") > 0, round_dp(
        F.col("distance_km") * F.lit(3600.0 * MICROS) / F.col("elapsed_us").cast("double"), 1))
    impossible = F.when(F.col("elapsed_us") == 0, F.col("distance_km") > 0).otherwise(
        F.coalesce(F.col("speed_kmh") > F.lit(max_kmh), F.lit(False)))
    return (rows.withColumn("speed_kmh", F.coalesce(speed, F.lit(0.0)))
            .select("transaction_id", "distance_km", "speed_kmh",
                    F.coalesce(impossible, F.lit(False)).alias("impossible_travel")))


def zscore(amount: Column, mean_1hr: Column, base_mean: Column, base_std: Column) -> Column:
    """Baseline z-score; cold start uses the 1 h mean and half of it as spread."""
    known = base_mean.isNotNull() & base_std.isNotNull()
    mu = F.when(known, base_mean).otherwise(mean_1hr)
    sigma = F.when(known, base_std).otherwise(F.greatest(F.lit(10.0), mean_1hr * F.lit(0.5)))
    return round_dp((amount - mu) / F.greatest(F.lit(MIN_SIGMA), sigma), 3)


#: A row may bring its own baseline in these columns; it counts where both are known, without floors.
EVENT_BASELINE = ("event_baseline_mean", "event_baseline_std")


def _baseline(df: DataFrame) -> tuple[Column, Column]:
    """Mean and spread: the row's own where it has both, else the registered ones."""
    if not set(EVENT_BASELINE) <= set(df.columns):
        return F.col("baseline_mean"), F.col("baseline_std")
    own = F.col(EVENT_BASELINE[0]).isNotNull() & F.col(EVENT_BASELINE[1]).isNotNull()
    return tuple(F.when(own, F.col(a)).otherwise(F.col(b)) for a, b in zip(EVENT_BASELINE, ("baseline_mean", "baseline_std")))


def amount_zscore(df: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """C7 alone. ``baselines``: customer_id, baseline_mean, baseline_std (floored); rows may bring EVENT_BASELINE."""
    df = with_micros(df)
    own = [c for c in EVENT_BASELINE if c in df.columns]
    hour = trailing(df, "customer_id", [Trailing("s", "sum", "cents", 3600),
                                        Trailing("n", "count", None, 3600)],
                    keep=["customer_id", "amount", *own])
    if baselines is not None:
        hour = hour.join(baselines, "customer_id", "left")
    else:
        hour = hour.withColumns({"baseline_mean": F.lit(None).cast("double"),
                                 "baseline_std": F.lit(None).cast("double")})
    mean_1hr = F.col("s").cast("double") / (F.col("n").cast("double") * F.lit(100.0))
    return hour.select("transaction_id", zscore(F.col("amount"), mean_1hr, *_baseline(hour)).alias("amount_zscore"))


def build_feature_vector(df: DataFrame, baselines: DataFrame | None = None,
                         profiles: DataFrame | None = None,
                         known_devices: DataFrame | None = None,
                         known_merchants: DataFrame | None = None,
                         slice_seconds: int = 3600,
                         keep: tuple[str, ...] = ()) -> DataFrame:
    """All 17 features plus ids and version, one row per transaction.

    Exchanges: narrow rows by (customer, slice), narrow rows by (device, slice),
    two pre-aggregated pair minima, and one meeting point on the unique
    transaction id. The wide input row moves once, by that id.
    """
    df = _with_place(with_micros(df))
    customer = trailing(df, "customer_id",
                        [*catalog_windows("customer_id"), Trailing("last_place", "last", "place")],
                        slice_seconds=slice_seconds)
    device = trailing(df, "device_fingerprint", catalog_windows("device_fingerprint"),
                      slice_seconds=slice_seconds)
    new_device = (first_seen_ids(df, "device_fingerprint", known_devices)
                  .withColumn("is_new_device", F.lit(True)))
    new_merchant = (first_seen_ids(df, "merchant_id", known_merchants)
                    .withColumn("is_new_merchant", F.lit(True)))
    wide = (df.join(customer, "transaction_id").join(device, "transaction_id")
            .join(new_device, "transaction_id", "left")
            .join(new_merchant, "transaction_id", "left"))
    if baselines is not None:
        wide = wide.join(baselines.select("customer_id", "baseline_mean", "baseline_std"),
                         "customer_id", "left")
    else:
        wide = wide.withColumns({"baseline_mean": F.lit(None).cast("double"),
                                 "baseline_std": F.lit(None).cast("double")})
    return finished_features(wide, profiles, keep)


def finished_features(wide: DataFrame, profiles: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 17 features from rows that carry their trailing aggregates, novelty, places and baselines."""
    wide = merchant_risk(wide, profiles).withColumn("_km", raw_haversine_km(
        F.col("last_place.lat"), F.col("last_place.lng"), F.col("place.lat"), F.col("place.lng")))
    one = F.lit(1).cast("bigint")
    total, n = F.col("avg_amount_1hr__sum"), F.col("avg_amount_1hr__n")
    mean_1hr = total.cast("double") / (n.cast("double") * F.lit(100.0))
    made = {
        "avg_amount_1hr": mean_of_cents(total, n),
        "max_amount_24hr": F.col("max_amount_24hr").cast("double") / F.lit(100.0),
        "amount_zscore": zscore(F.col("amount"), mean_1hr, *_baseline(wide)),
        "is_new_device": F.coalesce("is_new_device", F.lit(False)),
        "is_new_merchant": F.coalesce("is_new_merchant", F.lit(False)),
        "distance_from_last_txn": round_dp(F.col("_km"), 3),
        "is_international": F.coalesce("is_international", F.lit(False)),
        "hour_of_day": hour_of_day(F.col("timestamp")).cast("bigint"),
        "is_weekend": is_weekend(F.col("timestamp")),
    }
    counts = {name for name, _, _, agg, *_ in FEATURE_CATALOG if agg in ("count", "nunique")}
    columns = []
    for name in FEATURES:
        value = made.get(name, F.col(name))
        if name in counts:
            value = F.greatest(one, value)
        columns.append(value.alias(name))
    extra = [c for c in keep if c not in ("transaction_id", "customer_id", *FEATURES)]
    return wide.select("transaction_id", "customer_id", *columns,
                       F.lit(FEATURE_VERSION).alias("feature_version"), *extra)
