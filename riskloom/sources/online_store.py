"""The online store: one live row per transaction, hashed into buckets, merged per publication, looked up by key.

A publication reads and rewrites only the buckets that its rows fall into: the newest publication of a transaction
stays, expired rows go. Every rewritten bucket is a new folder, and a commit record maps each bucket to its newest folder,
so readers see a publication as a whole or not at all, and a repeated publication replaces its own folders. A lookup
reads the buckets of its ids alone, and few ids reach the files as a filter that row groups' Bloom filters answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.scoring import online_values
from riskloom.sources.commits import commit, committed, record

BUCKETS = 64
#: Ids that a lookup hands to the files as a list; more are joined.
LISTED_IDS = 1000
STORE_DDL = "transaction_id string, fields map<string,string>, expires_at timestamp"


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("transaction_id"), F.lit(buckets)).cast("int")


def _folders(spark: SparkSession, root: str) -> tuple[dict[int, int], int | None]:
    """The version of each bucket that has rows, and their number; as many entries as buckets."""
    versions = committed(spark, root)
    if not versions:
        return {}, None
    rows = record(spark, root, versions[-1]).collect()
    return {r.bucket: r.version for r in rows if r.version is not None}, rows[0].buckets


def _read_buckets(spark: SparkSession, root: str, folders: dict[int, int]) -> DataFrame:
    paths = [f"{root}/data/version={version}/bucket={bucket}" for bucket, version in sorted(folders.items())]
    reader = spark.read.schema(STORE_DDL)
    return reader.parquet(*paths) if paths else spark.createDataFrame([], STORE_DDL)


def merge_online(rows: DataFrame, root: str, version: int, now: Column, buckets: int = BUCKETS) -> DataFrame:
    """Writes the merged buckets of a publication and returns the record that makes it visible when committed.

    ``rows``: transaction_id, fields, expires_at. A row replaces the stored one of its transaction unless that expires
    later; of equal expiry the greater fields stay. Rows of touched buckets that have expired at ``now`` are dropped;
    untouched buckets keep theirs until they are touched, and no lookup returns them.
    """
    spark = rows.sparkSession
    folders, stored_buckets = _folders(spark, root)
    buckets = stored_buckets or buckets
    rows = rows.select("transaction_id", "fields", "expires_at").withColumn("bucket", bucket_of(buckets))
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most one row per bucket
    old = _read_buckets(spark, root, {b: v for b, v in folders.items() if b in touched}).withColumn("bucket", bucket_of(buckets))
    # Rows of a transaction meet by one exchange; nothing is sorted before it, and the sort behind it serves the files too.
    both = old.unionByName(rows).where(F.col("expires_at") > now).repartition("bucket")
    newest = F.max_by(F.struct("fields", "expires_at"), F.struct("expires_at", F.to_json("fields"))).alias("row")
    merged = both.groupBy("bucket", "transaction_id").agg(newest).select("bucket", "transaction_id", "row.*")
    (merged.sortWithinPartitions("bucket", "transaction_id").write.mode("overwrite").partitionBy("bucket")
     .option("parquet.bloom.filter.enabled#transaction_id", "true").parquet(f"{root}/data/version={version}"))
    # A bucket may be empty now: only those with a folder are named.
    filled = {r.bucket for r in spark.read.schema(STORE_DDL + ", bucket int").parquet(f"{root}/data/version={version}")
              .select("bucket").distinct().collect()}
    kept = {b: v for b, v in folders.items() if b not in touched} | {b: version for b in filled}
    return spark.createDataFrame([(b, kept.get(b), buckets) for b in range(buckets)], "bucket int, version bigint, buckets int")


def publish(rows: DataFrame, root: str, version: int, now: Column, buckets: int = BUCKETS) -> None:
    """Upserts a publication; versions must grow, and a committed one is not written again."""
    versions = committed(rows.sparkSession, root)
    if version in versions:
        return
    if versions and version < versions[-1]:
        raise ValueError(f"publication {version} comes after {versions[-1]}")
    commit(merge_online(rows, root, version, now, buckets), root, version)


def read_live(spark: SparkSession, root: str, now: Column) -> DataFrame:
    """All rows that have not expired."""
    return _read_buckets(spark, root, _folders(spark, root)[0]).where(F.col("expires_at") > now)


def lookup(ids: DataFrame, root: str, now: Column) -> DataFrame:
    """The features of the wanted ids (transaction_id) with per-field defaults; ``found`` is false where none is live.

    Only the buckets of the ids are read. Up to LISTED_IDS rows of ids are also a filter on the files; more are joined.
    """
    spark = ids.sparkSession
    folders, buckets = _folders(spark, root)
    ids = ids.select("transaction_id")
    if buckets is None:
        live = spark.createDataFrame([], STORE_DDL)
    else:
        few = [r.transaction_id for r in ids.take(LISTED_IDS + 1)]  # with repetitions: telling them apart would move all ids
        wanted = ids if len(few) > LISTED_IDS else spark.createDataFrame([(i,) for i in few], "transaction_id string")
        touched = {r.bucket for r in wanted.select(bucket_of(buckets).alias("bucket")).distinct().collect()}
        live = _read_buckets(spark, root, {b: v for b, v in folders.items() if b in touched}).where(F.col("expires_at") > now)
        if len(few) <= LISTED_IDS:
            live = live.where(F.col("transaction_id").isin(sorted({i for i in few if i is not None})))
    # Typed values are joined, not maps of text.
    typed = online_values(live.where(F.col("fields").isNotNull()))
    return ids.join(typed, "transaction_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
