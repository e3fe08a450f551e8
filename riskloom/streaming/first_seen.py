"""Pairs (customer, value) seen so far, in hash buckets of the customer, for novelty in a stream.

A batch adds its new pairs as one folder per bucket that it touches, and a commit record lists the folders of every
bucket. A bucket with ``FOLDERS`` folders is merged into one when it is next touched, so a pair is rewritten rarely and a
reader opens few files. Files are sorted by customer and carry Bloom filters: a batch reads the buckets of its
customers alone, and where these are few, the row groups that may hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import stage
from riskloom.sources.commits import commit, committed, record

BUCKETS, FOLDERS = 64, 8
#: Customers that a batch hands to the files as a list; beyond that the buckets are read whole.
LISTED_CUSTOMERS = 1000
#: Tasks that write one bucket, so a customer with very many values is not one task.
SPREAD = 8


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("customer_id"), F.lit(buckets)).cast("int")


def _folders(spark: SparkSession, root: str, before: int) -> tuple[dict[int, list[int]], int | None]:
    """The folders of each bucket as of the last commit below ``before``, and the number of buckets."""
    versions = [v for v in committed(spark, root) if v < before]
    if not versions:
        return {}, None
    rows = record(spark, root, versions[-1]).collect()  # one row per bucket
    return {r.bucket: list(r.versions) for r in rows}, rows[0].buckets


def _read(spark: SparkSession, root: str, column: str, folders: dict[int, list[int]]) -> DataFrame:
    paths = [f"{root}/data/version={v}/bucket={b}" for b, versions in sorted(folders.items()) for v in versions]
    ddl = f"customer_id string, `{column}` string"
    return spark.read.schema(ddl).parquet(*paths) if paths else spark.createDataFrame([], ddl)


def known_pairs(customers: DataFrame, column: str, root: str, before: int) -> DataFrame | None:
    """The pairs of these customers (and maybe of others in their buckets) that batches below ``before`` added.

    None where nothing is stored. A repeated batch thus sees what its first attempt saw.
    """
    spark = customers.sparkSession
    folders, buckets = _folders(spark, root, before)
    if buckets is None:
        return None
    ids = customers.select("customer_id").distinct()
    few = [r.customer_id for r in ids.take(LISTED_CUSTOMERS + 1)]
    touched = {r.b for r in ids.select(_bucket(buckets).alias("b")).distinct().collect()}  # at most one row per bucket
    rows = _read(spark, root, column, {b: v for b, v in folders.items() if b in touched})
    if len(few) <= LISTED_CUSTOMERS:
        rows = rows.where(F.col("customer_id").isin([c for c in few if c is not None]))
    return rows


def add_pairs(batch: DataFrame, column: str, root: str, version: int, buckets: int = BUCKETS) -> None:
    """Adds the pairs of a batch that are not stored yet; the same version again replaces its own folders.

    Null customers and values are no pairs: novelty of such rows is decided within a batch alone.
    """
    spark = batch.sparkSession
    folders, stored = _folders(spark, root, version)
    buckets = stored or buckets
    pairs = batch.select("customer_id", column).dropna().distinct()
    known = known_pairs(pairs, column, root, version)
    fresh = pairs if known is None else pairs.join(known, ["customer_id", column], "left_anti")
    fresh = stage(fresh.withColumn("bucket", _bucket(buckets)), "fresh_pairs")
    touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]
    full = {b: folders[b] for b in touched if len(folders.get(b, [])) >= FOLDERS}
    rows = fresh.unionByName(_read(spark, root, column, full).withColumn("bucket", _bucket(buckets))) if full else fresh
    (rows.repartition("bucket", F.pmod(F.xxhash64(column), F.lit(SPREAD))).sortWithinPartitions("bucket", "customer_id")
     .write.mode("overwrite").partitionBy("bucket").option("parquet.bloom.filter.enabled#customer_id", "true")
     .parquet(f"{root}/data/version={version}"))
    now = {b: [*([] if b in full else folders.get(b, [])), *([version] if b in touched else [])] for b in range(buckets)}
    commit(spark.createDataFrame([(b, v, buckets) for b, v in now.items()],
                                 "bucket int, versions array<bigint>, buckets int"), root, version)
