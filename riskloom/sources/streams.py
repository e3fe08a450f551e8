"""Streaming sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.schemas import TXN_DDL

TRANSACTION_TOPIC = "transactions.raw"
FLAGGED_TOPIC = "case.flagged"


def read_txn_stream(spark: SparkSession, source: str = "kafka", **options: str) -> DataFrame:
    """Transactions from a Kafka topic of JSON events, or from a growing Parquet folder."""
    if source == "kafka":
        raw = (spark.readStream.format("kafka").option("subscribe", TRANSACTION_TOPIC)
               .options(**options).load())
        return raw.select(F.from_json(F.col("value").cast("string"), TXN_DDL).alias("t")).select("t.*")
    path = options.pop("path")
    return spark.readStream.format(source).schema(TXN_DDL).options(**options).load(path)


def write_alerts(alerts: DataFrame, checkpoint: str, sink: str = "kafka", **options: str):
    """Starts the alert stream (key, value) into a topic or folder."""
    writer = alerts.writeStream.format(sink).option("checkpointLocation", checkpoint)
    if sink == "kafka":
        options.setdefault("topic", FLAGGED_TOPIC)
    return writer.options(**options).outputMode("append").start()
