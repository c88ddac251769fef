"""Append-only JSON event files: recorded streams and polled metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "_source STRING, _ts_ingest_ms LONG, ts LONG, symbol STRING, side STRING, price DOUBLE, size DOUBLE"


def json_events(spark: SparkSession, path: str, schema: str = EVENT_SCHEMA, *, stream: bool = False) -> DataFrame:
    """Events with both clocks: when they happened and when they were received."""
    reader = spark.readStream if stream else spark.read
    df = reader.schema(schema).json(path)
    day = F.date_format(F.timestamp_millis("_ts_ingest_ms"), "yyyy-MM-dd")
    return df.withColumn("day", day).withColumn("latency_ms", F.col("_ts_ingest_ms") - F.col("ts"))


def sink_events(events: DataFrame, root: str, checkpoint: str):
    """Streaming sink partitioned by day and source."""
    return (events.writeStream.format("parquet").partitionBy("day", "_source").option("path", root)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def derivative_metrics(raw: DataFrame) -> DataFrame:
    """Polled windows overlap: one row per (kind, symbol, ts), the first one received."""
    rest = [c for c in raw.columns if c not in ("kind", "symbol", "ts")]
    return raw.groupBy("kind", "symbol", "ts").agg(F.min_by(F.struct(*rest), "_ts_ingest_ms").alias("r")).select(
        "kind", "symbol", "ts", "r.*")
