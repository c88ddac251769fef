"""The stored 1m history: Parquet partitioned by symbol and month, written only by ``ingest_bars``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clock import MINUTE_MS, month_key
from tidemark.operators.bars import fill_grid
from tidemark.session import materialize, path_exists

VALUES = ("open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote")
KEYS = ("symbol", "open_time_ms")


def _known(df: DataFrame) -> list[str]:
    return [c for c in VALUES if c in df.columns]


def first_per_key(batch: DataFrame, seq: str | None = None) -> DataFrame:
    """One row per (symbol, open_time_ms) of a batch: the first by ``seq``."""
    cols = _known(batch)
    if seq is None:
        return batch.select(*KEYS, *cols).dropDuplicates(list(KEYS))
    return (batch.groupBy(*KEYS).agg(F.min_by(F.struct(*cols), seq).alias("v")).select(*KEYS, "v.*"))


def stored_keys(spark: SparkSession, root: str, months: list[str]) -> DataFrame:
    """(symbol, month, open_time_ms) of the stored bars of some months; other months are not listed."""
    month = F.col("month").cast("string").alias("month")
    return spark.read.parquet(root).select("symbol", month, "open_time_ms").filter(F.col("month").isin(*months))


def ingest_bars(spark: SparkSession, root: str, batch: DataFrame, *, seq: str | None = None,
                step: int = MINUTE_MS) -> DataFrame:
    """Idempotent upsert: rows already stored win, only new ones are appended to their month.

    Only the touched months of the store are read for the anti join: their list (a dozen a year) goes
    into the scan as literals. Returns (symbol, month, written, duplicates).
    """
    bad = F.pmod(F.col("open_time_ms"), F.lit(step)) != 0
    batch = batch.withColumn("open_time_ms", F.when(bad, F.raise_error(F.lit("open time off the grid")).cast("long"))
                             .otherwise(F.col("open_time_ms")))
    rows = materialize(first_per_key(batch, seq).withColumn("month", month_key(F.col("open_time_ms"))), "ingest")
    if path_exists(spark, root):
        old = stored_keys(spark, root, [r["month"] for r in rows.select("month").distinct().collect()])
        fresh =materialize(rows.join(old, ["symbol", "month", "open_time_ms"], "left_anti"), "ingest")
    else:
        fresh = rows
    # one file per (symbol, month) in the usual case; a hot month is split by day of month
    (fresh.withColumn("_d", F.floor(F.col("open_time_ms") / (86_400_000 * 8)))
     .repartition("symbol", "month", "_d").drop("_d").sortWithinPartitions("symbol", "month", "open_time_ms")
     .write.mode("append").partitionBy("symbol", "month").option("compression", "zstd").parquet(root))
    n = rows.groupBy("symbol", "month").agg(F.count(F.lit(1)).alias("_n"))
    w = fresh.groupBy("symbol", "month").agg(F.count(F.lit(1)).alias("_w"))
    return n.join(w, ["symbol", "month"], "left").select(
        "symbol", "month", F.coalesce("_w", F.lit(0)).alias("written"), (F.col("_n") - F.coalesce("_w", F.lit(0))).alias("duplicates"))


def read_bars(spark: SparkSession, root: str, *, symbols: list[str] | None = None, start_ms: int | None = None,
              end_ms: int | None = None, grid: bool = True) -> DataFrame:
    """A range of stored bars: month partitions are pruned, the range is pushed to the scan; with
    ``grid`` missing minutes appear as gap rows."""
    df = spark.read.parquet(root).withColumn("month", F.col("month").cast("string"))
    if symbols:
        df = df.filter(F.col("symbol").isin(*symbols))
    for ms, op in ((start_ms, "ge"), (end_ms, "le")):
        if ms is not None:
            key = month_key(F.lit(ms))
            df = df.filter((F.col("open_time_ms") >= ms) & (F.col("month") >= key) if op == "ge"
                           else (F.col("open_time_ms") <= ms) & (F.col("month") <= key))
    df = df.drop("month").withColumn("tf", F.lit("1m"))
    return fill_grid(df) if grid else df


def stored_months(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root).select("symbol", F.col("month").cast("string").alias("month")).distinct()
