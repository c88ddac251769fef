"""Monthly kline CSV files to 1m bars, with the per-file checks that decide whether to trust one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clock import MINUTE_MS, month_key

COLUMNS = ("open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades",
           "taker_buy_base", "taker_buy_quote", "ignore")
SCHEMA = ", ".join(f"{c} {'STRING' if c in ('open_time', 'close_time', 'trades', 'ignore') else 'DOUBLE'}"
                   for c in COLUMNS)
MICRO = 100_000_000_000_000          # epochs above are microseconds
# symbol-timeframe-month, as a file name or as a folder of part files
NAME = r"([A-Za-z0-9_]+)-([0-9a-z]+)-(\d{4}-\d{2})(?:[./]|$)"
VALUES = ("open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote")


def read_klines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw rows of kline CSVs. A header line is a row whose first field is no integer; symbol,
    timeframe and month come from the file name."""
    df = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").csv(path)
    path_ = F.col("_metadata.file_path")
    archive = F.regexp_extract(path_, r"^(.*[A-Za-z0-9_]+-[0-9a-z]+-\d{4}-\d{2})(?:[./]|$)", 1)
    f = F.when(archive != "", archive).otherwise(path_)
    df = df.select("*", f.alias("file"), F.monotonically_increasing_id().alias("seq"))
    part = lambda i: F.regexp_extract("file", NAME, i)
    return (df.withColumn("epoch", F.expr("try_cast(trim(BOTH '\"' FROM open_time) AS BIGINT)"))
            .filter("epoch IS NOT NULL")
            .select("file", "seq", "epoch", part(1).alias("symbol"), part(2).alias("tf"), part(3).alias("month"),
                    *[F.col(c).cast("long" if c == "trades" else "double").alias(c) for c in VALUES]))


def normalize_epoch(raw: DataFrame) -> DataFrame:
    """``open_time_ms`` per row: microsecond epochs are divided down."""
    e = F.col("epoch")
    return raw.withColumn("open_time_ms", F.when(e > MICRO, F.floor(e / 1000)).otherwise(e)).withColumn(
        "_us", e > MICRO)


def file_report(raw: DataFrame, step: int = MINUTE_MS) -> DataFrame:
    """One row per file: counts, and the reason to reject it (mixed units, half-step offsets, rows
    outside the month its name advertises) or NULL."""
    r = normalize_epoch(raw)
    off = F.pmod(F.col("open_time_ms"), F.lit(step))
    us = F.count_if("_us")
    outside = F.count_if(month_key(F.col("open_time_ms") - off) != F.col("month"))
    rep = r.groupBy("file", "symbol", "tf", "month").agg(
        F.count(F.lit(1)).alias("rows"), us.alias("rows_us"), F.count_if(off != 0).alias("realigned"),
        F.max(off).alias("max_offset_ms"), outside.alias("outside_month"),
        (F.count(F.lit(1)) - F.countDistinct("open_time_ms")).alias("duplicates"))
    return rep.withColumn("rejected", F.when((F.col("rows_us") > 0) & (F.col("rows_us") < F.col("rows")), "mixed_units")
                          .when(F.col("max_offset_ms") >= step // 2, "off_grid")
                          .when(F.col("outside_month") > 0, "outside_month"))


def align_to_grid(rows: DataFrame, step: int = MINUTE_MS) -> DataFrame:
    """First row per original time, floored to the grid; where two meet, the one with most trades
    stays (the earlier one on a tie)."""
    keys = ["symbol", "open_time_ms"]
    first = rows.groupBy("file", *keys).agg(F.min_by(F.struct("seq", *VALUES), "seq").alias("v"))
    off = F.pmod(F.col("open_time_ms"), F.lit(step))
    return (first.withColumn("open_time_ms", F.col("open_time_ms") - off)
            .groupBy("file", *keys).agg(F.max_by("v", F.struct("v.trades", -F.col("v.seq"))).alias("v"))
            .select(*keys, "file", *[f"v.{c}" for c in VALUES]))


def load_klines(spark: SparkSession, path, *, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(1m bars of the accepted files, file report). Strict: a rejected file fails the job."""
    raw = read_klines(spark, path)
    rep = file_report(raw)
    if strict:
        rep = rep.withColumn("rejected", F.when(F.col("rejected").isNotNull(), F.raise_error(F.concat(
            F.col("file"), F.lit(": "), F.col("rejected"))).cast("string")).otherwise(F.col("rejected")))
    good = normalize_epoch(raw).join(rep.filter("rejected IS NULL").select("file"), "file")
    bars = align_to_grid(good)
    return bars.drop("file"), rep


def months_of(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", month_key(F.col("open_time_ms")).alias("month")).distinct()


def pending_months(published: DataFrame, stored: DataFrame) -> DataFrame:
    """Months to load: published but not stored, and the newest stored one again (it may have been
    stored before it was complete)."""
    newest = stored.groupBy("symbol").agg(F.max("month").alias("month"))
    again = published.join(newest, ["symbol", "month"], "left_semi")
    return published.join(stored, ["symbol", "month"], "left_anti").unionByName(again).distinct()
