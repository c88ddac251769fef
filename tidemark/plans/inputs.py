"""The driver tables as ticks and bars. Bar tables are built once per session and stored, as a
user of the engine would do after ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clock import tf_ms
from tidemark.operators.bars import dense_bar_index, ticks_to_bars, ticks_to_minutes
from tidemark.operators.panel import Panel, build_panel
from tidemark.session import materialize, path_exists

_STORE: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_ticks(spark, sf_dir: str, symbol: str = "l_returnflag") -> DataFrame:
    """Line items as trades: unit price, quantity; order and line number break ties of a day."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    seq = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 16 + F.pmod(cents, F.lit(16))
    return table(spark, sf_dir, "lineitem").select(
        F.col(symbol).cast("string").alias("symbol"), F.col("l_shipdate").alias("ts"),
        seq.cast("long").alias("seq"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"))


def event_ticks(spark, sf_dir: str, symbol: str | None = None) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col(symbol) if symbol else F.lit("ALL")).alias("symbol"), "ts",
        F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("size"))


def order_ticks(spark, sf_dir: str, symbol: str | None = None) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        (F.col(symbol) if symbol else F.lit("ALL")).alias("symbol"), F.col("o_orderdate").alias("ts"),
        F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("size"))


def once(spark: SparkSession, key: tuple, make) -> DataFrame:
    """Build a table the first time it is asked for in this application, then read it back."""
    full = (spark.sparkContext.applicationId, *key)
    hit = _STORE.get(full)
    if hit is None or not path_exists(spark, hit[1]):
        df = materialize(make(), "-".join(str(k).strip("/").replace("/", "_") for k in key))
        hit = (df, df.inputFiles()[0].rsplit("/", 1)[0] if df.inputFiles() else "/")
        _STORE[full] = hit
    return hit[0]


def study_bars(spark, sf_dir: str) -> DataFrame:
    """Daily bars of the three return flags, 1h and 15m bars of all events; indexed and stored."""
    return once(spark, (sf_dir, "study"), lambda: dense_bar_index(
        ticks_to_bars(lineitem_ticks(spark, sf_dir), ["1d"]).unionByName(
            ticks_to_bars(event_ticks(spark, sf_dir), ["1h", "15m"]))))


def study_panel(spark, sf_dir: str) -> Panel:
    return build_panel(study_bars(spark, sf_dir), indexed=True, stored=True)


def cut_study_panel(spark, sf_dir: str) -> Panel:
    """The study bars in chunks so short that every series is split and most lookbacks pass a chunk's start."""
    return build_panel(study_bars(spark, sf_dir), chunk=1_024, halo=512, indexed=True, stored=True)


def event_minutes(spark, sf_dir: str) -> DataFrame:
    return ticks_to_minutes(event_ticks(spark, sf_dir, "event_type"))


def arrival_feed(spark, sf_dir: str) -> DataFrame:
    """Event minutes as a feed with arrival times: some minutes come half an hour after their time, some five hours, some twice."""
    m = event_minutes(spark, sf_dir).select("symbol", "open_time_ms", "open", "high", "low", "close", "volume")
    k = F.floor(F.col("open_time_ms") / 60_000)
    lag = F.when(k % 13 == 0, 300).when(k % 11 == 0, 30).otherwise(0)
    rows = m.withColumn("copy", F.explode(F.when(k % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("*", (F.col("open_time_ms") + 60_000 * (1 + lag + 20 * F.col("copy"))).cast("long").alias("arrival_ms"), F.lit(True).alias("is_closed"))


def emission_feed(spark, sf_dir: str) -> DataFrame:
    """Two wall-clock rows per study bar, up to two and a half bars after its close; the first row of a series knows no closed bar."""
    b = study_bars(spark, sf_dir).withColumn("tf_ms", tf_ms())
    late = F.col("bar_idx") * 7919 % 11 * F.col("tf_ms") / 4
    rows = b.withColumn("turn", F.explode(F.array(F.lit(0), F.lit(1))))
    now = F.col("open_time_ms") + F.col("tf_ms") + (late + F.col("turn") * F.col("tf_ms") / 2)
    return rows.select("symbol", "tf", now.cast("long").alias("now_ms"), F.when((F.col("bar_idx") > 0) | (F.col("turn") > 0), F.col("open_time_ms") + F.col("tf_ms") - 1).alias("last_close_ms"))


def in_files(df: DataFrame, piece, n: int, root: str) -> list:
    """Writers of ``n`` files that appear one after the other, as a feed would: call them in order. ``piece`` tells each row's file."""
    stored = materialize(df.withColumn("_piece", piece.cast("int")), "feed")
    return [lambda i=i: stored.filter(F.col("_piece") == i).drop("_piece").coalesce(1).write.mode("append").parquet(root) for i in range(n)]
