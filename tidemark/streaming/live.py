"""Live bars: the batch aggregates on streams. What carries state of its own is in :mod:`tidemark.streaming.stateful`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.clock import TF_MS, tf_ms
from tidemark.operators.bars import MIN_COVERAGE

DELAY = "2 minutes"


def closed_minutes(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """Closed 1m bars of a feed, each once. Healing after a gap sends bars again; they are dropped
    by key while the watermark still remembers it, and as late rows afterwards."""
    return (stream.filter("is_closed").withColumn("ts", F.timestamp_millis("open_time_ms"))
            .withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "open_time_ms"]))


def stream_resample(minutes: DataFrame, tf: str, *, delay: str | None = None, whole: bool = False,
                    min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Tumbling bars of one timeframe in append mode, rebuilt from their minutes. ``minutes``
    carries ``ts`` with a watermark unless ``delay`` is given. ``whole`` only lets out bars whose
    last minute arrived."""
    m = minutes.withWatermark("ts", delay) if delay else minutes
    ms = TF_MS[tf]
    out = (m.groupBy("symbol", F.window("ts", f"{ms // 1000} seconds"))
           .agg(F.min_by("open", "open_time_ms").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                F.max_by("close", "open_time_ms").alias("close"), F.sum("volume").alias("volume"),
                F.count(F.lit(1)).cast("int").alias("n_source_bars"), F.max("open_time_ms").alias("_last")))
    start = F.unix_millis("window.start")
    keep = F.col("_last") == start + ms - 60_000 if whole else F.lit(True)
    return out.filter(keep).select(
        "symbol", F.lit(tf).alias("tf"), start.alias("open_time_ms"), "open", "high", "low", "close", "volume",
        "n_source_bars", (start + ms - 1).alias("close_time_ms"),
        (F.col("n_source_bars") < F.floor(F.lit(min_coverage * ms / 60_000))).alias("is_gap"))


def stream_ticks(ticks: DataFrame, tf: str, delay: str) -> DataFrame:
    """Tumbling bars straight from a tick stream ``(symbol, ts, seq, price, size)``: the same packed
    order key as the batch job."""
    ms = TF_MS[tf]
    t = ticks.withWatermark("ts", delay)
    k = F.struct(F.unix_millis("ts").alias("t"), F.col("seq").alias("s"))
    out = t.groupBy("symbol", F.window("ts", f"{ms // 1000} seconds")).agg(
        F.min_by("price", k).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", k).alias("close"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("trades"))
    start = F.unix_millis("window.start")
    return out.select("symbol", F.lit(tf).alias("tf"), start.alias("open_time_ms"), "open", "high", "low", "close",
                      "volume", "trades", (start + ms - 1).alias("close_time_ms"))


def provisional_bars(stream: DataFrame) -> DataFrame:
    """The newest bar per symbol of a feed, for a side channel in update mode; never unioned with bars.

    ``is_closed`` tells that the bar in flight was absorbed by its closed one. Of several states of one bar the closed
    one is newest, then the one with most volume.
    """
    newest = F.struct("open_time_ms", F.col("is_closed").cast("int").alias("c"), "volume")
    return (stream.groupBy("symbol").agg(F.max_by(F.struct("open_time_ms", "open", "high", "low", "close", "volume", "is_closed"), newest).alias("b"))
            .select("symbol", "b.*"))


def sink_provisional(stream: DataFrame, root: str, checkpoint: str):
    """Every micro-batch writes the symbols that changed into the folder of its epoch, which a retry overwrites."""
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/epoch={epoch}")
    return (provisional_bars(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def read_provisional(spark: SparkSession, root: str) -> DataFrame:
    """The bars in flight now: the last state of each symbol, where no closed bar absorbed it."""
    t = spark.read.parquet(root)
    cols = [c for c in t.columns if c not in ("symbol", "epoch")]
    return t.groupBy("symbol").agg(F.max_by(F.struct(*cols), "epoch").alias("b")).select("symbol", "b.*").filter("NOT is_closed").drop("is_closed")


# ------------------------------------------------------------------ emission, health

def lag_bars(now_ms: Column, last_close_ms: Column, step: Column) -> Column:
    return (now_ms - last_close_ms) / step


def emission_gate(df: DataFrame, now_ms: Column, *, jumped_ms: Column | None = None, before: Column | None = None) -> DataFrame:
    """Adds ``lag_bars`` and ``mode``: one step of the mode machine.

    WARMUP before any closed bar; LIVE at a lag of at most one trigger bar; CATCH_UP when the clock jumped by more than two; else
    the mode stays what it was (``before``), and coming from WARMUP or nothing it is CATCH_UP. Only LIVE rows may be emitted.
    """
    lag = lag_bars(now_ms, F.col("close_time_ms"), tf_ms())
    jump = F.coalesce(jumped_ms > 2 * tf_ms(), F.lit(False)) if jumped_ms is not None else F.lit(False)
    stays = F.when(before == "LIVE", "LIVE").otherwise("CATCH_UP") if before is not None else F.lit("CATCH_UP")
    return df.withColumn("lag_bars", lag).withColumn(
        "mode", F.when(F.col("close_time_ms").isNull(), "WARMUP").when(lag <= 1.0, "LIVE").when(jump, "CATCH_UP").otherwise(stays))


def event_latency(events: DataFrame, event_ms: str, ingest_ms: str, kind: str) -> DataFrame:
    """Ingest minus event time by kind: count, mean, worst, and quantiles."""
    d = F.col(ingest_ms) - F.col(event_ms)
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean_ms"), F.max(d).alias("max_ms"),
                                    F.percentile_approx(d, F.array(F.lit(0.5), F.lit(0.99)), 1000).alias("p50_p99"))


def feed_health(bars: DataFrame, now_ms: Column, *, window: int = 500) -> DataFrame:
    """Silence, lag in bars and gaps among the last ``window`` bars, per series (indexed bars)."""
    recent = bars.filter(F.col("bar_idx") >= F.col("n_bars") - window)
    from pyspark.sql import Window as W
    prev = F.lag("open_time_ms").over(W.partitionBy("symbol", "tf").orderBy("bar_idx"))     # at most `window` rows
    gap = (prev.isNotNull() & (F.col("open_time_ms") - prev != tf_ms())) | F.col("is_gap")
    r = recent.withColumn("_g", gap)
    last = F.max(F.col("open_time_ms") + tf_ms())
    return r.groupBy("symbol", "tf").agg(
        F.max("open_time_ms").alias("last_open_ms"), ((now_ms - last) / 1000.0).alias("silent_seconds"),
        ((now_ms - last) / F.max(tf_ms())).alias("lag_bars"), F.count_if("_g").alias("gaps_in_window"))


def sink_bars(minutes: DataFrame, root: str, checkpoint: str):
    """Idempotent sink: each micro-batch goes through the store's only write path."""
    from tidemark.sources.store import ingest_bars

    def write(batch: DataFrame, _epoch: int) -> None:
        ingest_bars(batch.sparkSession, root, batch)
    return (minutes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
