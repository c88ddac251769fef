"""Ticks and 1-minute bars to multi-timeframe bars, gap accounting and dense ordinals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.clock import MINUTE_MS, TF_MS, as_ms, close_time, floor_to, tf_ms

SUMMED = ("volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote")
MIN_COVERAGE = 0.9
_SEQ_BITS = 47          # ms-in-minute needs 16 bits: both fit one positive long
_IDX_BUCKET = 4096      # bars per ordinal bucket


def ticks_to_minutes(ticks: DataFrame) -> DataFrame:
    """Ticks ``(symbol, ts, seq, price, size)`` to 1m bars.

    First and last price are picked by ONE packed long, ``ms-in-minute << 47 | seq``, so every
    aggregation buffer is a primitive and the job is a hash aggregation with map-side partials: a
    symbol holding a third of all ticks leaves each map task as one row per minute.
    ``seq`` must be in [0, 2^47) and order the ticks of one millisecond; any other fails the job.
    """
    t = as_ms("ts")
    minute = floor_to(t, MINUTE_MS)
    seq = F.col("seq").cast("long")
    seq = F.when(seq.between(0, 2**_SEQ_BITS - 1), seq).otherwise(F.raise_error(F.lit("seq must be in [0, 2^47)")).cast("long"))
    key = F.shiftleft(t - minute, _SEQ_BITS).bitwiseOR(seq)
    return (ticks.select("symbol", minute.alias("open_time_ms"), key.alias("k"), "price", "size")
            .groupBy("symbol", "open_time_ms")
            .agg(F.min_by("price", "k").alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", "k").alias("close"),
                 F.sum("size").alias("volume"),
                 F.sum(F.col("price") * F.col("size")).alias("quote_volume"),
                 F.count(F.lit(1)).alias("trades")))


def resample_bars(bars_1m: DataFrame, tfs: Sequence[str], *,
                  min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """1m bars to the requested timeframes in one shuffle.

    Bucketed by OPEN time. Each minute is exploded to its (tf, bucket) pairs before the partial
    aggregation, so all timeframes come out of one scan and one exchange.
    """
    have = [c for c in SUMMED if c in bars_1m.columns]
    pairs = F.array(*[F.struct(F.lit(t).alias("tf"),
                               floor_to(F.col("open_time_ms"), TF_MS[t]).alias("b")) for t in tfs])
    step = tf_ms("tf")
    out = (bars_1m.select("symbol", F.col("open_time_ms").alias("t"), "open", "high", "low",
                          "close", *have, F.explode(pairs).alias("p"))
           .groupBy("symbol", F.col("p.tf").alias("tf"), F.col("p.b").alias("open_time_ms"))
           .agg(F.min_by("open", "t").alias("open"), F.max("high").alias("high"),
                F.min("low").alias("low"), F.max_by("close", "t").alias("close"),
                *[F.sum(c).alias(c) for c in have],
                F.count(F.lit(1)).cast("int").alias("n_source_bars")))
    expected = (step / MINUTE_MS)
    return (out
            .withColumn("close_time_ms", close_time(F.col("open_time_ms"), step))
            .withColumn("is_gap", F.col("n_source_bars")
                        < F.floor(F.lit(min_coverage) * expected)))


def duplicate_minutes(bars_1m: DataFrame) -> DataFrame:
    """Keys that occur more than once: the precondition ``resample_bars`` relies on."""
    return (bars_1m.groupBy("symbol", "open_time_ms").agg(F.count(F.lit(1)).alias("n"))
            .filter("n > 1"))


def ticks_to_bars(ticks: DataFrame, tfs: Sequence[str], *,
                  min_coverage: float = MIN_COVERAGE) -> DataFrame:
    return resample_bars(ticks_to_minutes(ticks), tfs, min_coverage=min_coverage)


def bar_coverage(n_source: Column, tf: Column | str = "tf") -> Column:
    return n_source / (tf_ms(tf) / MINUTE_MS)


def bar_violation(step: Column | None = None) -> Column:
    """Why a row is not a bar, or NULL: off the grid, a price missing, or high/low not the extremes."""
    step = tf_ms() if step is None else step
    return (F.when(F.pmod(F.col("open_time_ms"), step) != 0, "off_grid")
            .when(F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull(), "price_missing")
            .when(F.col("high") < F.greatest("open", "close", "low"), "high_not_max")
            .when(F.col("low") > F.least("open", "close", "high"), "low_not_min"))


def validate_bars(bars: DataFrame, *, strict: bool = False) -> DataFrame:
    """Bars with a ``violation`` column; in strict mode a violating row fails the job."""
    v = bar_violation()
    if strict:
        v = F.when(v.isNotNull(), F.raise_error(F.concat(F.lit("bad bar: "), v))).otherwise(v)
        return bars.withColumn("violation", v.cast("string"))
    return bars.withColumn("violation", v)


def number_rows(df: DataFrame, keys: Sequence[str], order: str, bucket: Column, idx: str,
                total: str | None = None) -> DataFrame:
    """0-based ordinals per key group without sorting a group in one task.

    ``bucket`` must be monotone in ``order`` and hold boundedly many rows. Rows are numbered
    inside buckets and shifted by the running count of the buckets before; only the bucket table
    is scanned per group.
    """
    b = df.withColumn("_ob", bucket)
    sizes = b.groupBy(*keys, "_ob").agg(F.count(F.lit(1)).alias("_n"))
    g = W.partitionBy(*keys)
    before = g.orderBy("_ob").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_ob", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
                           *([F.sum("_n").over(g).alias(total)] if total else []))
    r = F.row_number().over(W.partitionBy(*keys, "_ob").orderBy(order))
    return (b.join(offsets, [*keys, "_ob"])
            .withColumn(idx, (r - 1 + F.col("_off")).cast("long")).drop("_ob", "_off"))


def dense_bar_index(bars: DataFrame) -> DataFrame:
    """Adds ``bar_idx`` (0-based ordinal per series) and ``n_bars`` (length of the series)."""
    return number_rows(bars, ["symbol", "tf"], "open_time_ms",
                       F.floor(F.col("open_time_ms") / (tf_ms() * _IDX_BUCKET)), "bar_idx", "n_bars")


def with_halo(df: DataFrame, idx: str, chunk: int, halo: int) -> DataFrame:
    """Chunk id ``ck`` by ordinal; each chunk also gets copies of the ``halo`` rows before it."""
    own, nxt = F.floor(F.col(idx) / chunk), F.floor((F.col(idx) + halo) / chunk)
    return df.withColumn("ck", F.explode(F.array_distinct(F.array(own, nxt))))


def flag_gaps(bars: DataFrame, step_window) -> DataFrame:
    """A bar is a gap when it does not follow its predecessor by one step or is poorly covered."""
    prev = F.lag("open_time_ms").over(step_window)
    return bars.withColumn("gap", (prev.isNotNull() & (F.col("open_time_ms") - prev != tf_ms()))
                           | F.col("is_gap"))


def require_complete(gap: Column, ts: Column, rows_window, n: int) -> tuple[Column, Column]:
    """(window of n bars is complete, open time of the first gap in it)."""
    full = F.count(F.lit(1)).over(rows_window) == n
    bad = F.max(gap.cast("int")).over(rows_window) == 1
    first = F.min(F.when(gap, ts)).over(rows_window)
    return full & ~bad, first


def fill_grid(bars: DataFrame) -> DataFrame:
    """The full grid between the first and last bar of each series; missing rows carry is_gap.

    The missing slots are generated from each bar and its successor inside bounded time buckets
    (plus one row per bucket for the step to the next bucket), never from one per-series array.
    """
    keys = ["symbol", "tf"]
    step = tf_ms()
    b = bars.withColumn("_ob", F.floor(F.col("open_time_ms") / (step * _IDX_BUCKET)))
    edges = b.groupBy(*keys, "_ob").agg(F.min("open_time_ms").alias("_first"))
    nxt = W.partitionBy(*keys).orderBy("_ob")
    edges = edges.select(*keys, "_ob", F.lead("_first").over(nxt).alias("_next_first"))
    w = W.partitionBy(*keys, "_ob").orderBy("open_time_ms")
    succ = F.coalesce(F.lead("open_time_ms").over(w), F.col("_next_first"))
    spans = (b.join(edges, [*keys, "_ob"])
             .select(*keys, "open_time_ms", succ.alias("_succ"))
             .filter(F.col("_succ") - F.col("open_time_ms") > step)
             .select(*keys, F.explode(F.sequence(F.col("open_time_ms") + step,
                                                 F.col("_succ") - step, step)
                                      ).alias("open_time_ms"))
             .withColumn("is_gap", F.lit(True)))
    present = bars.withColumn("is_gap", F.col("close").isNull())
    return present.unionByName(spans, allowMissingColumns=True)


def coverage(bars: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """(present, expected, fraction) of grid slots per series in a range; empty → 0 of the range."""
    step = F.max(tf_ms())
    inside = F.col("open_time_ms").between(start_ms, end_ms)
    t = F.when(inside, F.col("open_time_ms"))
    present = F.count(t)
    expected = F.when(present > 0, (F.max(t) - F.min(t)) / step + 1).otherwise(
        F.greatest(F.lit(0), F.floor((F.lit(end_ms) - F.lit(start_ms)) / step) + 1)).cast("long")
    return (bars.groupBy("symbol", "tf")
            .agg(present.alias("present"), expected.alias("expected"))
            .withColumn("fraction", F.when(F.col("expected") > 0,
                                           F.col("present") / F.col("expected")).otherwise(0.0)))


def latest_bars(bars: DataFrame, n: int) -> DataFrame:
    """Last n bars of every series, straight from the ordinals (no sort)."""
    return bars.filter(F.col("bar_idx") >= F.col("n_bars") - n)
