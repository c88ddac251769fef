"""Edge of every signal over the drift, in and out of sample."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.panel import CHUNK, Panel, win

# Holding horizon in bars per timeframe.
HORIZONS = {"15m": 32, "1h": 24, "4h": 12, "1d": 5}
DEFAULT_HORIZON = 12
MIN_BARS, MIN_SIGNALS, MIN_OOS, FOLDS = 500, 60, 20, 5


def horizon_of(tf: Column | str = "tf") -> Column:
    c = F.col(tf) if isinstance(tf, str) else tf
    out = F.lit(DEFAULT_HORIZON)
    for t, h in HORIZONS.items():
        out = F.when(c == t, h).otherwise(out)
    return out


def forward_returns(panel: Panel, horizons: dict[str, int] | None = None) -> DataFrame:
    """``(symbol, tf, bar_idx, n_bars, open_time_ms, horizon, fwd)`` with fwd = ln(C[i+H]/C[i]).

    Computed on the bar where the return is known and keyed back to bar i: the window still only
    looks back, and the bars whose future is missing simply have no row.
    """
    hz = horizons or HORIZONS
    lags = {h: F.struct(F.lag("close", h).over(win()).alias("c"), F.lag("open_time_ms", h).over(win()).alias("t"))
            for h in sorted({*hz.values()} | ({DEFAULT_HORIZON} if horizons is None else set()))}
    past, h = F.lit(None), F.lit(None).cast("int")
    for k, s in lags.items():
        mine = F.col("tf").isin(*[t for t, v in hz.items() if v == k]) if any(v == k for v in hz.values()) else F.lit(False)
        past, h = F.when(mine, s).otherwise(past), F.when(mine, k).otherwise(h)
    df = panel.df.withColumn("_p", past).withColumn("horizon", h)
    own = panel.with_df(df).owned().filter(F.col("_p.c").isNotNull())
    return own.select("symbol", "tf", (F.col("bar_idx") - F.col("horizon")).alias("bar_idx"), "n_bars",
                      F.col("_p.t").alias("open_time_ms"), "horizon",
                      F.ln(F.col("close") / F.col("_p.c")).alias("fwd"))


def out_of_sample(idx: Column, n: Column, horizon: Column, folds: int = FOLDS) -> Column:
    """Bar belongs to fold 1..folds-1 and is at least ``horizon`` bars past its start."""
    step = F.floor(n / folds)
    k = F.floor(idx / step)
    return (step > 0) & k.between(1, folds - 1) & (idx >= k * step + horizon)


def infer_bar_ms(bars: DataFrame) -> DataFrame:
    """Median step between bars per series: steps are counted by value first (few distinct)."""
    from pyspark.sql import Window as W
    b = bars.withColumn("_b", F.floor(F.col("bar_idx") / 4096))
    first = b.groupBy("symbol", "tf", "_b").agg(F.max("open_time_ms").alias("_m"))
    prev = first.select("symbol", "tf", "_b", F.lag("_m").over(
        W.partitionBy("symbol", "tf").orderBy("_b")).alias("_before"))
    w = W.partitionBy("symbol", "tf", "_b").orderBy("bar_idx")
    step = F.col("open_time_ms") - F.coalesce(F.lag("open_time_ms").over(w), F.col("_before"))
    counts = b.join(prev, ["symbol", "tf", "_b"]).withColumn("step", step).filter("step IS NOT NULL").groupBy(
        "symbol", "tf", "step").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("symbol", "tf").agg(
        F.percentile("step", F.lit(0.5), F.col("n")).cast("long").alias("bar_ms"))


def _phases(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """One chunk as a map: whichever of its first rows the greedy count enters by, how many rows it counts here and which is the last.

    The next counted row of every row is one search; jumps are doubled until all have left the chunk.
    """
    t = np.sort(pdf["open_time_ms"].to_numpy())
    span = int(pdf["_span"].iloc[0])
    n = len(t)
    jump = np.append(np.searchsorted(t, t + max(span, 1)), n)
    last = np.where(jump[:n] < n, jump[:n], np.arange(n))
    count = np.append(np.ones(n, np.int64), 0)
    while (jump < n).any():
        count += count[jump]
        jump = jump[jump]
    while (last[last] != last).any():
        last = last[last]
    # the row counted before this chunk is earlier than t[0], so the entry is one of these
    heads = min(n, int(np.searchsorted(t, t[0] + span)) + 1)
    return pd.DataFrame([(*key, span, t[:heads].tolist(), count[:heads].tolist(), t[last[:heads]].tolist())], columns=["_k%d" % i for i in range(len(key))] + ["span", "t", "n", "last"])


def _compose(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """The chunk maps of one group applied one after the other: a search per chunk."""
    total, free = 0, None
    for r in pdf.sort_values("_ck").itertuples(index=False):
        t = np.asarray(r.t)
        at = 0 if free is None else int(np.searchsorted(t, free))
        if at < len(t):
            total += int(r.n[at])
            free = int(r.last[at]) + r.span
    return pd.DataFrame([(*key, total)], columns=["_k%d" % i for i in range(len(key))] + ["n"])


def effective_n(active: DataFrame, keys: list[str], span: str, *, chunk: int = CHUNK, halo: int | None = None,
                split: bool | None = None) -> DataFrame:
    """Greedy count per group of rows at least ``span`` ms after the last counted one; ``span`` is one number per group.

    Each chunk is summed up as a map from the row where the count enters to (rows counted, last row counted); maps are composed
    per group. Two rounds whatever the number of chunks; what is composed is as long as a span has rows, per chunk. Maps need no
    halo and short series no plan of their own, so ``halo`` and ``split`` of earlier callers change nothing.
    """
    a = active.select(*keys, F.floor(F.col("bar_idx") / chunk).alias("_ck"), "open_time_ms", F.ceil(span).cast("long").alias("_span"))
    types = [(k, a.schema[k].dataType.simpleString()) for k in keys]
    head = ", ".join(f"_k{i} {t}" for i, (_, t) in enumerate([*types, ("_ck", "bigint")]))
    maps = a.groupBy(*keys, "_ck").applyInPandas(_phases, f"{head}, span long, t array<long>, n array<long>, last array<long>")
    maps = maps.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate([*keys, "_ck"])], "span", "t", "n", "last")
    got = maps.groupBy(*keys).applyInPandas(_compose, ", ".join(f"_k{i} {t}" for i, (_, t) in enumerate(types)) + ", n long")
    return got.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], F.col("n").alias("n_effective"))


def base_stats(fwd: DataFrame) -> DataFrame:
    oos = out_of_sample(F.col("bar_idx"), F.col("n_bars"), F.col("horizon"))
    return fwd.groupBy("symbol", "tf").agg(
        F.max("n_bars").alias("n_bars"), F.count(F.lit(1)).alias("n_valid"), F.avg("fwd").alias("base_ret"),
        F.avg((F.col("fwd") > 0).cast("double")).alias("base_rate"),
        F.avg(F.when(oos, F.col("fwd"))).alias("_base_oos"))


def active_returns(signals: DataFrame, fwd: DataFrame) -> DataFrame:
    """Bars with a position and a known forward return."""
    return signals.filter("position <> 0").drop("open_time_ms").join(fwd, ["symbol", "tf", "bar_idx"])


def evaluate_signals(signals: DataFrame, fwd: DataFrame, panel: Panel, bar_ms: DataFrame | None = None) -> DataFrame:
    """One row per (signal, symbol, tf) with at least 500 bars and 60 active ones."""
    bar_ms = infer_bar_ms(panel.owned()) if bar_ms is None else bar_ms
    keys = ["signal_name", "symbol", "tf"]
    act = active_returns(signals, fwd)
    oos = out_of_sample(F.col("bar_idx"), F.col("n_bars"), F.col("horizon"))
    r = F.col("position") * F.col("fwd")
    per = act.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_signals"), F.avg((r > 0).cast("double")).alias("hit_rate"),
        F.avg(r).alias("mean_ret"), F.count_if(oos).alias("_n_oos"), F.avg(F.when(oos, r)).alias("_mean_oos"))
    spans = act.join(bar_ms, ["symbol", "tf"]).withColumn("_w", F.col("horizon") * F.col("bar_ms"))
    ne = effective_n(spans, keys, "_w", chunk=panel.chunk)
    out = (per.join(base_stats(fwd), ["symbol", "tf"]).join(ne, keys)
           .filter((F.col("n_bars") >= MIN_BARS) & (F.col("n_signals") >= MIN_SIGNALS)))
    return out.select(
        *keys, F.substring_index("signal_name", ".", 1).alias("family"), "n_signals", "n_effective", "hit_rate",
        "base_rate", "mean_ret", "base_ret", (F.col("mean_ret") - F.col("base_ret")).alias("edge"),
        F.when(F.col("_n_oos") >= MIN_OOS, F.col("_mean_oos") - F.col("_base_oos")).alias("oos_edge"),
        (F.col("n_signals") / F.col("n_valid")).alias("exposure"))


def excess_returns(signals: DataFrame, fwd: DataFrame) -> DataFrame:
    """position · (fwd − mean fwd) on active bars; all other bars are 0 and carry no row."""
    base = fwd.groupBy("symbol", "tf").agg(F.avg("fwd").alias("_base"))
    return active_returns(signals, fwd).join(base, ["symbol", "tf"]).select(
        "signal_name", "symbol", "tf", "bar_idx", "n_bars",
        (F.col("position") * (F.col("fwd") - F.col("_base"))).alias("excess"))


#: Edges below this are rounding: a signal that is always in the market has the drift's own return.
ROUNDING = 1e-12


def oos_degradation(ev: DataFrame) -> DataFrame:
    """Share of signals with a positive edge in sample and out of sample, per timeframe."""
    both = ev.filter("oos_edge IS NOT NULL")
    gains, lasts = F.col("edge") > ROUNDING, F.col("oos_edge") > ROUNDING
    return both.groupBy("tf").agg(
        F.count(F.lit(1)).alias("n"), F.avg(gains.cast("double")).alias("positive_in"),
        F.avg(lasts.cast("double")).alias("positive_out"), F.avg((gains & lasts).cast("double")).alias("positive_both"))


def family_rollup(ev: DataFrame) -> DataFrame:
    """Results by family and timeframe, with totals (NULL = all)."""
    return ev.rollup("family", "tf").agg(
        F.count(F.lit(1)).alias("n"), F.avg("edge").alias("mean_edge"), F.max("edge").alias("best_edge"),
        F.avg("oos_edge").alias("mean_oos_edge"), F.sum("n_effective").alias("n_effective"))


def sidak(p: Column, m: Column | int) -> Column:
    return 1.0 - F.pow(1.0 - p, m if isinstance(m, Column) else F.lit(m))
