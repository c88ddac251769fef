"""Triple-barrier outcomes, the control arm and the statistics over both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.draws import below
from tidemark.operators.bars import number_rows, with_halo
from tidemark.operators.folds import run_folds, spacing_fold
from tidemark.operators.panel import Panel
from tidemark.operators.pivots import SERIES

MAX_BARS = 48


def trade_signals(plans: DataFrame, panel: Panel, *, min_score: float = 0.0, cooldown: int = 6) -> DataFrame:
    """Accepted entries: viable, in the zone, score high enough, and at least ``cooldown`` bars
    after the last accepted one of the same archetype (both directions share it)."""
    ok = plans.filter(F.col("viable") & F.col("in_zone") & (F.round("score", 3) >= min_score))
    keys = [*SERIES, "archetype"]
    per_bar = ok.groupBy(*keys, "bar_idx").agg(F.min_by(F.struct(
        "open_time_ms", "direction", F.col("price").alias("entry"), F.round("stop", 2).alias("stop"),
        F.round(F.col("targets")[1], 2).alias("target"), F.round("rr_t2", 2).alias("rr"),
        F.round("score", 3).alias("score"), F.round("cost_r", 4).alias("cost_r"),
        F.round("size_factor", 3).alias("size_factor"),
        F.round("invalidation_price", 2).alias("invalidation")), "rank").alias("s"))
    per_bar = per_bar.withColumn("gap", F.lit(float(cooldown))).withColumn("flag", F.lit(1))
    per_bar = (with_halo(per_bar, "bar_idx", panel.chunk, panel.halo) if panel.split
               else per_bar.withColumn("ck", F.lit(0).cast("long")))
    fold = spacing_fold("kept", "bar_idx", "gap", "flag")
    got = run_folds(per_bar, [fold], series=keys, order="bar_idx", chunk=panel.chunk,
                    split=panel.split, keep=["s"])
    return got.filter("kept = 1").select(*keys, "bar_idx", "s.*")


def rejection_counts(plans: DataFrame) -> DataFrame:
    """Refused plans by first reason."""
    reason = F.substring(F.substring_index(F.coalesce(F.get("reasons", F.lit(0)), F.lit("?")), ":", 1), 1, 48)
    return (plans.filter(~F.col("viable")).groupBy(reason.alias("reason"))
            .agg(F.count(F.lit(1)).alias("n")))


def barrier_index(bars: DataFrame, max_bars: int = MAX_BARS) -> DataFrame:
    """One row per series and bucket of ``max_bars`` bars: ``_w``, the bars of the bucket and of the next one in order.

    Whatever bar an entry stands on, the ``max_bars`` bars after it are in the one row of the bucket they begin in. A row
    holds at most twice ``max_bars`` bars, however long the series.
    """
    i = F.col("bar_idx")
    bar = F.struct(i.alias("_j"), F.col("high").alias("_h"), F.col("low").alias("_l"), F.col("close").alias("_c"), F.col("open_time_ms").alias("_t"))
    b = bars.select("symbol", "tf", bar.alias("_x"), F.explode(F.array(F.floor(i / max_bars), F.floor(i / max_bars) - 1)).alias("_b"))
    return b.filter("_b >= 0").groupBy("symbol", "tf", "_b").agg(F.sort_array(F.collect_list("_x")).alias("_w"))


def triple_barrier(entries: DataFrame, bars: DataFrame, *, max_bars: int = MAX_BARS,
                   fine: DataFrame | None = None) -> DataFrame:
    """First touch of target or stop within ``max_bars`` bars after the entry bar.

    ``entries(entry_id, symbol, tf, bar_idx, direction, entry, stop, target)``. Each entry meets exactly
    one row of :func:`barrier_index` and is resolved inside its own row: nothing fans out and nothing is
    grouped again. With ``fine`` (1m bars) a bar that touches both is resolved by the first minute that
    touches one; otherwise it counts as stopped and ambiguous.
    """
    spread = F.abs(F.col("entry") - F.col("stop"))
    e = entries.withColumn("_r", F.when(spread <= 0, F.raise_error(F.lit("zero risk")).cast("double"))
                           .otherwise(spread))
    i = F.col("bar_idx")
    e = e.withColumn("_b", F.floor((i + 1) / max_bars))
    g = e.join(barrier_index(bars, max_bars), ["symbol", "tf", "_b"], "left")
    g = g.withColumn("_w", F.filter("_w", lambda x: x["_j"].between(i + 1, i + max_bars)))
    long = F.col("direction") > 0
    tp = lambda x: F.when(long, x["_h"] >= F.col("target")).otherwise(x["_l"] <= F.col("target"))
    sl = lambda x: F.when(long, x["_l"] <= F.col("stop")).otherwise(x["_h"] >= F.col("stop"))
    g = g.withColumn("_hit", F.get(F.filter("_w", lambda x: tp(x) | sl(x)), F.lit(0)))
    hit = F.col("_hit")
    g = g.withColumn("_n", F.when(hit.isNotNull(), F.array_position(F.col("_w")["_j"], hit["_j"]))
                     .otherwise(F.greatest(F.lit(0), F.coalesce(F.size("_w"), F.lit(0)))).cast("int"))
    # the best and worst prices up to the touch are all that the excursions need
    top = F.array_max(F.slice(F.col("_w")["_h"], F.lit(1), F.col("_n")))
    bottom = F.array_min(F.slice(F.col("_w")["_l"], F.lit(1), F.col("_n")))
    up, down = (top - F.col("entry")) / F.col("_r"), (F.col("entry") - bottom) / F.col("_r")
    best = lambda a, b: F.greatest(F.lit(0.0), F.coalesce(F.when(long, a).otherwise(b), F.lit(0.0)))
    n = F.col("_n")
    g = (g.withColumn("_tp", hit.isNotNull() & tp(hit)).withColumn("_sl", hit.isNotNull() & sl(hit))
         .withColumn("mfe_r", best(up, down)).withColumn("mae_r", best(down, up)).withColumn("bars", n))
    both = F.col("_tp") & F.col("_sl")
    g = g.withColumn("_first", F.lit(None).cast("string"))
    if fine is not None:
        from tidemark.functions.clock import tf_ms
        amb = g.filter(both).select("entry_id", "symbol", "direction", "stop", "target",
                                    F.col("_hit._t").alias("_from"),
                                    (F.col("_hit._t") + tf_ms("tf")).alias("_to"), "tf")
        # bars lie on the grid, so all minutes of a bar share its bucket
        amb = amb.withColumn("_fb", F.floor(F.col("_from") / tf_ms("tf")))
        tfs = [r[0] for r in bars.select("tf").distinct().collect()]
        from tidemark.functions.clock import TF_MS
        mins = fine.select("symbol", F.col("open_time_ms").alias("_m"), F.col("high").alias("_h"),
                           F.col("low").alias("_l"), F.explode(F.array(*[F.struct(
                               F.lit(t).alias("tf"), F.floor(F.col("open_time_ms") / TF_MS[t]).alias("_fb"))
                               for t in tfs])).alias("_k")).select("*", "_k.tf", "_k._fb").drop("_k")
        j = amb.join(mins, ["symbol", "tf", "_fb"])
        row = F.struct("_h", "_l")
        j = j.withColumn("_tp", tp(row)).withColumn("_sl", sl(row)).filter("_tp OR _sl")
        first = j.groupBy("entry_id").agg(F.min_by(
            F.when(F.col("_tp") & F.col("_sl"), "tie").when(F.col("_tp"), "tp").otherwise("sl"), "_m").alias("_f"))
        g = g.join(first, "entry_id", "left").withColumn(
            "_first", F.when(both & (F.col("_f") != "tie"), F.col("_f"))).drop("_f")
    won = (F.col("_tp") & ~F.col("_sl")) | (both & (F.coalesce("_first", F.lit("")) == "tp"))
    lost = (F.col("_sl") & ~F.col("_tp")) | (both & ~won)
    last = F.get("_w", n - 1)
    g = (g.withColumn("barrier", F.when(won, "tp").when(lost, "sl").otherwise("vertical"))
         .withColumn("r", F.when(won, F.abs(F.col("target") - F.col("entry")) / F.col("_r"))
                     .when(lost, -1.0).when(n == 0, 0.0)
                     .otherwise(F.col("direction") * (last["_c"] - F.col("entry")) / F.col("_r")))
         .withColumn("ambiguous", both & F.col("_first").isNull()))
    return g.select(*entries.columns, "barrier", "r", "mae_r", "mfe_r", "bars", "ambiguous")


def null_arm(entries: DataFrame, bars: DataFrame, *, seed: int = 17, reach: int = 20) -> DataFrame:
    """A twin of each entry: entered 1..reach bars later (never on the last bar), same risk, same
    multiple of it."""
    k = below(reach, seed, F.col("entry_id")) + 1
    e = entries.drop("n_bars").join(bars.groupBy("symbol", "tf").agg(F.max("n_bars").alias("_n")), ["symbol", "tf"])
    e = e.withColumn("_j", F.least(F.col("_n") - 2, F.col("bar_idx") + k))
    at = bars.select("symbol", "tf", F.col("bar_idx").alias("_j"), F.col("close").alias("_e"),
                     F.col("open_time_ms").alias("_t"))
    risk, d = F.abs(F.col("entry") - F.col("stop")), F.col("direction")
    rr = F.abs(F.col("target") - F.col("entry")) / risk
    t = e.join(at, ["symbol", "tf", "_j"])
    swap = {"bar_idx": F.col("_j"), "open_time_ms": F.col("_t"), "entry": F.col("_e"),
            "stop": F.col("_e") - d * risk, "target": F.col("_e") + d * risk * rr}
    return t.select(*[swap.get(c, F.col(c)).alias(c) for c in entries.columns])


def resolve_with_control(entries: DataFrame, bars: DataFrame, *, max_bars: int = MAX_BARS, seed: int = 17,
                         fine: DataFrame | None = None) -> DataFrame:
    """Outcome of each entry beside that of its twin; entries on the last bar have none."""
    last = bars.groupBy("symbol", "tf").agg(F.max("bar_idx").alias("_last"))
    e = entries.join(last, ["symbol", "tf"]).filter(F.col("bar_idx") < F.col("_last")).drop("_last")
    own = triple_barrier(e, bars, max_bars=max_bars, fine=fine)
    twin = triple_barrier(null_arm(e, bars, seed=seed), bars, max_bars=max_bars)
    return own.join(twin.select("entry_id", F.col("r").alias("null_r"), F.col("barrier").alias("null_barrier"),
                                F.col("bar_idx").alias("null_bar_idx")), "entry_id")


def backtest_stats(outcomes: DataFrame, cost_multipliers=(1.0, 1.5, 2.0), keys=()) -> DataFrame:
    """Expectancy and friends net of cost, per cost multiplier, with the control arm beside."""
    o = outcomes.withColumn("cost_mult", F.explode(F.array(*[F.lit(float(m)) for m in cost_multipliers])))
    net, null = F.col("r") - F.col("cost_r") * F.col("cost_mult"), F.col("null_r") - F.col("cost_r") * F.col("cost_mult")
    win = F.sum(F.when(net > 0, net).otherwise(0.0))
    loss = F.sum(F.when(net > 0, 0.0).otherwise(-net))
    return o.groupBy(*keys, "cost_mult").agg(
        F.count(F.lit(1)).alias("n"), F.avg(net).alias("expectancy_r"),
        F.avg((net > 0).cast("double")).alias("hit_rate"),
        F.when(loss > 0, win / loss).alias("profit_factor"), F.sum(net).alias("r_total"),
        F.stddev_pop(net).alias("r_std"), F.max(net).alias("best"), F.min(net).alias("worst"),
        F.avg(null).alias("null_expectancy_r"), (F.avg(net) - F.avg(null)).alias("edge_vs_null"),
        *[F.count_if(F.col("barrier") == b).alias(f"n_{b}") for b in ("tp", "sl", "vertical")],
        F.avg(F.col("ambiguous").cast("double")).alias("ambiguity_rate"))


def edge_ci(outcomes: DataFrame, *, draws: int = 1000, seed: int = 23, level: float = 0.95) -> DataFrame:
    """Bootstrap interval of the expectancy and of the paired edge over the control arm, by side.

    Slot s of draw d takes trade ``hash(d, s) mod n``. Slots are counted per (draw, trade) before
    they meet the trades, so a draw is a distributed weighted sum.
    """
    o = outcomes.withColumn("side", F.explode(F.array(
        F.lit("all"), F.when(F.col("direction") > 0, "long").otherwise("short"))))
    o = o.select("side", "entry_id", (F.col("r") - F.col("cost_r")).alias("x"), (F.col("r") - F.col("null_r")).alias("d"))
    o = number_rows(o, ["side"], "entry_id", below(256, seed, F.col("entry_id")), "k", "n")
    slots = o.select("side", "n", "k", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    picks = slots.groupBy("side", "draw", below(F.col("n"), seed, F.col("side"), F.col("draw"), F.col("k")).alias("k")
                          ).agg(F.count(F.lit(1)).alias("m"))
    per = picks.join(o.select("side", "k", "x", "d"), ["side", "k"]).groupBy("side", "draw").agg(
        (F.sum(F.col("m") * F.col("x")) / F.sum("m")).alias("x"), (F.sum(F.col("m") * F.col("d")) / F.sum("m")).alias("d"))
    a = (1 - level) / 2
    ci = per.groupBy("side").agg(
        F.percentile("x", F.lit(a)).alias("expectancy_lo"), F.percentile("x", F.lit(1 - a)).alias("expectancy_hi"),
        F.percentile("d", F.lit(a)).alias("edge_lo"), F.percentile("d", F.lit(1 - a)).alias("edge_hi"))
    mean = o.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("expectancy_r"), F.avg("d").alias("edge_vs_null"))
    return mean.join(ci, "side")


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """(value, average rank) over the whole table: equal values counted first, then ranked inside
    quantile pieces shifted by the pieces before; null ranks last, after NaN."""
    v = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    cuts = sorted(set(v.approxQuantile(value, [i / 64 for i in range(1, 64)], 0.002)))     # 63 numbers
    piece = sum((F.when(F.col(value) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    v = v.withColumn("_b", F.when(F.col(value).isNull(), len(cuts) + 1).otherwise(piece))
    sizes = v.groupBy("_b").agg(F.sum("_c").alias("_n"))
    offs = sizes.select("_b", F.coalesce(F.sum("_n").over(W.orderBy("_b").rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0)).alias("_off"))          # at most 64 rows
    run = F.sum("_c").over(W.partitionBy("_b").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    return v.join(F.broadcast(offs), "_b").select(
        value, (F.col("_off") + run - F.col("_c") + (F.col("_c") + 1) / 2.0).alias(out))


def score_rank_corr(outcomes: DataFrame) -> DataFrame:
    """Rank correlation of candidate score and outcome: null without any, NaN where all scores or all outcomes are equal, as in SQL."""
    o = outcomes.select("score", "r")
    rs, rr = (average_rank(o, c, out).withColumnRenamed(c, f"_{c}") for c, out in (("score", "rs"), ("r", "rr")))
    j = o.join(rs, F.col("score").eqNullSafe(F.col("_score"))).join(rr, F.col("r").eqNullSafe(F.col("_r")))
    # F.corr divides by the deviations before any condition on them is looked at; sums of equal ranks need not cancel to exactly 0
    a = j.agg(F.count(F.lit(1)).alias("n"), F.covar_pop("rs", "rr").alias("_cov"), F.stddev_pop("rs").alias("_s"), F.stddev_pop("rr").alias("_t"),
              ((F.min("rs") == F.max("rs")) | (F.min("rr") == F.max("rr"))).alias("_flat"))
    return a.select("n", F.when(F.col("_flat"), float("nan")).otherwise(F.col("_cov") / (F.col("_s") * F.col("_t"))).alias("rank_corr"))
