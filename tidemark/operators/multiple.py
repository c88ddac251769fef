"""White's Reality Check over everything that was tried, and the log of trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.draws import below, fast_below, u32
from tidemark.session import materialize

GROUP = ["symbol", "tf"]
MIN_BLOCKS = 30


def strategy_means(excess: DataFrame) -> DataFrame:
    """Mean per strategy over all n bars (absent rows are zeros)."""
    return excess.groupBy(*GROUP, "signal_name").agg(
        F.max("n_bars").alias("n"), (F.sum("excess") / F.max("n_bars")).alias("mean"))


def aligned(means: DataFrame) -> DataFrame:
    """Groups that can be corrected together: one length, at least two strategies."""
    return means.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("k"), F.countDistinct("n").alias("_l")).filter(
        "k >= 2 AND _l = 1").select(*GROUP, "k")


def alignment_refusals(means: DataFrame) -> DataFrame:
    """Groups that cannot be corrected together, and why."""
    g = means.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("k"), F.countDistinct("n").alias("_l"))
    return g.withColumn("refused", F.when(F.col("_l") > 1, "different_lengths").when(F.col("k") < 2, "one_strategy")).filter("refused IS NOT NULL").select(*GROUP, "k", "refused")


def block_length(excess: DataFrame, means: DataFrame) -> DataFrame:
    """n^(1/3)·(1+2|ρ1|) of the best-mean strategy, clamped to [2, n/4]; ρ1 clamped to ±0.9.

    Zero rows are absent, so the centred sums are written out over the rows that exist.
    """
    best = means.groupBy(*GROUP).agg(F.max_by(F.struct("signal_name", "mean", "n"), F.struct(
        "mean", F.lit(0))).alias("b"))
    ties = means.join(best.select(*GROUP, F.col("b.mean").alias("_m")), GROUP).filter("mean = _m").groupBy(*GROUP).agg(
        F.min_by(F.struct("signal_name", "mean", "n"), "signal_name").alias("b"))
    b = ties.select(*GROUP, "b.*")
    x = excess.drop("n_bars").join(b, [*GROUP, "signal_name"])
    nxt = x.select(*GROUP, "signal_name", (F.col("bar_idx") - 1).alias("bar_idx"), F.col("excess").alias("_nx"))
    j = x.join(nxt, [*GROUP, "signal_name", "bar_idx"], "left")
    m, n = F.col("mean"), F.col("n")
    agg = j.groupBy(*GROUP, "signal_name").agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.sum("excess").alias("_s"),
        F.sum(F.col("excess") * F.col("excess")).alias("_q"), F.sum(F.col("excess") * F.col("_nx")).alias("_c"),
        F.coalesce(F.sum(F.when(F.col("bar_idx") == 0, F.col("excess"))), F.lit(0.0)).alias("_f"),
        F.coalesce(F.sum(F.when(F.col("bar_idx") == F.col("n") - 1, F.col("excess"))), F.lit(0.0)).alias("_e"))
    denom = F.col("_q") - n * m * m
    cross = F.coalesce("_c", F.lit(0.0)) - m * ((F.col("_s") - F.col("_e")) + (F.col("_s") - F.col("_f"))) + (n - 1) * m * m
    rho = F.greatest(F.lit(-0.9), F.least(F.lit(0.9), F.when(denom > 0, cross / denom).otherwise(0.0)))
    length = F.when(n < 20, 2.0).otherwise(F.greatest(F.lit(2.0), F.least(n / 4.0, F.pow(n, F.lit(1.0 / 3.0)) * (1 + 2 * F.abs(rho)))))
    return agg.select(*GROUP, F.col("signal_name").alias("best_name"), F.col("mean").alias("best_mean"), "n", length.alias("block"))


def divisible_length(target: Column, n: Column, min_blocks: int = MIN_BLOCKS) -> Column:
    """Length nearest to target (±20%) that divides n into >= min_blocks blocks; ties: the longer."""
    span = F.greatest(F.lit(2), F.floor(target / 5))
    cand = F.sequence(F.greatest(F.lit(2), target - span).cast("long"), (target + span).cast("long"))
    ok = F.filter(cand, lambda c: (F.pmod(n, c) == 0) & (F.floor(n / c) >= min_blocks))
    best = F.array_min(F.transform(ok, lambda c: F.struct(F.abs(c - target).alias("d"), (-c).alias("l"))))
    return F.coalesce(-best["l"], target)


def block_means(excess: DataFrame, plan: DataFrame, means: DataFrame) -> DataFrame:
    """Centred returns averaged per block: K × blocks rows, zeros included."""
    size = F.col("len")
    k = [*GROUP, "signal_name"]
    sums = (excess.drop("n_bars").join(plan.select(*GROUP, "len", "nb"), GROUP)
            .filter(F.col("bar_idx") < size * F.col("nb"))
            .groupBy(*k, F.floor(F.col("bar_idx") / size).alias("blk")).agg(F.sum("excess").alias("_s")))
    grid = means.join(plan.select(*GROUP, "len", "nb"), GROUP).withColumn(
        "blk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)))
    return grid.join(sums, [*k, "blk"], "left").select(
        *k, "blk", (F.coalesce("_s", F.lit(0.0)) / size - F.col("mean")).alias("bm"))


def block_draws(blocks: DataFrame, plan: DataFrame, *, draws: int, seed: int, exact_hash: bool = False) -> DataFrame:
    """Mean of resampled blocks per (draw, strategy). The blocks of a draw are the same for all
    strategies; they are counted per (draw, block) before meeting the block means."""
    pick = below if exact_hash else fast_below
    slots = plan.select(*GROUP, "nb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("slot"))
    slots = slots.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = slots.groupBy(*GROUP, "nb", "draw", pick(F.col("nb"), seed, F.col("symbol"), F.col("tf"), F.col("draw"),
                                                     F.col("slot")).alias("blk")).agg(F.count(F.lit(1)).alias("m"))
    return picks.join(blocks, [*GROUP, "blk"]).groupBy(*GROUP, "draw", "signal_name").agg(
        (F.sum(F.col("m") * F.col("bm")) / F.first("nb")).alias("draw_mean"))


def stationary_draws(excess: DataFrame, means: DataFrame, plan: DataFrame, *, draws: int, seed: int) -> DataFrame:
    """Fallback for short samples (fewer than 30 blocks): blocks of geometric length that wrap
    around. A bar restarts with probability 1/block; otherwise it continues the last restart.

    A draw is kept as the edges of its blocks: the weight of a bar, how often it was drawn, is the running sum of +1 where a
    block begins and -1 behind its end. The mean under those weights is then a sum over edges of suffix sums, some thirty
    rows a draw. Samples this short have fewer than 800 bars: n < 30 blocks and a block is at most 2.8 times the cube root of n.
    """
    n, p = F.col("n"), F.lit(1.0) / F.greatest(F.col("block"), F.lit(1.0))
    hashed = lambda t, what: u32(seed, F.col("symbol"), F.col("tf"), F.col("draw"), t, F.lit(what))
    d = plan.select(*GROUP, "n", "block", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    d = d.withColumn("starts", F.filter(F.sequence(F.lit(0).cast("long"), n - 1), lambda t: (t == 0) | (hashed(t, "p") / F.lit(4294967296.0) < p)))
    d = d.withColumn("blocks", F.transform("starts", lambda t, k: F.struct(
        F.pmod(hashed(t, "i"), n).alias("i"), (F.coalesce(F.get("starts", k + 1), n) - t).alias("len"))))
    edge = lambda pos, w: F.struct(pos.cast("long").alias("pos"), F.lit(w).alias("w"))
    end = lambda b: b["i"] + b["len"]
    edges = F.flatten(F.transform("blocks", lambda b: F.when(end(b) <= n, F.array(edge(b["i"], 1), edge(end(b), -1))).otherwise(
        F.array(edge(b["i"], 1), edge(F.lit(0), 1), edge(end(b) - n, -1)))))
    e = d.select(*GROUP, "n", "draw", F.explode(edges).alias("e")).select(*GROUP, "n", "draw", "e.*").filter("pos < n").groupBy(*GROUP, "draw", "pos").agg(F.sum("w").alias("w"))
    grid = means.drop("n").join(plan.select(*GROUP, "n"), GROUP).withColumn("bar_idx", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    after = W.partitionBy(*GROUP, "signal_name").orderBy(F.col("bar_idx").desc()).rowsBetween(W.unboundedPreceding, 0)
    suffix = grid.join(excess.drop("n_bars"), [*GROUP, "signal_name", "bar_idx"], "left").select(
        *GROUP, "signal_name", "n", "mean", F.col("bar_idx").alias("pos"), F.sum(F.coalesce("excess", F.lit(0.0))).over(after).alias("rest"))
    return e.join(suffix, [*GROUP, "pos"]).groupBy(*GROUP, "draw", "signal_name").agg(
        (F.sum(F.col("w") * F.col("rest")) / F.first("n") - F.first("mean")).alias("draw_mean"))


def reality_check(excess: DataFrame, *, draws: int = 2000, seed: int = 7, exact_hash: bool = False
                  ) -> tuple[DataFrame, DataFrame]:
    """(one row per (symbol, tf), one p-value per strategy).

    V = max √n·mean; its p-value is the share of draws whose maximum reaches it; each strategy's
    own p-value comes from a second, independent set of draws.
    """
    means = strategy_means(excess)
    means = materialize(means.join(aligned(means), GROUP, "left_semi"), "rc-means")
    plan = block_length(excess, means)
    target = F.greatest(F.lit(2), F.bround("block")).cast("long")
    plan = plan.withColumn("_t", target).withColumn("_long", F.floor(F.col("n") / F.col("_t")) >= MIN_BLOCKS)
    plan = plan.withColumn("len", F.when(F.col("_long"), divisible_length(F.col("_t"), F.col("n"))).otherwise(F.col("_t")))
    plan = materialize(plan.withColumn("nb", F.floor(F.col("n") / F.col("len"))), "rc-plan")
    long, short = plan.filter("_long"), plan.filter("NOT _long")
    bm = materialize(block_means(excess, long, means), "rc-blocks")
    alt = stationary_draws(excess, means, short, draws=draws, seed=seed)
    first = block_draws(bm, long, draws=draws, seed=seed, exact_hash=exact_hash).unionByName(alt)
    second = block_draws(bm, long, draws=draws, seed=seed + 1, exact_hash=exact_hash).unionByName(alt)
    root = F.sqrt("n")
    v = means.groupBy(*GROUP).agg(F.max("mean").alias("_v"), F.count(F.lit(1)).alias("n_strategies"))
    peak = first.groupBy(*GROUP, "draw").agg(F.max("draw_mean").alias("_m")).join(v, GROUP)
    p = peak.groupBy(*GROUP).agg(F.avg((F.col("_m") >= F.col("_v")).cast("double")).alias("p_value"))
    top = (plan.join(v, GROUP).join(p, GROUP).select(
        *GROUP, "best_name", (root * F.col("best_mean")).alias("best_stat"), "p_value", "n_strategies",
        F.col("n").alias("n_obs"), F.col("block").alias("block_length")))
    each = second.join(means.select(*GROUP, "signal_name", "mean"), [*GROUP, "signal_name"]).groupBy(*GROUP, "signal_name").agg(
        F.avg((F.col("draw_mean") >= F.col("mean")).cast("double")).alias("p_value"))
    return top, each


# ------------------------------------------------------------------ trial log

TRIAL_KINDS = ("startup", "fixture_eval", "walkforward", "manual")


def trial_log(trials: DataFrame) -> DataFrame:
    """The log as it stands: the newest row per (config_hash, kind, fixture_set) replaces."""
    bad = F.when(~F.col("kind").isin(*TRIAL_KINDS), F.raise_error(F.concat(F.lit("unknown trial kind "), "kind")))
    t = trials.filter(F.coalesce(bad.cast("string"), F.lit("ok")) == "ok")
    keys = ["config_hash", "kind", "fixture_set"]
    rest = [c for c in trials.columns if c not in keys]
    order = F.struct("ts_ms", *(["id"] if "id" in trials.columns else []))
    return t.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def effective_trials(trials: DataFrame) -> DataFrame:
    return trials.agg(F.countDistinct("config_hash").alias("n"))


def trial_summary(trials: DataFrame) -> DataFrame:
    return trials.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ms").alias("first_ms"),
                                      F.max("ts_ms").alias("last_ms"), F.countDistinct("config_hash").alias("n_configs"))
