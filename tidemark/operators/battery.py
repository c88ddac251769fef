"""The validation battery, for any number of signals at once.

Convention: the position decided at bar i earns r[i] = ln(C[i+1]/C[i]). All five tests of all
signals are aggregates over one table of (signal, bar) rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.draws import fast_u32, u32
from tidemark.operators.bars import with_halo
from tidemark.operators.evaluate import effective_n, infer_bar_ms, out_of_sample
from tidemark.operators.panel import Panel, win
from tidemark.session import materialize

KEYS = ["signal_name", "symbol", "tf"]
COST_BPS = 15.0
YEAR_MS = 365.25 * 24 * 3600 * 1000


def bar_returns(panel: Panel, horizon: int = 1) -> DataFrame:
    """r[i] and the base-rate return fwd[i] = ln(C[i+h+1]/C[i+1]) per bar, keyed back to bar i."""
    back = lambda k: F.lag("close", k).over(win())
    df = panel.with_df(panel.df.withColumn("_r", F.ln(F.col("close") / back(1)))
                       .withColumn("_f", F.ln(F.col("close") / back(horizon)))).owned()
    r = df.filter("_r IS NOT NULL").select(
        "symbol", "tf", (F.col("bar_idx") - 1).alias("bar_idx"), F.col("_r").alias("r"), (F.col("n_bars") - 1).alias("n"))
    f = df.filter((F.col("bar_idx") >= horizon + 1) & F.col("_f").isNotNull()).select(
        "symbol", "tf", (F.col("bar_idx") - horizon - 1).alias("bar_idx"), F.col("_f").alias("fwd"))
    # fwd is only defined for i < n - h
    return r.join(f, ["symbol", "tf", "bar_idx"], "left").withColumn(
        "fwd", F.when(F.col("bar_idx") < F.col("n") - horizon, F.col("fwd")))


def battery_rows(signals: DataFrame, returns: DataFrame, panel: Panel, *, horizon: int = 1) -> DataFrame:
    """(signal, bar) rows with the position now, one and two bars ago, and across the OOS purge."""
    j = signals.drop("open_time_ms").join(returns, ["symbol", "tf", "bar_idx"])
    if panel.split:
        j = with_halo(j, "bar_idx", panel.chunk, max(2, horizon + 1))
    else:
        j = j.withColumn("ck", F.lit(0).cast("long"))
    w = W.partitionBy(*KEYS, "ck").orderBy("bar_idx")
    pos = F.col("position").cast("double")
    lag = lambda k: F.coalesce(F.lag(pos, k).over(w), F.lit(0.0))
    j = j.select("*", pos.alias("w0"), lag(1).alias("w1"), lag(2).alias("w2"), lag(horizon + 1).alias("wp"))
    if panel.split:
        j = j.filter(F.floor(F.col("bar_idx") / panel.chunk) == F.col("ck"))
    return j


def _cagr(log_eq: Column, n: Column, per_year: Column) -> Column:
    return F.exp(log_eq * per_year / n) - 1.0


def equity_curves(rows: DataFrame, panel: Panel, cost_bps: float = COST_BPS) -> DataFrame:
    """Log equity, equity, drawdown and buy-and-hold equity per (signal, bar).

    Prefix sums and running maxima are two-level where series are split: totals per chunk, a scan
    over the chunk table, and the scan inside the chunk.
    """
    x = F.col("r") * F.col("w0") - F.abs(F.col("w0") - F.col("w1")) * cost_bps / 10_000.0
    d = rows.withColumn("x", x)
    w = W.partitionBy(*KEYS, "ck").orderBy("bar_idx").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_s", F.sum("x").over(w)).withColumn("_b", F.sum("r").over(w))
    if panel.split:
        t = d.groupBy(*KEYS, "ck").agg(F.sum("x").alias("_ts"), F.sum("r").alias("_tb"),
                                       F.max("_s").alias("_ms"), F.max("_b").alias("_mb"))
        b = W.partitionBy(*KEYS).orderBy("ck").rowsBetween(W.unboundedPreceding, -1)
        t = t.withColumn("_os", F.coalesce(F.sum("_ts").over(b), F.lit(0.0))).withColumn(
            "_ob", F.coalesce(F.sum("_tb").over(b), F.lit(0.0)))
        t = t.select(*KEYS, "ck", "_os", "_ob", F.max(F.col("_os") + F.col("_ms")).over(b).alias("_ps"),
                     F.max(F.col("_ob") + F.col("_mb")).over(b).alias("_pb"))
        d = d.join(t, [*KEYS, "ck"]).withColumn("_s", F.col("_s") + F.col("_os")).withColumn(
            "_b", F.col("_b") + F.col("_ob"))
    else:
        none = F.lit(None).cast("double")
        d = d.withColumn("_ps", none).withColumn("_pb", none)
    peak = lambda c, p: F.greatest(F.max(c).over(w), F.col(p))
    return d.select(*KEYS, "bar_idx", "n", "r", "x", F.col("_s").alias("log_eq"), F.exp("_s").alias("equity"),
                    F.exp("_b").alias("equity_bh"), (F.exp(F.col("_s") - peak("_s", "_ps")) - 1.0).alias("drawdown"),
                    (F.exp(F.col("_b") - peak("_b", "_pb")) - 1.0).alias("drawdown_bh"))


def downsample_curve(curves: DataFrame, points: int = 600) -> DataFrame:
    """Every max(1, n/points)-th point."""
    step = F.greatest(F.lit(1), F.floor(F.col("n") / points))
    return curves.filter(F.pmod(F.col("bar_idx"), step) == 0)


def curve_stats(curves: DataFrame, bar_ms: DataFrame) -> DataFrame:
    """CAGR, Sharpe (the first return is dropped, population σ) and worst drawdown, own and held."""
    per = F.lit(YEAR_MS) / F.first("bar_ms")
    n = F.first("n")
    later = F.col("bar_idx") > 0
    sharpe = lambda c: F.when(F.stddev_pop(F.when(later, F.col(c))) > 0, F.avg(F.when(later, F.col(c)))
                              / F.stddev_pop(F.when(later, F.col(c))) * F.sqrt(per)).otherwise(0.0)
    return curves.join(bar_ms, ["symbol", "tf"]).groupBy(*KEYS).agg(
        n.alias("n"), _cagr(F.sum("x"), n, per).alias("cagr"), sharpe("x").alias("sharpe"),
        F.min("drawdown").alias("max_dd"), _cagr(F.sum("r"), n, per).alias("cagr_bh"),
        sharpe("r").alias("sharpe_bh"), F.min("drawdown_bh").alias("max_dd_bh"))


def delay_sweep(rows: DataFrame, bar_ms: DataFrame, delays=(0, 1, 2, 3), cost_bps: float = COST_BPS,
                panel: Panel | None = None) -> DataFrame:
    """CAGR of the positions executed 0, 1, 2, … bars late: an effect decays, a leak collapses."""
    w = W.partitionBy(*KEYS, "ck").orderBy("bar_idx")
    base = rows
    if panel is not None and panel.split:
        base = with_halo(rows.drop("ck"), "bar_idx", panel.chunk, max(delays) + 1)
    at = lambda k: F.coalesce(F.lag("w0", k).over(w), F.lit(0.0)) if k else F.col("w0")
    arr = F.array(*[F.struct(F.lit(k).alias("delay"), at(k).alias("p"), at(k + 1).alias("q")) for k in delays])
    d = base.withColumn("_d", arr)
    if panel is not None and panel.split:
        d = d.filter(F.floor(F.col("bar_idx") / panel.chunk) == F.col("ck"))
    d = d.select(*KEYS, "n", "r", F.explode("_d").alias("d")).join(bar_ms, ["symbol", "tf"])
    x = F.col("r") * F.col("d.p") - F.abs(F.col("d.p") - F.col("d.q")) * cost_bps / 10_000.0
    return d.groupBy(*KEYS, F.col("d.delay").alias("delay")).agg(
        _cagr(F.sum(x), F.first("n"), F.lit(YEAR_MS) / F.first("bar_ms")).alias("cagr"))


def battery_summary(rows: DataFrame, bar_ms: DataFrame, *, horizon: int = 1, cost_bps: float = COST_BPS,
                    folds: int = 5) -> DataFrame:
    """Every aggregate the tests need, in one pass per (signal, symbol, tf)."""
    c = cost_bps / 10_000.0
    cost = lambda a, b: F.abs(F.col(a) - F.col(b)) * c
    own, late = F.col("r") * F.col("w0") - cost("w0", "w1"), F.col("r") * F.col("w1") - cost("w1", "w2")
    i, n = F.col("bar_idx"), F.col("n")
    oos = out_of_sample(i, n, F.lit(horizon), folds)
    step = F.floor(n / folds)
    opens = i == F.floor(i / step) * step + horizon               # first bar of an OOS segment
    prev = F.when(opens, F.when(i < 2 * step, 0.0).otherwise(F.col("wp"))).otherwise(F.col("w1"))
    own_oos = F.col("r") * F.col("w0") - F.abs(F.col("w0") - prev) * c
    on = F.col("w0") != 0
    both = on & F.col("fwd").isNotNull()
    a = rows.groupBy(*KEYS).agg(
        F.first("n").alias("n"), F.count_if(on).alias("n_active"), F.avg(F.abs("w0")).alias("exposure"),
        F.sum(own).alias("_own"), F.sum(late).alias("_late"), F.sum("r").alias("_bh"),
        F.count_if(both).alias("_n_fwd"), F.avg(F.when(both, F.col("w0") * F.col("fwd"))).alias("_prop"),
        F.avg("fwd").alias("_base"), F.sum(F.abs(F.col("w0") - F.col("w1"))).alias("flips"),
        F.count_if(F.signum("w0") != F.signum("w1")).alias("_runs"),
        F.count_if(oos).alias("n_oos"), F.sum(F.when(oos, own_oos)).alias("_own_oos"),
        F.sum(F.when(oos, F.col("r"))).alias("_bh_oos"))
    a = a.join(bar_ms, ["symbol", "tf"]).withColumn("_py", F.lit(YEAR_MS) / F.col("bar_ms"))
    g = lambda s, m: _cagr(F.col(s), F.col(m), F.col("_py"))
    runs = F.greatest(F.lit(1), F.col("_runs"))
    return (a.withColumn("cagr", g("_own", "n")).withColumn("cagr_late", g("_late", "n")).withColumn("cagr_bh", g("_bh", "n"))
            .withColumn("cagr_oos", g("_own_oos", "n_oos")).withColumn("cagr_bh_oos", g("_bh_oos", "n_oos"))
            .withColumn("runs", runs)
            .withColumn("mean_duration", F.greatest(F.lit(horizon), F.bround(F.col("n_active") / runs)).cast("long"))
            .withColumn("prop", F.when(F.col("_n_fwd") >= 20, F.col("_prop")))
            .withColumn("base", F.coalesce("_base", F.lit(0.0)))
            .drop("_own", "_late", "_bh", "_n_fwd", "_prop", "_base", "_runs", "_own_oos", "_bh_oos"))


def random_control(summary: DataFrame, returns: DataFrame, *, draws: int = 250, seed: int = 11,
                   cost_bps: float = COST_BPS, exact_hash: bool = False) -> DataFrame:
    """CAGR of random long/flat paths with the same turnover and exposure, per draw.

    A path is a list of segments; its return is a difference of prefix sums at the segment ends.
    Segments with the same switch state and the per-segment cost are summed, so per draw only
    (segments) rows exist, never (bars) rows. Lengths and switches are hashes of (signal, symbol,
    tf, draw, segment).
    """
    k = [*KEYS]
    dur = F.greatest(F.lit(2), F.floor(F.col("n") / F.greatest(F.col("flips"), F.lit(1.0)))).cast("long")
    s = summary.select(*k, "n", "exposure", "_py", dur.alias("dur"))
    lo = F.greatest(F.lit(2), F.floor(F.col("dur") / 2))
    hi = F.greatest(F.lit(3), F.col("dur") * 2)
    s = s.withColumn("lo", lo).withColumn("span", hi - lo)
    s = s.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    seg = s.withColumn("seg", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("lo")).cast("int"))))
    ident = [F.col(c) for c in (*k, "draw", "seg")]
    rand = u32 if exact_hash else fast_u32
    seg = (seg.withColumn("len", F.col("lo") + F.pmod(rand(seed, *ident, F.lit("len")), F.col("span")))
           .withColumn("on", (rand(seed, *ident, F.lit("on")) / F.lit(4294967296.0) < F.col("exposure")).cast("double")))
    w = W.partitionBy(*k, "draw").orderBy("seg")
    seg = (seg.withColumn("end", F.sum("len").over(w.rowsBetween(W.unboundedPreceding, 0)))
           .withColumn("start", F.col("end") - F.col("len")).filter(F.col("start") < F.col("n"))
           .withColumn("flip", F.abs(F.col("on") - F.coalesce(F.lag("on").over(w), F.lit(0.0))))
           .withColumn("end", F.least("end", "n")))
    prefix = returns_prefix(returns)
    need = seg.filter("on = 1")
    at = lambda c: prefix.select("symbol", "tf", F.col("upto").alias(c), F.col("cum").alias(f"_{c}"))
    gain = (need.select(*k, "draw", "start", "end").join(at("start"), ["symbol", "tf", "start"])
            .join(at("end"), ["symbol", "tf", "end"])
            .groupBy(*k, "draw").agg(F.sum(F.col("_end") - F.col("_start")).alias("gain")))
    cost = seg.groupBy(*k, "draw").agg(F.sum("flip").alias("turn"), F.first("n").alias("n"), F.first("_py").alias("_py"))
    total = F.coalesce("gain", F.lit(0.0)) - F.col("turn") * cost_bps / 10_000.0
    return cost.join(gain, [*k, "draw"], "left").select(
        *k, "draw", _cagr(total, F.col("n"), F.col("_py")).alias("cagr"))


def returns_prefix(returns: DataFrame) -> DataFrame:
    """``cum`` = sum of r over the first ``upto`` bars, two-level."""
    b = returns.withColumn("_b", F.floor(F.col("bar_idx") / 4096))
    t = b.groupBy("symbol", "tf", "_b").agg(F.sum("r").alias("_t"))
    t = t.select("symbol", "tf", "_b", F.coalesce(F.sum("_t").over(W.partitionBy("symbol", "tf").orderBy("_b").rowsBetween(
        W.unboundedPreceding, -1)), F.lit(0.0)).alias("_o"))
    w = W.partitionBy("symbol", "tf", "_b").orderBy("bar_idx").rowsBetween(W.unboundedPreceding, 0)
    c = b.join(t, ["symbol", "tf", "_b"]).select(
        "symbol", "tf", (F.col("bar_idx") + 1).alias("upto"), (F.sum("r").over(w) + F.col("_o")).alias("cum"))
    zero = returns.select("symbol", "tf").distinct().select("symbol", "tf", F.lit(0).cast("long").alias("upto"), F.lit(0.0).alias("cum"))
    return c.unionByName(zero)


def battery_tests(rows: DataFrame, returns: DataFrame, panel: Panel, bar_ms: DataFrame, *, horizon: int = 1,
                  draws: int = 250, seed: int = 11, exact_hash: bool = False) -> tuple[DataFrame, DataFrame]:
    """(summary with verdict, one row per test). ``passed`` NULL means inconclusive."""
    s = materialize(battery_summary(rows, bar_ms, horizon=horizon), "summary")
    rc = random_control(s, returns, draws=draws, seed=seed, exact_hash=exact_hash).withColumnRenamed("cagr", "_rc")
    pct = rc.join(s.select(*KEYS, "cagr"), KEYS).groupBy(*KEYS).agg(
        F.avg((F.col("_rc") < F.col("cagr")).cast("double")).alias("percentile"))
    spans = (rows.filter("w0 <> 0").join(s.select(*KEYS, "mean_duration", "bar_ms"), KEYS)
             .join(panel.owned().select("symbol", "tf", "bar_idx", "open_time_ms"), ["symbol", "tf", "bar_idx"])
             .withColumn("_w", F.col("mean_duration") * F.col("bar_ms")))
    ne = effective_n(spans, KEYS, "_w", chunk=panel.chunk)
    s = (s.join(pct, KEYS).join(ne, KEYS, "left").withColumn("n_effective", F.coalesce("n_effective", F.lit(0))))
    exc, late = F.col("cagr") - F.col("cagr_bh"), F.col("cagr_late") - F.col("cagr_bh")
    out = F.col("cagr_oos") - F.col("cagr_bh_oos")
    some = F.abs(exc) > 1e-9
    t = lambda name, ok, value, ref: F.struct(F.lit(name).alias("test"), ok.cast("boolean").alias("passed"),
                                              value.cast("double").alias("value"), ref.cast("double").alias("reference"))
    tests = F.array(
        t("delay", F.when(some, late / exc >= 0.5).otherwise(True), F.col("cagr_late"), F.col("cagr")),
        t("base_rate", F.col("prop") > F.col("base"), F.coalesce(F.col("prop"), F.lit(0.0)) * 100, F.col("base") * 100),
        t("random_control", F.col("percentile") >= 0.95, F.col("percentile") * 100, F.lit(95.0)),
        t("out_of_sample", F.when((F.col("n_oos") > 100) & (exc > 0), F.when(some, out / exc >= 0.5).otherwise(True)),
          F.when(F.col("n_oos") > 100, F.col("cagr_oos")).otherwise(0.0),
          F.when(F.col("n_oos") > 100, F.col("cagr_bh_oos")).otherwise(0.0)),
        t("effective_n", F.col("n_effective") >= 30, F.col("n_effective"), F.lit(30.0)))
    s = s.withColumn("tests", tests)
    return battery_verdict(s), s.select(*KEYS, F.inline("tests"))


def battery_verdict(summary: DataFrame) -> DataFrame:
    """A failed delay test is look-ahead; two failures fail, one is doubtful; inconclusive is none."""
    failed = F.filter("tests", lambda x: x["passed"] == F.lit(False))
    leak = F.exists(failed, lambda x: x["test"] == "delay")
    n = F.size(failed)
    return summary.withColumn("verdict", F.when(leak, "lookahead").when(n >= 2, "fails").when(n == 1, "doubtful")
                              .otherwise("survives")).drop("tests", "_py")


def battery_gate(signals: DataFrame, panel: Panel, *, min_bars: int = 400, min_active: int = 30) -> DataFrame:
    """Signals refused before the battery and why (own-price series use min_bars=120)."""
    a = signals.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_bars"), F.count_if(F.col("position") != 0).alias("n_active"))
    return a.withColumn("refused", F.when(F.col("n_bars") < min_bars, "too_few_bars")
                        .when(F.col("n_active") < min_active, "too_few_active_bars"))


def run_battery(signals: DataFrame, panel: Panel, *, horizon: int = 1, draws: int = 250, seed: int = 11
                ) -> tuple[DataFrame, DataFrame]:
    """The whole battery for every gated signal of a signal table."""
    ok = battery_gate(signals, panel).filter("refused IS NULL").select(*KEYS)
    bar_ms = infer_bar_ms(panel.owned())
    returns = materialize(bar_returns(panel, horizon), "returns")
    rows = materialize(battery_rows(signals.join(ok, KEYS, "left_semi"), returns, panel, horizon=horizon), "battery")
    return battery_tests(rows, returns, panel, bar_ms, horizon=horizon, draws=draws, seed=seed)
