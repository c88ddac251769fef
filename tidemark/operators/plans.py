"""Trade plans from candidates, and the decision of every closed trigger bar."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.bars import number_rows
from tidemark.operators.candidates import RETRACEMENTS
from tidemark.operators.panel import Panel
from tidemark.operators.pivots import SERIES


@dataclass(frozen=True)
class PlanConfig:
    stop_buffer_atr: float = 0.25
    stop_buffer_pct: float = 0.001
    tick_size: float = 0.01
    max_stop_atr: float = 3.0
    min_stop_atr: float = 0.75
    fee_bps: float = 7.5
    max_cost_r: float = 0.20
    ev_min_r: float = 0.15
    expected_loss_r: float = 1.10
    exit_template: str = "std_2r_48b"

    def __post_init__(self):
        if self.min_stop_atr > self.max_stop_atr:
            raise ValueError("min_stop_atr above max_stop_atr: every stop would be refused")
        if self.max_cost_r <= 0 or self.fee_bps < 0 or self.tick_size <= 0:
            raise ValueError("max_cost_r and tick_size must be positive, fee_bps not negative")


def required_hit_rate(rr: Column, cost_r: Column, cfg: PlanConfig = PlanConfig()) -> Column:
    return (cfg.expected_loss_r + cost_r + cfg.ev_min_r) / (rr + cfg.expected_loss_r)


# Reasons of refusal, in the order they are tested.
NO_ENTRY, EMPTY_ZONE, ON_STOP, PAST_STOP = "state offers no entry", "entry zone is empty", "entry is the stop", "price past the stop"
NO_RANGE, NOISE, FEES = "no range", "stop inside noise floor", "fees take too much of R"
CUT, OUTSIDE = "size cut", "price outside the zone"


def build_plans(df: DataFrame, cfg: PlanConfig = PlanConfig()) -> DataFrame:
    """Plan columns for rows that carry a candidate, ``price`` and ``atr``.

    The first refusal that applies is the reason; the arithmetic known by then is kept.
    """
    p, s, price, atr = F.col("points"), F.col("direction"), F.col("price"), F.col("atr")
    w4 = F.col("archetype") == "w4"
    z = lambda a, b, r: b - (b - a) * F.lit(r)
    a, b = F.when(w4, p[2]).otherwise(p[0]), F.when(w4, p[3]).otherwise(p[1])
    near = F.when(w4, z(a, b, RETRACEMENTS["w4"][0])).otherwise(z(a, b, RETRACEMENTS["w2"][0]))
    far = F.when(w4, z(a, b, RETRACEMENTS["w4"][1])).otherwise(z(a, b, RETRACEMENTS["w2"][1]))
    lo, hi = F.least(near, far), F.greatest(near, far)
    lo = F.when(w4 & (s > 0), F.greatest(lo, p[1] * 1.0005)).otherwise(lo)
    hi = F.when(w4 & (s < 0), F.least(hi, p[1] * 0.9995)).otherwise(hi)
    leg = p[1] - p[0]
    base = F.when(w4, p[4]).otherwise(p[2])
    df = (df.withColumn("zone_lo", lo).withColumn("zone_hi", hi)
          .withColumn("targets", F.when(w4, F.array(base + leg, base + (p[3] - p[0]) * 0.618, base + leg * 1.618))
                      .otherwise(F.array(base + leg, base + leg * 1.618, base + leg * 2.618)))
          .withColumn("stop", F.col("invalidation_price") - s * F.greatest(
              cfg.stop_buffer_atr * atr, F.lit(2 * cfg.tick_size), cfg.stop_buffer_pct * price)))
    df = df.withColumn("risk", F.abs(price - F.col("stop")))
    stop, risk, t2 = F.col("stop"), F.col("risk"), F.col("targets")[1]
    early = (F.when(F.col("archetype").isNull() | ~F.col("archetype").isin("w2", "w4"), NO_ENTRY)
             .when(F.col("zone_lo") >= F.col("zone_hi"), EMPTY_ZONE)
             .when(risk <= 0, ON_STOP)
             .when(s * (price - stop) <= 0, PAST_STOP)
             .when(atr <= 0, NO_RANGE))
    df = df.withColumn("_early", early)
    known = F.col("_early").isNull()
    mid = (F.col("zone_lo") + F.col("zone_hi")) / 2.0
    rim = F.when(s > 0, F.col("zone_lo")).otherwise(F.col("zone_hi"))
    calc = lambda c: F.when(known, c).otherwise(0.0)
    df = (df.withColumn("stop_atr", calc(risk / atr))
          .withColumn("cost_r", calc((2 * cfg.fee_bps / 10_000) * price / risk))
          .withColumn("rr_t2", calc(F.abs(t2 - price) / risk))
          .withColumn("rr_in_zone", calc(F.when(s * (rim - stop) > 0, F.abs(t2 - mid) / (s * (mid - stop)))
                                         .otherwise(0.0))))
    wide = known & (F.col("stop_atr") > cfg.max_stop_atr)
    noise = known & (F.col("stop_atr") < cfg.min_stop_atr)
    fees = known & ~noise & (F.col("cost_r") > cfg.max_cost_r)
    viable = known & ~noise & ~fees
    inside = price.between(F.col("zone_lo"), F.col("zone_hi"))
    reasons = (F.when(~known, F.array(F.col("_early"))).when(noise, F.array(F.lit(NOISE)))
               .when(fees, F.array(F.lit(FEES)))
               .otherwise(F.array_compact(F.array(F.when(wide, F.lit(CUT)), F.when(~inside, F.lit(OUTSIDE))))))
    out = (df.withColumn("p_required", calc(required_hit_rate(F.col("rr_t2"), F.col("cost_r"), cfg)))
           .withColumn("size_factor", F.when(wide & ~noise, cfg.max_stop_atr / F.col("stop_atr")).otherwise(1.0))
           .withColumn("viable", viable).withColumn("in_zone", viable & inside).withColumn("reasons", reasons))
    return out.drop("_early", "risk")


def decision_inputs(states: DataFrame, candidates: DataFrame, panel: Panel, *,
                    trigger_tf: str | None = None) -> DataFrame:
    """Each closed trigger bar with the candidates known at its close (rank NULL: none).

    The number of confirmed pivots is carried forward over the bars, so the as-of join is an equi
    join on it.
    """
    st = states.filter(F.col("tf") == trigger_tf) if trigger_tf else states
    piv = st.filter("p_kind IS NOT NULL").select(*SERIES, "bar_idx")
    piv = number_rows(piv, SERIES, "bar_idx", F.floor(F.col("bar_idx") / 4096), "edge_no")
    seq = st.select(*SERIES, "bar_idx", "n_bars", "open_time_ms", "close", "atr").join(
        piv.withColumnRenamed("edge_no", "_e"), [*SERIES, "bar_idx"], "left")
    if panel.split:
        # confirmed count before each 4096-bar bucket, plus the running one inside it
        b = seq.withColumn("_b", F.floor(F.col("bar_idx") / 4096))
        tot = b.groupBy(*SERIES, "_b").agg(F.max("_e").alias("_m"))
        tot = tot.select(*SERIES, "_b", F.max("_m").over(
            W.partitionBy(*SERIES).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_pre"))
        inner = W.partitionBy(*SERIES, "_b").orderBy("bar_idx").rowsBetween(W.unboundedPreceding, 0)
        seq = b.join(tot, [*SERIES, "_b"]).withColumn(
            "edge_no", F.coalesce(F.max("_e").over(inner), F.col("_pre"))).drop("_b", "_pre", "_e")
    else:
        inner = W.partitionBy(*SERIES).orderBy("bar_idx").rowsBetween(W.unboundedPreceding, 0)
        seq = seq.withColumn("edge_no", F.max("_e").over(inner)).drop("_e")
    cand = candidates.drop("confirmed_idx", "available_at_ms")
    return (seq.withColumn("price", F.col("close")).join(cand, [*SERIES, "edge_no"], "left"))


def decision_plans(states: DataFrame, candidates: DataFrame, panel: Panel,
                   cfg: PlanConfig = PlanConfig(), **kw) -> DataFrame:
    """One row per (trigger bar, known candidate) with its plan or refusal."""
    return build_plans(decision_inputs(states, candidates, panel, **kw).filter("rank IS NOT NULL"), cfg)


def decisions(states: DataFrame, plans: DataFrame) -> DataFrame:
    """One verdict per closed trigger bar. Capped at WATCH: no evidence of its own exists yet."""
    per_bar = plans.groupBy(*SERIES, "bar_idx").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.max(F.col("in_zone").cast("int")).alias("_z"),
        F.sort_array(F.collect_list(F.struct("rank", "state", "direction", "score", "viable", "in_zone"))
                     ).alias("candidates"))              # at most four per bar
    j = states.select(*SERIES, "bar_idx", "open_time_ms", "close", "atr").join(
        per_bar, [*SERIES, "bar_idx"], "left")
    some = F.col("n_candidates").isNotNull()
    return j.select(
        *SERIES, "bar_idx", "open_time_ms", F.col("close").alias("price"), "atr",
        F.when(some, "WATCH").otherwise("NO_TRADE").alias("verdict"),
        F.lit(0).alias("maturity"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        F.when(F.col("atr").isNull(), "not enough structure yet")
        .when(~some, "no structure satisfies the rules").when(F.col("_z") == 0, "no price inside an entry zone")
        .otherwise("inside an entry zone").alias("reason"), "candidates")


def decision_violations(dec: DataFrame) -> DataFrame:
    """ACTIONABLE needs a viable plan, live data and evidence beyond the prior."""
    viable = F.exists(F.coalesce("candidates", F.array()), lambda c: c["viable"])
    catching = F.col("catching_up") if "catching_up" in dec.columns else F.lit(False)
    why = (F.when(~viable, "no_plan").when(catching, "catching_up").when(F.col("maturity") == 0, "prior_only"))
    return dec.filter(F.col("verdict") == "ACTIONABLE").withColumn("violation", why).filter("violation IS NOT NULL")
