"""Wave candidates: rule-checked, scored readings of the last confirmed pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.pivots import SERIES, own_pivots, pivot_windows

MAX_FROM_EDGE = 3
TOP_N = 4
# Guideline weights, (centre, width) of the fits, archetype per number of points.
W_FIB2, W_FIB3, W_FIB4, W_ALT = 0.30, 0.30, 0.20, 0.20
FIT_W2, FIT_W3, FIT_W4 = (0.618, 0.18), ((1.618, 0.45), (2.618, 0.55)), (0.382, 0.15)
ALTERNATION = 0.30
STATES = {3: "impulse@2", 4: "impulse@3", 5: "impulse@4", 6: "impulse"}
ARCHETYPES = {3: "w2", 4: None, 5: "w4", 6: "abc"}
RETRACEMENTS = {"w2": (0.500, 0.786), "w4": (0.382, 0.500)}
EXTENSIONS = (1.000, 1.272, 1.618, 2.618)
EULER = 2.718281828459045


def fib_retracement(a: Column, b: Column, ratios) -> Column:
    return F.transform(F.array(*[F.lit(float(r)) for r in ratios]), lambda r: b - (b - a) * r)


def fib_projection(origin: Column, leg_a: Column, leg_b: Column, ratios=EXTENSIONS) -> Column:
    return F.transform(F.array(*[F.lit(float(r)) for r in ratios]), lambda r: origin + (leg_b - leg_a) * r)


def impulse_rules(p: Column, n: int, s: Column, allow_overlap: bool = False) -> Column:
    """Per-rule verdicts of n vertices; s is +1 for long, -1 for short."""
    def v(rule, ok, evaluable, price):
        return F.struct(F.lit(rule).alias("rule"), ok.alias("ok"), F.lit(evaluable).alias("evaluable"),
                        price.alias("invalidation_price"))
    yes = F.lit(True)
    leg = lambda a, b: F.abs(p[b] - p[a])
    r2b = s * p[3] > s * p[1] if n >= 4 else yes
    r3 = ((s * p[4] > s * p[1]) | F.lit(allow_overlap)) if n >= 5 else yes
    r2 = ~((leg(2, 3) < leg(0, 1)) & (leg(2, 3) < leg(4, 5))) if n == 6 else yes
    return F.array(v("R1", s * p[2] > s * p[0], True, p[0]), v("R2b", r2b, n >= 4, p[1]),
                   v("R3", r3, n >= 5, p[1]), v("R2", r2, n == 6, p[1]))


def rules_valid(verdicts: Column) -> Column:
    return F.forall(verdicts, lambda v: v["ok"] | ~v["evaluable"])


def invalidation(p: Column, n: int) -> tuple[Column, Column]:
    if n == 3:
        return p[0], F.lit("R1 (wave 2 past the start of wave 1)")
    return p[1], F.lit("R3 (wave 4 inside wave 1)")


def _fit(x: Column, mu: float, sigma: float) -> Column:
    return F.pow(F.lit(EULER), -0.5 * F.pow((x - mu) / sigma, 2.0))


def guideline_score(p: Column, n: int) -> tuple[Column, Column]:
    """(score in [0,1], fit values); weights are renormalised over what n vertices can show."""
    leg = lambda a, b: F.abs(p[b] - p[a])
    ratio = lambda a, b, base: F.when(base != 0, leg(a, b) / base)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    r2 = ratio(1, 2, leg(0, 1))
    parts, weight, none = W_FIB2 * zero(_fit(r2, *FIT_W2)), W_FIB2, F.lit(None).cast("double")
    e3 = r4 = alt = none
    if n >= 4:
        e3 = ratio(2, 3, leg(0, 1))
        parts, weight = parts + W_FIB3 * zero(F.greatest(*[_fit(e3, *f) for f in FIT_W3])), weight + W_FIB3
    if n >= 5:
        r4 = ratio(3, 4, leg(2, 3))
        alt = F.abs(r2 - r4)
        parts = parts + W_FIB4 * zero(_fit(r4, *FIT_W4)) + W_ALT * zero(F.least(F.lit(1.0), alt / ALTERNATION))
        weight = weight + W_FIB4 + W_ALT
    fit = F.struct(r2.alias("retr_w2"), e3.alias("ext_w3"), r4.alias("retr_w4"), alt.alias("alternation"))
    return parts / F.lit(weight), fit


def _candidate(last: Column, n: int, back: int, allow_overlap: bool) -> Column:
    """The n vertices ending ``back`` pivots before the edge, or NULL where a rule is broken."""
    start = F.size(last) - back - n + 1
    seq = F.slice(last, start, n)
    p = F.transform(seq, lambda x: x["price"])
    s = -seq[0]["kind"].cast("int")                    # first vertex a low (-1): long
    verdicts = impulse_rules(p, n, s, allow_overlap)
    score, fit = guideline_score(p, n)
    price, rule = invalidation(p, n)
    truncated = (s * p[5] <= s * p[3]) if n == 6 else F.lit(False)
    c = F.struct((-score).alias("neg_score"), F.lit(-n).alias("neg_n"), F.lit(back).alias("back"),
                 F.lit(STATES[n]).alias("state"), s.alias("direction"), p.alias("points"),
                 F.transform(seq, lambda x: x["ts_ms"]).alias("pivot_ts"), fit.alias("fit"),
                 price.alias("invalidation_price"), rule.alias("invalidation_rule"),
                 F.lit(ARCHETYPES[n]).cast("string").alias("archetype"), truncated.alias("truncated"))
    return F.when(F.size(last) >= back + n, F.when(rules_valid(verdicts), c))


def best_candidates(last: Column, allow_overlap: bool = False, top_n: int = TOP_N) -> Column:
    """The best readings of up to nine pivots, oldest first: right-anchored, at most 16 (length, end) pairs."""
    pool = F.array_compact(F.array(*[_candidate(last, n, b, allow_overlap)
                                     for n in STATES for b in range(MAX_FROM_EDGE + 1)]))
    return F.slice(F.array_sort(pool), 1, top_n)


def unpack(ranked: DataFrame, *keep: str) -> DataFrame:
    """Columns of exploded candidates ``(rank from 0, c)``."""
    return ranked.select(*keep, (F.col("rank") + 1).alias("rank"),
                         (-F.col("c.neg_score")).alias("score"), (-F.col("c.neg_n")).alias("n_points"),
                         *[f"c.{k}" for k in ("back", "state", "direction", "points", "pivot_ts", "fit",
                                              "invalidation_price", "invalidation_rule", "archetype",
                                              "truncated")])


def wave_candidates(pivots: DataFrame, *, allow_overlap: bool = False, top_n: int = TOP_N) -> DataFrame:
    """The ranked candidates known from each pivot confirmation on.

    Right-anchored: at most 16 (length, end) pairs over the last nine pivots, checked, sorted and
    cut inside the row. Nothing is joined and nothing is shuffled beyond the pivot order.
    """
    p, w = pivot_windows(pivots, 8)
    p = own_pivots(p.withColumn("last", F.collect_list(F.struct("price", "kind", "ts_ms")).over(
        w.rowsBetween(-8, 0))))
    out = p.select(*SERIES, F.col("pivot_no").alias("edge_no"), F.col("confirmed_idx"),
                   F.col("confirmed_ts_ms").alias("available_at_ms"), F.posexplode(best_candidates(F.col("last"), allow_overlap, top_n)).alias("rank", "c"))
    return unpack(out, *SERIES, "edge_no", "confirmed_idx", "available_at_ms")
