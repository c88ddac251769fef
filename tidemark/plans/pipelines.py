"""End-to-end jobs: study, decisions, backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import candidates as C
from tidemark.operators import evaluate as E
from tidemark.operators import multiple as M
from tidemark.operators import outcomes as O
from tidemark.operators import pivots as P
from tidemark.operators import plans as T
from tidemark.operators.panel import Panel, build_panel
from tidemark.operators.signals import signal_positions
from tidemark.session import materialize


def study(panel: Panel, names=None, *, draws: int = 2000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(evaluation, reality check, p-value per strategy). The signal table is written once: it is
    the boundary between computing positions and everything that is asked about them."""
    sig = materialize(signal_positions(panel, names), "signals")
    fwd = materialize(E.forward_returns(panel), "forward")
    ev = E.evaluate_signals(sig, fwd, panel)
    kept = ev.select("signal_name", "symbol", "tf")
    ex = materialize(E.excess_returns(sig, fwd).join(kept, ["signal_name", "symbol", "tf"], "left_semi"), "excess")
    top, each = M.reality_check(ex, draws=draws)
    return ev, top, each


def decide(bars: DataFrame, cfg: T.PlanConfig = T.PlanConfig()) -> tuple[DataFrame, DataFrame]:
    """(one decision per bar, one plan per bar and candidate)."""
    panel = build_panel(bars)
    states = materialize(P.zigzag_states(panel), "zigzag")
    cand = C.wave_candidates(P.confirmed_pivots(states))
    plans = materialize(T.decision_plans(states, cand, panel, cfg), "plans")
    return T.decisions(states, plans), plans


def backtest(panel: Panel, bars: DataFrame, *, max_bars: int = 48, cooldown: int = 6, min_score: float = 0.0,
             seed: int = 17, fine: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(resolved trades with their control arm, statistics per cost multiplier)."""
    states = materialize(P.zigzag_states(panel), "zigzag")
    cand = C.wave_candidates(P.confirmed_pivots(states))
    plans = materialize(T.decision_plans(states, cand, panel), "plans")
    sig = O.trade_signals(plans, panel, min_score=min_score, cooldown=cooldown).withColumn(
        "entry_id", F.concat_ws(":", "symbol", "tf", "variant", "archetype", "bar_idx"))
    sig = materialize(sig, "entries")
    out = materialize(O.resolve_with_control(sig, bars, max_bars=max_bars, seed=seed, fine=fine), "outcomes")
    return out, O.backtest_stats(out)
