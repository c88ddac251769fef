"""Positions of any set of signals over a panel, in long form."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.folds import run_folds
from tidemark.operators.indicators import compute
from tidemark.operators.panel import Panel
from tidemark.signals.registry import Signal, catalogue

COLUMNS = ("signal_name", "symbol", "tf", "bar_idx", "open_time_ms", "position")


def _melt(df: DataFrame, signals: Iterable[Signal]) -> DataFrame:
    """One row per (signal, bar) the signal is declared for."""
    def entry(s: Signal):
        live = (F.col("bar_idx") >= s.warmup) & (F.col("n_bars") >= s.min_bars)
        pos = F.when(live, F.coalesce(s.expr(), F.lit(0))).otherwise(0)
        return F.when(F.col("tf").isin(*s.timeframes), F.struct(
            F.lit(s.name).alias("signal_name"), pos.cast("byte").alias("position")))
    arr = F.array_compact(F.array(*[entry(s) for s in signals]))
    return (df.select("symbol", "tf", "bar_idx", "open_time_ms", F.explode(arr).alias("s"))
            .select("s.signal_name", "symbol", "tf", "bar_idx", "open_time_ms", "s.position"))


def signal_positions(panel: Panel, names: Iterable[str] | None = None) -> DataFrame:
    """``signals(signal_name, symbol, tf, bar_idx, open_time_ms, position)``.

    All column-expression signals come from one pass over one exchange. Signals that need a
    sequential machine share a second pass that carries only their input columns to Python.
    Series of timeframes none of the signals is declared for are filtered before the shuffle.
    """
    cat = catalogue()
    chosen = [cat[n] for n in (names if names is not None else cat)]
    tfs = sorted({t for s in chosen for t in s.timeframes})
    panel = panel.with_df(panel.df.filter(F.col("tf").isin(*tfs)))
    parts = []
    plain = [s for s in chosen if s.fold is None]
    if plain:
        p = compute(panel, [d for s in plain for d in s.deps])
        parts.append(_melt(p.owned(), plain))
    seq = [s for s in chosen if s.fold is not None]
    if seq:
        p = compute(panel, [d for s in seq for d in s.deps])
        folds = list({s.fold.name: s.fold for s in seq}.values())
        keep = ["open_time_ms", "n_bars"] + (["close"] if any(f.name == "sar" for f in folds) else [])
        out = run_folds(p.df, folds, series=("symbol", "tf"), order="bar_idx", chunk=p.chunk,
                        split=p.split, keep=keep)
        parts.append(_melt(out, seq))
    df = parts[0]
    for x in parts[1:]:
        df = df.unionByName(x)
    return df.select(*COLUMNS)
