"""The signal registry: every signal is declared, with its reason and prior, before it is run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession

from tidemark.functions.clock import TF_MS
from tidemark.functions.features import Feature
from tidemark.operators.folds import Fold


@dataclass(frozen=True)
class Signal:
    name: str
    title: str
    rationale: str
    prior: str
    timeframes: tuple[str, ...]
    warmup: int
    deps: tuple[Feature, ...]
    expr: Callable[[], Column]
    min_bars: int = 0
    fold: Fold | None = None

    @property
    def family(self) -> str:
        return self.name.split(".", 1)[0]


REGISTRY: dict[str, Signal] = {}


def register(s: Signal) -> Signal:
    if s.name in REGISTRY:
        raise ValueError(f"duplicate signal: {s.name}")
    for what in ("title", "rationale", "prior"):
        if not getattr(s, what).strip():
            raise ValueError(f"{s.name}: {what} must be stated before the signal is run")
    if any(tf not in TF_MS for tf in s.timeframes):
        raise ValueError(f"{s.name}: unknown timeframe in {s.timeframes}")
    REGISTRY[s.name] = s
    return s


def sig(name: str, tfs: str, warmup: int, deps, expr, title: str, rationale: str,
        prior: str = "no edge expected after costs", **kw) -> Signal:
    return register(Signal(name, title, rationale, prior, tuple(tfs.split("/")), warmup,
                           tuple(deps), expr, **kw))


def catalogue() -> dict[str, Signal]:
    """All registered signals (imports the families once)."""
    from tidemark.signals import (candles, flow, mean_reversion, momentum,  # noqa: F401
                                  seasonality, structure, trend, volatility)
    return dict(sorted(REGISTRY.items(), key=lambda kv: (kv[1].family, kv[0])))


def signal_catalog(spark: SparkSession) -> DataFrame:
    """The catalogue as a dimension table, ordered by (family, name)."""
    rows = [(i, s.family, s.name, s.title, s.rationale, s.prior, list(s.timeframes), s.warmup)
            for i, s in enumerate(catalogue().values())]
    return spark.createDataFrame(rows, "pos int, family string, signal_name string, title string, "
                                 "rationale string, prior string, timeframes array<string>, "
                                 "min_warmup int")
