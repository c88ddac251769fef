"""Halos are derived from what is asked: however long the lookback, chunks must change nothing."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import walk
from tidemark.functions import features as X
from tidemark.operators.bars import dense_bar_index
from tidemark.operators.indicators import indicators, reaching, served
from tidemark.operators.panel import MAX_HALO, Panel, build_panel
from tidemark.operators.signals import signal_positions
from tidemark.session import materialize
from tidemark.signals.registry import catalogue

N = 18_000


@pytest.fixture(scope="module")
def panels(spark):
    bars = materialize(dense_bar_index(spark.createDataFrame(walk(N, "1h", 11, "A"))), "t")
    whole = build_panel(bars, indexed=True, stored=True)
    parts = build_panel(bars, indexed=True, stored=True, chunk=4_096, halo=512)
    assert not whole.split and parts.split
    return whole, parts


def _needed(features) -> int:
    halo = 512
    while not served(Panel(None, 4_096, halo, True), features):
        halo *= 2
    return halo


def test_long_lookbacks_equal_those_of_a_whole_series(panels):
    wanted = {"sma3000": X.sma(X.CLOSE, 3_000), "sma9000": X.sma(X.CLOSE, 9_000), "sum700": X.rsum(X.VOLUME, 700), "max2500": X.rmax(X.HIGH, 2_500),
              "min777": X.rmin(X.LOW, 777, 5), "ema900": X.ema(X.CLOSE, 900), "nested": X.ema(X.ema(X.CLOSE, 300), 300, 299), "atr500": X.atr(500),
              "kama": X.kama(), "std600": X.std(X.CLOSE, 600), "hold": X.hold(X.row("_ev", [X.FR_HI], lambda: F.when(X.FR_HI.c.isNotNull(), 1).otherwise(0)))}
    a, b = (indicators(p, wanted) for p in panels)
    j = a.join(b.select("symbol", "tf", "bar_idx", *[F.col(k).alias(f"o_{k}") for k in wanted]), ["symbol", "tf", "bar_idx"])
    far = {k: ~(F.col(k).eqNullSafe(F.col(f"o_{k}")) | F.coalesce(F.abs(F.col(k) - F.col(f"o_{k}")) <= 1e-11 * F.abs(F.col(k)), F.lit(False))) for k in wanted}
    got = j.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(k) for k, c in far.items()], *[F.count(F.col(k)).alias(f"n_{k}") for k in wanted]).first().asDict()
    assert got["rows"] == N and all(got[k] == 0 for k in wanted), got
    assert got["n_sma9000"] == N - 8_999 and got["n_max2500"] == N - 2_499


def test_signals_of_each_halo_equal_those_of_a_whole_series(panels):
    """Every group gets no more halo than its own features say, so a span that is missing somewhere would show."""
    groups: dict[int, list[str]] = {}
    for name, s in catalogue().items():
        if "1h" in s.timeframes:
            groups.setdefault(_needed(s.deps), []).append(name)
    assert len(groups) >= 3
    for names in groups.values():
        a, b = (signal_positions(p, names) for p in panels)
        j = a.join(b.withColumnRenamed("position", "other").drop("open_time_ms"), ["signal_name", "symbol", "tf", "bar_idx"], "full")
        bad = j.filter(~F.col("position").eqNullSafe(F.col("other"))).groupBy("signal_name").count().collect()
        assert not bad, bad


def test_extremes_by_halves_equal_windows(panels):
    wanted = {f"m{n}_{skip}": X.rmax(X.HIGH, n, skip) for n in (33, 64, 65, 127, 500) for skip in (0, 1, 7)}
    got = indicators(panels[1], {**wanted, "high": X.HIGH}).orderBy("bar_idx").toPandas()
    for n in (33, 64, 65, 127, 500):
        for skip in (0, 1, 7):
            want = got["high"].rolling(n).max().shift(skip)
            assert got[f"m{n}_{skip}"].equals(want), (n, skip)


def test_halo_is_no_longer_than_needed_and_refused_when_absurd(panels):
    whole, parts = panels
    assert reaching(parts, [X.sma(X.CLOSE, 20)]).halo == 2_048 and reaching(parts, [X.lag(X.CLOSE, 3)]) is parts
    assert reaching(whole, [X.sma(X.CLOSE, 5_000_000)]) is whole
    with pytest.raises(ValueError, match="lookback"):
        reaching(parts, [X.lag(X.CLOSE, MAX_HALO + 1)])
