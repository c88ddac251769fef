"""Splitting a series into chunks must change nothing: windows, scans, carries and folds."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import walk
from tidemark.operators.bars import dense_bar_index
from tidemark.operators.panel import build_panel
from tidemark.operators.pivots import confirmed_pivots, zigzag_states
from tidemark.operators.signals import signal_positions
from tidemark.session import materialize


@pytest.fixture(scope="module")
def bars(spark):
    pdf = pd.concat([walk(9_000, "1h", 3, "A"), walk(8_700, "1d", 4, "A", sigma=0.02, t0=0)])
    return materialize(dense_bar_index(spark.createDataFrame(pdf)), "t")


@pytest.fixture(scope="module")
def panels(bars):
    whole = build_panel(bars, indexed=True, stored=True)
    parts = build_panel(bars, indexed=True, stored=True, chunk=4096, halo=4096)
    assert not whole.split and parts.split
    return whole, parts


def test_all_signals_do_not_depend_on_chunks(panels):
    a, b = (materialize(signal_positions(p), "sig") for p in panels)
    assert a.count() == b.count() > 1_000_000
    keys = ["signal_name", "symbol", "tf", "bar_idx"]
    bad = (a.join(b.withColumnRenamed("position", "other").drop("open_time_ms"), keys, "full")
           .filter(~F.col("position").eqNullSafe(F.col("other"))).groupBy("signal_name").count().collect())
    # values that sit on a threshold up to the last bit may fall on either side
    assert sum(r["count"] for r in bad) <= 3, bad


def test_pivots_do_not_depend_on_chunks(panels):
    a, b = (confirmed_pivots(materialize(zigzag_states(p), "zz")) for p in panels)
    cols = ["symbol", "tf", "idx", "kind", "confirmed_idx", "pivot_no"]
    assert a.count() == b.count() > 1_000
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0


def test_pivot_events_are_the_states(bars, panels):
    from tidemark.operators.pivots import Variant, pivot_events, provisional_pivots
    variants = (Variant("close", 1.0, 0.001, True), Variant(), Variant("wide", 4.0, 0.02))
    states = materialize(zigzag_states(panels[0], variants), "zz")
    want = confirmed_pivots(states).select("symbol", "tf", "variant", "idx", "ts_ms", "price", "kind", "confirmed_idx", "pivot_no")
    tail = sorted((r.symbol, r.tf, r.variant, r.idx, r.kind, round(r.confirm_price, 6)) for r in provisional_pivots(states).collect())
    # the last panel's halo is so short that most chunks guess a wrong start and run again
    for p in (*panels, build_panel(bars, indexed=True, stored=True, chunk=1024, halo=512)):
        events, ends = pivot_events(p, variants)
        got = confirmed_pivots(events).select(*want.columns)
        assert want.exceptAll(got).count() == 0 and got.count() == want.count() > 5_000
        assert sorted((r.symbol, r.tf, r.variant, r.idx, r.kind, round(r.confirm_price, 6)) for r in ends.collect()) == tail


def test_running_totals_are_exact_across_chunks(panels):
    from tidemark.operators.indicators import running_totals
    a, b = (running_totals(p) for p in panels)
    j = a.join(b.select("symbol", "tf", "bar_idx", F.col("obv").alias("o2"), F.col("nvi").alias("n2")), ["symbol", "tf", "bar_idx"])
    worst = j.agg(F.max(F.abs(F.col("obv") - F.col("o2"))), F.max(F.abs(F.col("nvi") / F.col("n2") - 1)), F.count("*")).first()
    assert worst[0] < 1e-5 and worst[1] < 1e-9 and worst[2] == 17_700


def test_battery_does_not_depend_on_chunks(panels):
    from tidemark.operators import battery as B
    from tidemark.operators.evaluate import infer_bar_ms
    out = []
    for p in panels:
        sig = signal_positions(p, ["momentum.roc10", "trend.macd_12_26_9"])
        ret = B.bar_returns(p)
        rows = materialize(B.battery_rows(sig, ret, p), "b")
        ms = infer_bar_ms(p.owned())
        s = B.battery_summary(rows, ms)
        d = B.curve_stats(B.equity_curves(rows, p), ms)
        out.append((s.orderBy("signal_name", "tf").toPandas(), d.orderBy("signal_name", "tf").toPandas()))
    for a, b in zip(*out):
        pd.testing.assert_frame_equal(a, b, rtol=1e-9)
