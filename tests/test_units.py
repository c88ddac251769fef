"""Small frames with answers worked out by hand, and the refusals."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import walk
from tidemark.functions import features as X
from tidemark.functions import rules as R
from tidemark.operators.bars import fill_grid, resample_bars, validate_bars
from tidemark.operators.indicators import indicators
from tidemark.operators.panel import build_panel


def panel_of(spark, pdf):
    return build_panel(spark.createDataFrame(pdf))


def test_resample_open_close_volume_and_gap(spark):
    t0 = 1_600_000_200_000 - 1_600_000_200_000 % 900_000
    rows = [("S", t0 + i * 60_000, 10.0 + i, 11.0 + i, 9.0 + i, 10.5 + i, 1.0) for i in (0, 1, 2, 14)]
    m = spark.createDataFrame(rows, "symbol string, open_time_ms long, open double, high double, low double, close double, volume double")
    r = resample_bars(m, ["15m"]).first()
    assert (r.open, r.high, r.low, r.close, r.volume, r.n_source_bars, r.is_gap) == (10.0, 25.0, 9.0, 24.5, 4.0, 4, True)
    assert r.close_time_ms == t0 + 900_000 - 1
    # the threshold truncates: 13 of 15 minutes are enough at 90%
    full = spark.createDataFrame([("S", t0 + i * 60_000, 1.0, 1.0, 1.0, 1.0, 1.0) for i in range(13)], m.schema)
    assert resample_bars(full, ["15m"]).first().is_gap is False


def test_strict_validation_fails_the_job(spark):
    pdf = walk(5)
    pdf.loc[2, "high"] = 0.0
    with pytest.raises(Exception, match="bad bar"):
        validate_bars(spark.createDataFrame(pdf), strict=True).collect()


def test_fill_grid_restores_every_dropped_bar(spark):
    full, holes = walk(300), walk(300, drop=[5, 6, 7, 100, 250])
    got = fill_grid(spark.createDataFrame(holes)).orderBy("open_time_ms").toPandas()
    assert got["open_time_ms"].tolist() == full["open_time_ms"].tolist()
    assert got.index[got["is_gap"]].tolist() == [5, 6, 7, 100, 250]


def sequential_ema(x, n):
    y = np.full(len(x), np.nan)
    y[n - 1] = x[:n].mean()
    for i in range(n, len(x)):
        y[i] = y[i - 1] + 2 / (n + 1) * (x[i] - y[i - 1])
    return y


def test_affine_scan_equals_the_loop(spark):
    pdf = walk(3_000)
    d = indicators(panel_of(spark, pdf), {"a": X.ema(X.CLOSE, 3), "b": X.ema(X.CLOSE, 200), "t": X.atr(14)}).orderBy("bar_idx").toPandas()
    c, h, l = (pdf[k].to_numpy() for k in ("close", "high", "low"))
    for col, n in (("a", 3), ("b", 200)):
        np.testing.assert_allclose(d[col].to_numpy(dtype=float), sequential_ema(c, n), rtol=1e-12)
    tr = np.maximum(h[1:] - l[1:], np.maximum(abs(h[1:] - c[:-1]), abs(l[1:] - c[:-1])))
    atr = np.full(len(c), np.nan)
    atr[14] = tr[:14].mean()
    for i in range(15, len(c)):
        atr[i] = (atr[i - 1] * 13 + tr[i - 1]) / 14
    np.testing.assert_allclose(d["t"].to_numpy(dtype=float), atr, rtol=1e-12)


def test_flat_and_short_series_give_no_undefined_positions(spark):
    from tidemark.operators.signals import signal_positions
    pdf = pd.concat([walk(700, "1h", flat=True, symbol="F"), walk(60, "1h", symbol="short")])
    names = ["trend.ema_cross_21_55", "mean_reversion.bb20_2_fade", "candles.engulfing_raw", "structure.donchian_break_20",
             "volatility.keltner_breakout", "flow.obv_ema21", "momentum.kama_cross", "trend.supertrend_atr14_x3"]
    got = signal_positions(panel_of(spark, pdf), names).groupBy("symbol").agg(
        F.count("*").alias("n"), F.count_if(F.col("position") != 0).alias("on"), F.count_if(F.col("position").isNull()).alias("nil")).collect()
    assert {r.symbol: (r.n, r.on, r.nil) for r in got} == {"F": (700 * len(names), 0, 0), "short": (60 * len(names), 0, 0)}


def test_lag_and_shift_refuse_the_future():
    with pytest.raises(ValueError):
        X.lag(X.CLOSE, 0)
    with pytest.raises(ValueError):
        R.shift(X.CLOSE, -1)
    assert R.shift(X.CLOSE, 0) is X.CLOSE


def test_rule_contradiction_is_flat_and_undefined_is_false(spark):
    p = panel_of(spark, walk(500))
    both = R.evaluate_rule(p, {"c": X.CLOSE}, long=lambda c: c["c"] > 0, short=lambda c: c["c"] > 0)
    assert both.filter("position <> 0").isEmpty()
    head = R.evaluate_rule(p, {"m": R.sma(X.CLOSE, 50)}, long=lambda c: ~R.where(c["m"] > 0))
    assert head.filter("position = 1").count() == 49          # not(undefined) is true
    with pytest.raises(TypeError):
        R.evaluate_rule(p, {"c": X.CLOSE}, long=lambda c: True)


def test_catalogue_is_complete_and_guarded():
    from tidemark.signals.registry import catalogue, sig
    cat = catalogue()
    assert len(cat) == 100
    sizes = pd.Series([s.family for s in cat.values()]).value_counts().to_dict()
    assert sizes == {"candles": 13, "flow": 14, "mean_reversion": 12, "momentum": 12, "seasonality": 11, "structure": 12, "trend": 12, "volatility": 14}
    with pytest.raises(ValueError, match="duplicate"):
        sig("trend.psar_002_020", "1d", 1, [], None, "t", "r")
    with pytest.raises(ValueError, match="rationale"):
        sig("trend.new", "1d", 1, [], None, "t", " ")


IMPULSES = [  # direction, vertices, valid
    ("long", (74620, 97896, 93377, 105819, 100718, 107109), True), ("long", (74620, 97896, 93377, 105819, 100718, 111980), True),
    ("short", (126200, 102000, 116400, 80600), True), ("short", (126200, 102000, 116400, 98944, 107500), False),
    ("long", (60000, 72271, 65118, 74050, 65618, 76000), False), ("long", (98200, 108790, 105100, 110529, 107245, 123218), False),
    ("short", (95000, 81500, 92811, 76606, 87454, 74508), False), ("long", (100, 120, 99), False), ("long", (100, 130, 115, 160, 140, 155), True)]


def test_hand_labelled_impulses(spark):
    from tidemark.operators.candidates import impulse_rules, rules_valid
    for direction, pts, valid in IMPULSES:
        df = spark.createDataFrame([([float(x) for x in pts],)], "p array<double>")
        s = F.lit(1 if direction == "long" else -1)
        assert df.select(rules_valid(impulse_rules(F.col("p"), len(pts), s))).first()[0] is valid, pts


def _bars(spark, rows):
    return spark.createDataFrame([("S", "1h", i, i * 3_600_000, float(h), float(l), float(c), len(rows)) for i, (h, l, c) in enumerate(rows)],
                                 "symbol string, tf string, bar_idx long, open_time_ms long, high double, low double, close double, n_bars long")


def test_barriers_by_hand(spark):
    from tidemark.operators.outcomes import triple_barrier
    bars = _bars(spark, [(100, 100, 100), (103, 99, 102), (106, 101, 105), (104, 94, 95), (111, 88, 100), (101, 99, 100)])
    e = spark.createDataFrame([("win", "S", "1h", 0, 1, 100.0, 95.0, 105.0), ("lose", "S", "1h", 0, -1, 100.0, 104.0, 90.0),
                               ("both", "S", "1h", 3, 1, 95.0, 90.0, 110.0), ("time", "S", "1h", 0, 1, 100.0, 80.0, 150.0),
                               ("edge", "S", "1h", 5, 1, 100.0, 99.0, 101.0)],
                              "entry_id string, symbol string, tf string, bar_idx long, direction int, entry double, stop double, target double")
    got = {r.entry_id: r for r in triple_barrier(e, bars, max_bars=3).collect()}
    assert (got["win"].barrier, got["win"].r, got["win"].bars, got["win"].mfe_r, got["win"].mae_r) == ("tp", 1.0, 2, 1.2, 0.2)
    assert (got["lose"].barrier, got["lose"].r, got["lose"].bars) == ("sl", -1.0, 2)
    assert (got["both"].barrier, got["both"].r, got["both"].ambiguous) == ("sl", -1.0, True)
    assert (got["time"].barrier, got["time"].bars) == ("vertical", 3) and math.isclose(got["time"].r, -0.25)
    assert (got["edge"].barrier, got["edge"].r, got["edge"].bars) == ("vertical", 0.0, 0)
    fine = spark.createDataFrame([("S", 4 * 3_600_000 + 60_000, 111.0, 100.0), ("S", 4 * 3_600_000 + 120_000, 99.0, 88.0)],
                                 "symbol string, open_time_ms long, high double, low double")
    r = {x.entry_id: x for x in triple_barrier(e, bars, max_bars=3, fine=fine).collect()}["both"]
    assert (r.barrier, r.r, r.ambiguous) == ("tp", 3.0, False)
    with pytest.raises(Exception, match="zero risk"):
        triple_barrier(e.withColumn("stop", F.col("entry")), bars).collect()


def test_user_signals(spark, tmp_path):
    from tidemark.sources.user_signals import import_signals, read_signals_csv
    f = tmp_path / "s.csv"
    f.write_text("fecha;señal;cierre\n2024-03-14;compra;10\n2024-03-15;VENTA;11\n2024-03-15;fuera;12\n")
    out, seen = read_signals_csv(spark, str(f))
    assert seen == {"time": "fecha", "signal": "señal", "price": "cierre"}
    assert [(r.position, r.price) for r in out.orderBy("ts").collect()] == [(1, 10.0), (0, 12.0)]
    for scale, unit in ((1, 1_710_374_400), (1000, 1_710_374_400_000), (1_000_000, 1_710_374_400_000_000)):
        df = spark.createDataFrame([(unit, 2.5), (unit + scale * 60, -7.0)], "timestamp long, position double")
        rows = import_signals(df)[0].orderBy("ts").collect()
        assert rows[0].ts == 1_710_374_400_000 and [r.position for r in rows] == [1, -1]
    with pytest.raises(ValueError, match="unknown signal values"):
        import_signals(spark.createDataFrame([("2024-01-01", "maybe")], "date string, side string"))
    with pytest.raises(ValueError, match="no time column"):
        import_signals(spark.createDataFrame([(1,)], "side int"))


def test_klines_are_checked_per_file(spark, tmp_path):
    from tidemark.sources.klines import load_klines
    t0 = 1_704_067_200_000
    line = lambda t, trades=1: f"{t},1,2,0.5,1.5,10,{t + 59_999},15,{trades},1,1,0"
    (tmp_path / "GOOD-1m-2024-01.csv").write_text("open_time,open,high,low,close,volume,close_time,quote_volume,count,a,b,ignore\n" + "\n".join(
        [line(t0), line(t0), line(t0 + 60_000), line(t0 + 80_799, 5)]))
    (tmp_path / "MIXED-1m-2024-01.csv").write_text("\n".join([line(t0), line((t0 + 60_000) * 1000)]))
    (tmp_path / "OFF-1m-2024-01.csv").write_text(line(t0 + 30_000))
    (tmp_path / "MONTH-1m-2024-02.csv").write_text(line(t0))
    bars, rep = load_klines(spark, str(tmp_path), strict=False)
    assert {r.symbol: r.rejected for r in rep.collect()} == {"GOOD": None, "MIXED": "mixed_units", "OFF": "off_grid", "MONTH": "outside_month"}
    assert [(r.open_time_ms - t0, r.trades) for r in bars.orderBy("open_time_ms").collect()] == [(0, 1), (60_000, 5)]
    with pytest.raises(Exception, match="mixed_units|off_grid|outside_month"):
        load_klines(spark, str(tmp_path))[1].collect()


def test_ingest_is_idempotent_and_keeps_what_is_stored(spark, tmp_path):
    from tidemark.sources.store import ingest_bars, read_bars
    root = str(tmp_path / "store")
    pdf = walk(3_000, "1m")[["symbol", "open_time_ms", "open", "high", "low", "close", "volume"]]
    a = spark.createDataFrame(pdf)
    assert sum(r.written for r in ingest_bars(spark, root, a).collect()) == 3_000
    again = ingest_bars(spark, root, a.withColumn("close", F.lit(-1.0))).collect()
    assert (sum(r.written for r in again), sum(r.duplicates for r in again)) == (0, 3_000)
    assert read_bars(spark, root, grid=False).filter("close < 0").isEmpty()


def test_plan_settings_that_refuse_everything_are_refused():
    from tidemark.operators.plans import PlanConfig
    with pytest.raises(ValueError):
        PlanConfig(min_stop_atr=4.0)


def test_effective_n_counts_spaced_rows(spark):
    from tidemark.operators.evaluate import effective_n
    df = spark.createDataFrame([("s", i, i * 10, 35) for i in (0, 1, 2, 3, 4, 8, 9, 20)], "k string, bar_idx long, open_time_ms long, w long")
    assert effective_n(df, ["k"], "w", chunk=512, halo=512, split=False).first().n_effective == 4   # 0, 40, 80, 200


def test_one_name_is_one_definition(spark):
    p = panel_of(spark, walk(80))
    d = indicators(p, {"a": X.bbands(20, 2.0)[0], "b": X.bbands(20, 3.0)[0], "m": X.bbands(20, 3.0)[1]}).filter("bar_idx = 70").first()
    assert math.isclose((d.b - d.m) / (d.a - d.m), 1.5, rel_tol=1e-9)
    assert R.crosses_above(X.CLOSE, 50000.12) is not R.crosses_above(X.CLOSE, 50000.13)
    assert R.crosses_above(X.CLOSE, 50000.12) is R.crosses_above(X.CLOSE, 50000.12)
    assert X.prior_extreme(True, 50, 5) is not X.prior_extreme(True)
    assert X.ema(X.CLOSE, 9, 3) is not X.ema(X.CLOSE, 9)
    with pytest.raises(ValueError, match="already defined"):
        X.feature("range", [X.OPEN], None)


def test_long_windows_and_nested_averages_equal_the_loop(spark):
    pdf = walk(2_600)
    c = pdf["close"]
    spans = (512, 513, 600, 1024, 1200)
    wanted = {f"m{n}": X.sma(X.CLOSE, n) for n in spans} | {
        "one": R.ema(X.CLOSE, 1), "of_change": R.ema(R.change(X.CLOSE, 5), 10), "of_mean": R.ema(R.sma(X.CLOSE, 50), 10)}
    d = indicators(panel_of(spark, pdf), wanted).orderBy("bar_idx").toPandas()
    for n in spans:
        np.testing.assert_allclose(d[f"m{n}"].to_numpy(dtype=float), c.rolling(n).mean().to_numpy(), rtol=1e-9)
    np.testing.assert_array_equal(d["one"].to_numpy(dtype=float), c.to_numpy())
    for col, x, first in (("of_change", (c / c.shift(5) - 1) * 100, 5), ("of_mean", c.rolling(50).mean(), 49)):
        want = np.concatenate([np.full(first, np.nan), sequential_ema(x.to_numpy()[first:], 10)])
        np.testing.assert_allclose(d[col].to_numpy(dtype=float), want, rtol=1e-8, atol=1e-9)


def test_ticks_and_bars_that_cannot_be_right(spark):
    from tidemark.operators.bars import ticks_to_minutes
    make = lambda seqs: spark.createDataFrame([("S", pd.Timestamp("2024-01-01").to_pydatetime(), q, 10.0 * (i + 1), 1.0) for i, q in enumerate(seqs)],
                                              "symbol string, ts timestamp, seq long, price double, size double")
    bar = ticks_to_minutes(make([1, 2**47 - 1])).first()
    assert (bar.open, bar.close) == (10.0, 20.0)
    with pytest.raises(Exception, match="seq must be"):
        ticks_to_minutes(make([1, 2**47])).collect()
    pdf = walk(4)
    pdf.loc[2, "close"] = None
    bad = spark.createDataFrame(pdf).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    assert [r.violation for r in validate_bars(bad).orderBy("open_time_ms").collect()] == [None, None, "price_missing", None]


def test_user_times_lose_nothing(spark):
    from tidemark.sources.user_signals import find_column, import_signals, TIME_NAMES
    def read(values, kind):
        return sorted(r.ts for r in import_signals(spark.createDataFrame([(v, 1) for v in values], f"time {kind}, signal int"))[0].collect())
    for unit in (1, 1_000, 1_000_000, 1_000_000_000):
        at = 1_710_374_400 * unit
        want = [1_710_374_400_000, 1_710_374_460_000]
        assert read([at, at + 60 * unit], "long") == want
        assert read([float(at), float(at + 60 * unit)], "double") == want
        assert read([f"{at}.0", f"{at + 60 * unit}.0"], "string") == want
    day, six = 1_710_374_400_000, 1_710_439_200_000
    for text, ms in (("2024-03-14T18:00:00.000Z", six), ("2024-03-14 18:00:00.123", six + 123), ("2024-03-14 18:00:00+00:00", six),
                     ("14/03/2024", day), ("03/14/2024", day), ("Mar 14 2024", day)):
        assert read([text], "string") == [ms]
    with pytest.raises(Exception, match="unreadable"):
        read([1_710_374_400, None], "long")
    assert find_column(["mydate", "uptime"], TIME_NAMES) == "mydate"


def test_ingest_names_its_months(spark, tmp_path):
    from tidemark.sources.store import ingest_bars, stored_keys
    root = str(tmp_path / "store")
    b = spark.createDataFrame(walk(400)[["symbol", "tf", "open_time_ms", "open", "high", "low", "close", "volume"]])
    ingest_bars(spark, root, b.drop("tf")).collect()
    plan = stored_keys(spark, root, ["2020-09"])._jdf.queryExecution().toString()
    assert "2020-09" in plan.split("PartitionFilters")[1].split("]")[0]


def test_pivot_stats_where_a_pivot_lies_at_zero(spark):
    from tidemark.operators.pivots import pivot_stats
    prices = {"1h": [4.0, 2.0, 3.0, 0.0, 5.0], "15m": [0.0, 5.0, 0.0, 5.0, 10.0], "4h": [0.0, 0.0], "1d": [7.0]}
    p = [("S", tf, "k", i, x, 10 * i, 10 * i + 2 + i) for tf, xs in prices.items() for i, x in enumerate(xs)]
    p = spark.createDataFrame(p, "symbol string, tf string, variant string, pivot_no long, price double, idx long, confirmed_idx long")
    states = spark.createDataFrame([(tf, "k") for tf in prices for _ in range(100)], "tf string, variant string")
    got = {r.tf: r for r in pivot_stats(p, states).collect()}
    assert {tf: got[tf].median_leg_pct for tf in ("1h", "15m", "1d")} == {"1h": 75.0, "15m": math.inf, "1d": None}       # 50, 50, 100, inf; inf, 100, inf, 100
    assert math.isnan(got["4h"].median_leg_pct)
    assert {tf: (r.pivots, r.bars, r.median_lag, r.bars_per_pivot) for tf, r in got.items()} == {
        "1h": (5, 100, 4.0, 20.0), "15m": (5, 100, 4.0, 20.0), "4h": (2, 100, 2.5, 50.0), "1d": (1, 100, 2.0, 100.0)}


def test_rank_correlation_of_degenerate_outcomes(spark):
    from tidemark.operators.outcomes import score_rank_corr

    def corr(*rows):
        return tuple(score_rank_corr(spark.createDataFrame(list(rows), "score double, r double").repartition(4)).first())

    assert corr() == (0, None)
    for rows in ([(1.0, 2.0)], [(1.0, 2.0), (1.0, 3.0)], [(1.0, 2.0), (2.0, 2.0)], [(0.1, float(i)) for i in range(7)], [(float(i), -1.0) for i in range(101)]):
        n, c = corr(*rows)
        assert n == len(rows) and math.isnan(c)
    assert corr((1.0, 1.0), (2.0, 0.5), (3.0, 4.0)) == (3, pytest.approx(0.5))
    # null ranks last: no outcome is the largest, and its row counts
    assert corr((1.0, None), (2.0, 0.5), (3.0, 4.0)) == (3, pytest.approx(-0.5))
    assert corr((None, 1.0), (2.0, 0.5), (3.0, 4.0)) == (3, pytest.approx(0.5))
    assert corr((0.0, 1.0), (-0.0, 0.5), (3.0, 4.0)) == (3, pytest.approx(0.75**0.5))
