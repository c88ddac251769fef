"""Headline timings. One JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from tidemark.session import get_spark  # noqa: E402


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")

    from tidemark.functions import features as X
    from tidemark.operators import battery as B
    from tidemark.operators import evaluate as E
    from tidemark.operators import multiple as M
    from tidemark.operators.bars import dense_bar_index, ticks_to_bars
    from tidemark.operators.indicators import indicators
    from tidemark.operators.outcomes import triple_barrier
    from tidemark.operators.panel import build_panel
    from tidemark.operators.pivots import confirmed_pivots, pivot_events
    from tidemark.operators.signals import signal_positions
    from tidemark.plans import inputs, registry
    from tidemark.session import materialize

    times: dict[str, float] = {}

    def timed(name, fn):
        t = time.perf_counter()
        out = fn()
        times[name] = round(time.perf_counter() - t, 3)
        return out

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    spark.range(1000).selectExpr("sum(id)").collect()                      # start the executors
    timed("bars_from_ticks", lambda: run(ticks_to_bars(inputs.lineitem_ticks(spark, sf), ["1d"])))
    timed("bars_resample_5_timeframes", lambda: run(ticks_to_bars(inputs.event_ticks(spark, sf, "event_type"), ["5m", "15m", "1h", "4h", "1d"])))
    # one symbol per supplier: every line item is a tick, hundreds of series
    bars = timed("bars_index_and_store", lambda: materialize(dense_bar_index(ticks_to_bars(
        inputs.lineitem_ticks(spark, sf, "l_suppkey"), ["1d"])), "bench"))
    panel = build_panel(bars, indexed=True, stored=True)
    n_bars = bars.count()
    c, h, l = X.CLOSE, X.HIGH, X.LOW
    battery18 = {"sma20": X.sma(c, 20), "sma200": X.sma(c, 200), "ema21": X.ema(c, 21), "ema55": X.ema(c, 55), "ema200": X.ema(c, 200),
                 "atr14": X.atr(14), "natr14": X.natr(14), "rsi14": X.rsi(14), "macd": X.macd()[0], "macd_signal": X.macd()[1], "bb_up": X.bbands()[0],
                 "bb_lo": X.bbands()[2], "max20": X.rmax(h, 20), "min20": X.rmin(l, 20), "roc10": X.roc(c, 10), "adx": X.dmi()[2],
                 "willr": X.willr(), "mfi": X.mfi()}
    timed("indicator_battery_18", lambda: run(indicators(panel, battery18)))
    events = timed("zigzag", lambda: pivot_events(panel)[0])
    timed("pivots_numbered", lambda: run(confirmed_pivots(events)))
    names = registry.SAMPLE
    study = inputs.study_panel(spark, sf)
    sig = timed("signals_sample", lambda: materialize(signal_positions(study, names), "bench"))
    fwd = timed("forward_returns", lambda: materialize(E.forward_returns(study), "bench"))
    timed("evaluate_signals", lambda: run(E.evaluate_signals(sig, fwd, study)))
    ms = materialize(E.infer_bar_ms(study.owned()), "bench")
    ret = materialize(B.bar_returns(study), "bench")
    rows = timed("battery_rows", lambda: materialize(B.battery_rows(sig, ret, study), "bench"))
    timed("battery_250_draws", lambda: B.battery_tests(rows, ret, study, ms, draws=250)[0].collect())
    ex = materialize(E.excess_returns(sig, fwd), "bench")
    timed("reality_check_2000_draws", lambda: M.reality_check(ex, draws=2000)[0].collect())
    b = bars.select("symbol", "tf", "bar_idx", "close")
    d, px = F.col("position").cast("int"), F.col("close")
    entries = signal_positions(panel.with_df(panel.df.withColumn("tf", F.lit("1h"))), ["mean_reversion.streak3_fade"]).filter("position <> 0")
    entries = entries.withColumn("tf", F.lit("1d")).join(b, ["symbol", "tf", "bar_idx"]).select(
        F.concat_ws(":", "symbol", "bar_idx").alias("entry_id"), "symbol", "tf", "bar_idx", d.alias("direction"), px.alias("entry"),
        (px - d * 0.02 * px).alias("stop"), (px + d * 0.03 * px).alias("target"))
    timed("triple_barrier", lambda: run(triple_barrier(entries, bars)))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).replace("sf", ""), "bars": n_bars}))
    spark.stop()


if __name__ == "__main__":
    main()
