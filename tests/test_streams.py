"""Streams with state: what they say does not depend on how the feed was cut or whether the query was restarted."""

import numpy as np
import pandas as pd
import pytest
from conftest import walk
from pyspark.sql import functions as F

from tidemark.functions.clock import TF_MS
from tidemark.streaming import stateful as S

BAR = "symbol string, tf string, open_time_ms long, open double, high double, low double, close double, volume double"
BAR_COLS = ["symbol", "tf", "open_time_ms", "open", "high", "low", "close", "volume"]


@pytest.fixture(autouse=True)
def two_state_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def cut(pdf, at):
    edges = [0, *at, len(pdf)]
    return [pdf[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def feed(spark, frames, schema, root, start, first=0):
    """One file per frame; the query is started anew after every file but the first two."""
    for i, pdf in enumerate(frames):
        spark.createDataFrame(pdf, schema).coalesce(1).write.mode("append").parquet(f"{root}/feed")
        if i > first:
            start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/feed"), f"{root}/ck").awaitTermination()


def quarter(pdf, i):
    return pdf[i * len(pdf) // 4: (i + 1) * len(pdf) // 4]


def append_to(path):
    return lambda df, ck: df.writeStream.format("parquet").option("path", path).option("checkpointLocation", ck).trigger(availableNow=True).start()


def arrivals():
    rng = np.random.default_rng(8)
    rows = []
    for s in "AB":
        t = 1_700_000_040_000 - 1_700_000_040_000 % 60_000
        for i in range(300):
            at = t + int(rng.integers(-9, 3) if rng.random() < 0.3 else 1) * 60_000 * int(rng.integers(1, 4))
            t = max(t, at)
            rows.append((s, at, 1.0, 2.0, 0.5, 1.0 + i, 1.0, i, bool(rng.random() < 0.95)))
    return pd.DataFrame(rows, columns=["symbol", "open_time_ms", "open", "high", "low", "close", "volume", "seq", "is_closed"])


ARRIVAL = "symbol string, open_time_ms long, open double, high double, low double, close double, volume double, seq long, is_closed boolean"


def judged(pdf, delay):
    out = []
    for _, g in pdf[pdf["is_closed"]].groupby("symbol"):
        newest, seen = None, set()
        for r in g.sort_values("seq").itertuples(index=False):
            t = r.open_time_ms
            fate = "late" if newest is not None and t < newest - delay else "repeated" if t in seen else "out_of_order" if newest is not None and t < newest else "in_order"
            out.append((r.symbol, r.seq, t, fate, max(0, (newest if newest is not None else t) - t)))
            seen.add(t)
            newest = t if newest is None else max(newest, t)
    return sorted(out)


def test_arrivals_are_judged_as_one_by_one(spark, tmp_path):
    pdf, delay = arrivals(), 240_000
    want = judged(pdf, delay)
    assert {w[3] for w in want} == set(S.FATES)
    for name, cuts in (("one", [600]), ("many", [40, 90, 91, 350, 600])):
        parts = cut(pdf.sort_values("seq", kind="stable"), cuts[:-1])
        root = str(tmp_path / name)
        to = append_to(f"{root}/out")
        feed(spark, parts, ARRIVAL, root, lambda df, ck, to=to: to(S.judge_arrivals(df, delay, ["seq"]), ck), -1)
        got = spark.read.parquet(f"{root}/out").select("symbol", "seq", "open_time_ms", "fate", "behind_ms").collect()
        assert sorted(tuple(r) for r in got) == want


def test_sink_of_arrivals(spark, tmp_path):
    pdf, root = arrivals(), str(tmp_path)
    feed(spark, cut(pdf.sort_values("seq", kind="stable"), [100, 300]), ARRIVAL, root, lambda df, ck: S.sink_arrivals(df, f"{root}/store", f"{root}/side", ck, 240_000, ["seq"]))
    want = pd.DataFrame(judged(pdf, 240_000), columns=["symbol", "seq", "t", "fate", "behind"])
    got = {(r.symbol, r.fate): (r.n, r.most_behind_ms) for r in S.arrival_counts(spark, f"{root}/side").collect()}
    assert got == {k: (len(g), g["behind"].max()) for k, g in want.groupby(["symbol", "fate"])}
    kept = want[want["fate"].isin(["in_order", "out_of_order"])]
    assert sorted((r.symbol, r.open_time_ms) for r in spark.read.parquet(f"{root}/store").collect()) == sorted(zip(kept["symbol"], kept["t"], strict=True))


def test_seeded_stream_is_the_batch(spark, tmp_path):
    from tidemark.plans.pipelines import decide
    series = [walk(420, seed=3, symbol="A"), walk(300, "1h", seed=4, symbol="B", sigma=0.02), walk(9, seed=5, symbol="C"), walk(40, seed=6, symbol="D")]
    dec, _ = decide(spark.createDataFrame(pd.concat(series)[BAR_COLS]))
    want = {(r.symbol, r.open_time_ms): r for r in dec.collect()}
    begin = {"A": 200, "B": 100, "C": 5, "D": 0}                    # C is seeded in its warm-up, D not at all
    old = pd.concat([g[:begin[g["symbol"][0]]] for g in series])[BAR_COLS]
    parts = []
    for i in range(4):
        parts.append(pd.concat([quarter(g[begin[g["symbol"][0]]:], i) for g in series])[BAR_COLS])
        if i:                                                       # healing sends the last bars of the file before again
            parts[i] = pd.concat([parts[i - 1].groupby("symbol").tail(3), parts[i]])
    root = str(tmp_path)
    seed = S.warm_state(spark.createDataFrame(old, BAR))
    feed(spark, parts, BAR, root, lambda df, ck: S.stream_decisions(df, f"{root}/out", ck, seed))
    got = spark.read.parquet(f"{root}/out/decisions").collect()
    assert len(got) == sum(len(g) for g in series) - len(old) == len({(r.symbol, r.open_time_ms) for r in got})
    for r in got:
        w = want[r.symbol, r.open_time_ms]
        assert (r.verdict, r.reason, r.n_candidates, r.bar_idx) == (w.verdict, w.reason, w.n_candidates, w.bar_idx)
        assert (r.atr is None) == (w.atr is None) and (r.atr is None or abs(r.atr - w.atr) < 1e-9 * w.atr)
        assert [(c.rank, c.state, c.direction, c.viable, c.in_zone) for c in r.candidates or []] == [(c.rank, c.state, c.direction, c.viable, c.in_zone) for c in w.candidates or []]
    states = spark.read.parquet(f"{root}/out/states")
    assert states.filter("p_kind IS NOT NULL").count() > 10 and states.filter(F.size("recent") > S.RECENT).count() == 0


def test_a_repeated_epoch_writes_over_itself(spark, tmp_path):
    b = walk(200)
    states = pd.DataFrame({"symbol": "S", "tf": "15m", "open_time_ms": b["open_time_ms"], "bar_idx": np.arange(200), "close": b["close"], "atr": 1.0})
    df = spark.createDataFrame(states).withColumn("recent", F.array().cast(S._PIVOTS))
    for epoch in (0, 1, 1):
        S.decide_epoch(df, epoch, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/decisions").count() == 400


def test_the_mode_is_sticky(spark, tmp_path):
    tf, out = TF_MS["1h"], str(tmp_path / "out")
    h = lambda x: int(1_700_000_000_000 - 1_700_000_000_000 % tf + x * tf)
    rows = [  # now, last close, mode
        (0.0, None, "WARMUP"), (0.5, -3.0, "CATCH_UP"), (1.0, -1.0, "CATCH_UP"), (1.5, 0.6, "LIVE"), (2.5, 0.6, "LIVE"), (3.5, 0.6, "LIVE"),
        (6.0, 0.6, "CATCH_UP"), (7.0, 5.0, "CATCH_UP"), (8.0, 6.5, "CATCH_UP"), (8.5, 8.0, "LIVE"), (10.6, 10.0, "LIVE")]
    pdf = pd.DataFrame([("S", "1h", h(n), None if c is None else h(c)) for n, c, _ in rows], columns=["symbol", "tf", "now_ms", "last_close_ms"]).astype({"last_close_ms": "Int64"})
    other = pd.DataFrame([("T", "1h", h(0.1), h(0.0)), ("T", "1h", h(14.0), h(13.5))], columns=pdf.columns).astype({"last_close_ms": "Int64"})
    more = pd.DataFrame([("T", "1h", h(14.5), h(14.0))], columns=pdf.columns).astype({"last_close_ms": "Int64"})
    to = append_to(out)
    schema = "symbol string, tf string, now_ms long, last_close_ms long"
    feed(spark, [p.astype(object).where(p.notna(), None) for p in (pdf[:4], pdf[4:8], pd.concat([pdf[8:], other[:0]]), other[1:], more)], schema, str(tmp_path), lambda df, ck: to(S.stream_emission(df), ck), -1)
    got = spark.read.parquet(out)
    mine = sorted((r.now_ms, r.mode) for r in got.filter("symbol = 'S' AND cause = 'row'").collect())
    assert mine == [(h(n), m) for n, _, m in rows]
    silent = got.filter("symbol = 'S' AND cause = 'silence'").collect()       # the clock of T passed S, which was LIVE at 10.6
    assert [(r.mode, r.now_ms) for r in silent] == [("CATCH_UP", h(10.6) + 2 * tf + 1)]


def test_gate_uses_its_jump(spark):
    from tidemark.streaming.live import emission_gate
    tf = TF_MS["1h"]
    df = spark.createDataFrame([("1h", None, "LIVE", 0), ("1h", 0, "LIVE", 0), ("1h", 0, "LIVE", 3 * tf), ("1h", 2 * tf, "CATCH_UP", 3 * tf), ("1h", 0, "CATCH_UP", 0), ("1h", 0, "WARMUP", 0)], "tf string, close_time_ms long, b string, j long")
    got = emission_gate(df, F.lit(3 * tf), jumped_ms=F.col("j"), before=F.col("b")).collect()
    assert [r.mode for r in got] == ["WARMUP", "LIVE", "CATCH_UP", "LIVE", "CATCH_UP", "CATCH_UP"]
