"""Operators that carry state over micro-batches and restarts, on ``transformWithStateInPandas``.

State is a few dozen numbers per series in RocksDB, check-pointed by Spark; it never grows with the
history. Every processor takes its rows in an order the caller names, so the result does not depend on
how the feed was cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.clock import TF_MS
from tidemark.operators import candidates as C
from tidemark.operators import pivots as P
from tidemark.operators import plans as T
from tidemark.operators.folds import run_zigzag
from tidemark.operators.panel import build_panel
from tidemark.session import materialize

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """``transformWithStateInPandas`` needs RocksDB; set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def _together(batches: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    """One key's rows of one micro-batch; their number is bounded by the trigger, not by the history."""
    return pd.concat(list(batches), ignore_index=True).sort_values(list(order), kind="stable", ignore_index=True)


# ------------------------------------------------------------------ late, repeated, out of order

#: What a closed bar is when it arrives. The last two go to the side output.
FATES = ("in_order", "out_of_order", "repeated", "late")


class Arrivals(StatefulProcessor):
    """Judges closed bars of one series as they arrive.

    The series' own watermark is its newest open time less ``delay_ms``. Older bars are late; a bar
    whose open time came before is a repetition; one behind the newest is out of order. State: the
    newest open time and the open times above the watermark, which the delay bounds.
    """

    def __init__(self, delay_ms: int, order: Sequence[str]):
        self.delay, self.order = delay_ms, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "open_time_ms long, seen array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, seen = self.newest.get() if self.newest.exists() else (None, [])
        pdf = _together(rows, self.order)
        t = pdf["open_time_ms"].to_numpy()
        lowest = np.iinfo(np.int64).min
        first = lowest if newest is None else newest
        before = np.maximum.accumulate(np.concatenate([[first], t[:-1]]))
        late = (before != lowest) & (t < np.where(before == lowest, 0, before) - self.delay)
        again = ~late & (pdf["open_time_ms"].duplicated().to_numpy() | np.isin(t, np.asarray(seen, dtype=np.int64)))
        fate = np.select([late, again, t < before], ["late", "repeated", "out_of_order"], "in_order")
        newest = int(max(first, t.max()))
        keep = np.unique(np.concatenate([np.asarray(seen, dtype=np.int64), t[~late]]))
        self.newest.update((newest, keep[keep >= newest - self.delay].tolist()))
        pdf["fate"] = fate
        pdf["behind_ms"] = np.where(before == lowest, 0, np.maximum(np.where(before == lowest, 0, before) - t, 0))
        yield pdf

    def close(self) -> None:
        pass


def judge_arrivals(feed: DataFrame, delay_ms: int, order: Sequence[str]) -> DataFrame:
    """Closed bars of a feed with ``fate`` and ``behind_ms``, how far they are behind the newest bar of their series.

    ``order`` names the columns that give the order of arrival (an offset, or arrival time and tie-breaks).
    """
    use_rocksdb(feed.sparkSession)
    closed = feed.filter("is_closed").select("symbol", "open_time_ms", "open", "high", "low", "close", "volume", *[c for c in order if c != "open_time_ms"])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in closed.schema) + ", fate string, behind_ms long"
    return closed.groupBy("symbol").transformWithStateInPandas(Arrivals(delay_ms, tuple(order)), schema, "append", "none")


def sink_arrivals(feed: DataFrame, store: str, side: str, checkpoint: str, delay_ms: int, order: Sequence[str]):
    """Bars in and out of order go to the store; late and repeated ones are kept under ``side``, with counts of every fate.

    Folders of an epoch are overwritten when the epoch is run again, and the store drops keys it has, so a retry changes nothing.
    """
    from tidemark.sources.store import ingest_bars

    def write(batch: DataFrame, epoch: int) -> None:
        judged = f"{side}/arrivals/epoch={epoch}"
        batch.write.mode("overwrite").partitionBy("fate").parquet(judged)
        rows = batch.sparkSession.read.schema(batch.schema).parquet(judged)
        rows.groupBy("symbol", "fate").agg(F.count(F.lit(1)).alias("n"), F.max("behind_ms").alias("most_behind_ms")).write.mode("overwrite").parquet(f"{side}/counts/epoch={epoch}")
        ingest_bars(batch.sparkSession, store, rows.filter("fate IN ('in_order', 'out_of_order')").drop("fate", "behind_ms"))
    return (judge_arrivals(feed, delay_ms, order).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def arrival_counts(spark: SparkSession, side: str) -> DataFrame:
    """(symbol, fate, n, most_behind_ms) since the feed began."""
    c = spark.read.parquet(f"{side}/counts")
    return c.groupBy("symbol", "fate").agg(F.sum("n").alias("n"), F.max("most_behind_ms").alias("most_behind_ms"))


# ------------------------------------------------------------------ ATR, pivots, recent structure

RECENT = 9              # pivots a decision looks back on
_PIVOT = "price double, kind int, ts_ms long"
_PIVOTS = "array<struct<price:double,kind:int,ts_ms:bigint>>"
STATES_SCHEMA = ("symbol string, tf string, open_time_ms long, bar_idx long, close double, atr double, p_kind int, p_idx long, p_ts long, p_price double, "
                 f"p_thr double, n_pivots long, recent {_PIVOTS}")
_CARRY = "n long, last_ms long, prev_close double, tr_sum double, atr double, zz array<double>, n_pivots long"


class BarStates(StatefulProcessor):
    """The batch ATR and zigzag transitions on closed bars of one series, continued from micro-batch to micro-batch.

    State: one value (counts, last close, ATR, open extreme) and a list of the last nine pivots.
    """

    def __init__(self, k_atr: float = 1.5, min_pct: float = 0.005, on_close: bool = False, period: int = 14):
        self.k_atr, self.min_pct, self.on_close, self.period = k_atr, min_pct, on_close, period

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.carry = handle.getValueState("carry", _CARRY)
        self.recent = handle.getListState("recent", _PIVOT)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Start where a batch over the stored history ended (:func:`warm_state`)."""
        s = initialState.iloc[0]
        none = lambda v: None if v is None or v != v else float(v)
        self.carry.update((int(s["n"]), int(s["last_ms"]), none(s["prev_close"]), float(s["tr_sum"]), none(s["atr"]), [float(v) for v in s["zz"]], int(s["n_pivots"])))
        if len(s["recent"]):
            self.recent.put([(float(p["price"]), int(p["kind"]), int(p["ts_ms"])) for p in s["recent"]])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        n, last, prev, tr_sum, atr, zz, n_pivots = self.carry.get() if self.carry.exists() else (0, None, None, 0.0, None, [float("nan")] * 5, 0)
        recent = [tuple(p) for p in self.recent.get()] if n_pivots else []
        pdf = _together(rows, ["open_time_ms"]).drop_duplicates("open_time_ms")
        if last is not None:
            pdf = pdf[pdf["open_time_ms"] > last]          # healing overlap: the state has them already
        if not len(pdf):
            return
        hi, lo, c = (pdf[x].to_numpy(dtype="float64") for x in ("high", "low", "close"))
        before = np.concatenate([[np.nan if prev is None else prev], c[:-1]])
        tr = np.fmax(hi - lo, np.fmax(np.abs(hi - before), np.abs(lo - before)))
        atrs = np.full(len(c), np.nan)
        for i in range(len(c)):
            if n + i:
                if atr is not None:
                    atr = (atr * (self.period - 1) + tr[i]) / self.period
                else:
                    tr_sum += tr[i]
                    if n + i >= self.period:
                        atr = tr_sum / self.period
            if atr is not None:
                atrs[i] = atr
        times = pdf["open_time_ms"].to_numpy()
        cols = {"bar_idx": np.arange(n, n + len(c), dtype="float64"), "open_time_ms": times.astype("float64"), "zz_hi": c if self.on_close else hi,
                "zz_lo": c if self.on_close else lo, "zz_thr": np.fmax(self.k_atr * atrs, np.where(np.isnan(atrs), np.nan, self.min_pct * c))}
        out, zz = run_zigzag(cols, list(zz))
        lists, counts = [], []
        for i in range(len(c)):
            if out["p_kind"][i] == out["p_kind"][i]:
                recent = [*recent, (float(out["p_price"][i]), int(out["p_kind"][i]), int(out["p_ts"][i]))][-RECENT:]
                n_pivots += 1
            lists.append(recent)
            counts.append(n_pivots)
        whole = lambda v: pd.array(v, dtype="Float64").astype("Int64")
        real = lambda v: pd.array([None if x != x else x for x in v.tolist()], dtype="Float64")
        self.carry.update((n + len(c), int(times[-1]), float(c[-1]), float(tr_sum), atr if atr is None else float(atr), [float(v) for v in zz], n_pivots))
        if recent:
            self.recent.put(recent)
        yield pd.DataFrame({
            "symbol": key[0], "tf": key[1], "open_time_ms": times, "bar_idx": np.arange(n, n + len(c)), "close": c, "atr": real(atrs), "p_kind": whole(out["p_kind"]),
            "p_idx": whole(out["p_idx"]), "p_ts": whole(out["p_ts"]), "p_price": real(out["p_price"]), "p_thr": real(out["p_thr"]), "n_pivots": counts,
            "recent": [[{"price": p, "kind": k, "ts_ms": t} for p, k, t in r] for r in lists]})

    def close(self) -> None:
        pass


def warm_state(bars: DataFrame, variant: P.Variant = P.Variant(), period: int = 14) -> DataFrame:
    """One row per series: the state that :class:`BarStates` has after these bars, computed by the batch pipeline.

    A deployment runs this over the stored history once, however long, and starts the stream from it.
    """
    panel = build_panel(bars)
    states = materialize(P.zigzag_states(panel, [variant]), "warm-states")
    end = states.groupBy("symbol", "tf").agg(F.max_by(F.struct("bar_idx", "open_time_ms", "close", "atr", *[f"x_{k}" for k in ("kind", "idx", "ts", "price", "thr")]), "bar_idx").alias("e"))
    piv = P.confirmed_pivots(states)
    count = piv.groupBy("symbol", "tf").agg((F.max("pivot_no") + 1).alias("n_pivots"))
    recent = (piv.join(count, ["symbol", "tf"]).filter(F.col("pivot_no") >= F.col("n_pivots") - RECENT).groupBy("symbol", "tf")
              .agg(F.first("n_pivots").alias("n_pivots"), F.sort_array(F.collect_list(F.struct("pivot_no", "price", F.col("kind").cast("int").alias("kind"), "ts_ms"))).alias("r")))
    # only series too short for a first ATR need the sum that will seed it: at most ``period`` bars each
    short = panel.owned().filter(F.col("n_bars") <= period)
    prev = F.lag("close").over(W.partitionBy("symbol", "tf").orderBy("bar_idx"))
    tr = short.withColumn("_p", prev).select("symbol", "tf", F.when(F.col("_p").isNotNull(), F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_p")), F.abs(F.col("low") - F.col("_p")))).alias("tr")).groupBy("symbol", "tf").agg(F.sum("tr").alias("tr_sum"))
    nan = F.lit(float("nan"))
    zz = F.array(*[F.coalesce(F.col(f"e.x_{k}").cast("double"), nan) for k in ("kind", "idx", "ts", "price", "thr")])
    out = end.join(recent, ["symbol", "tf"], "left").join(tr, ["symbol", "tf"], "left").select(
        "symbol", "tf", (F.col("e.bar_idx") + 1).alias("n"), F.col("e.open_time_ms").alias("last_ms"), F.col("e.close").alias("prev_close"), F.coalesce("tr_sum", F.lit(0.0)).alias("tr_sum"),
        F.col("e.atr").alias("atr"), zz.alias("zz"), F.coalesce("n_pivots", F.lit(0)).cast("long").alias("n_pivots"),
        F.coalesce(F.transform("r", lambda p: F.struct(p["price"].alias("price"), p["kind"].alias("kind"), p["ts_ms"].alias("ts_ms"))), F.array().cast(_PIVOTS)).alias("recent"))
    return materialize(out, "warm-state")


def stream_states(bars: DataFrame, initial: DataFrame | None = None, **options) -> DataFrame:
    """One row per closed bar: ATR, the pivot confirmed at it if any, and the last nine pivots known.

    ``initial`` seeds the state (:func:`warm_state`); a query that restarts from its checkpoint continues from that instead.
    """
    use_rocksdb(bars.sparkSession)
    grouped = bars.select("symbol", "tf", "open_time_ms", "high", "low", "close").groupBy("symbol", "tf")
    seed = None if initial is None else initial.groupBy("symbol", "tf")
    return grouped.transformWithStateInPandas(BarStates(**options), STATES_SCHEMA, "append", "none", initialState=seed)


def stream_indicators(bars: DataFrame, initial: DataFrame | None = None, **options) -> DataFrame:
    """Incremental ATR per closed bar."""
    return stream_states(bars, initial, **options).select("symbol", "tf", "open_time_ms", "bar_idx", "close", "atr")


def stream_pivots(bars: DataFrame, initial: DataFrame | None = None, **options) -> DataFrame:
    """Pivots as they are confirmed."""
    return stream_states(bars, initial, **options).filter("p_kind IS NOT NULL").select(
        "symbol", "tf", F.col("p_idx").alias("idx"), F.col("p_ts").alias("ts_ms"), F.col("p_price").alias("price"), F.col("p_kind").alias("kind"), F.col("p_thr").alias("thr_at_extreme"),
        F.col("bar_idx").alias("confirmed_idx"), F.col("open_time_ms").alias("confirmed_ts_ms"), "atr")


# ------------------------------------------------------------------ decisions

def decide_states(states: DataFrame, cfg: T.PlanConfig = T.PlanConfig(), variant: str = "k1.5") -> tuple[DataFrame, DataFrame]:
    """(decisions, plans) of rows of :func:`stream_states`: the structure of a bar is in its own row, so no history is read."""
    s = states.withColumn("variant", F.lit(variant))
    rows = s.select(*P.SERIES, "bar_idx", "open_time_ms", "close", "atr", F.col("close").alias("price"), F.posexplode(C.best_candidates(F.col("recent"))).alias("rank", "c"))
    plans = T.build_plans(C.unpack(rows, *P.SERIES, "bar_idx", "open_time_ms", "close", "atr", "price"), cfg)
    return T.decisions(s, plans), plans


def decide_epoch(batch: DataFrame, epoch: int, out: str, cfg: T.PlanConfig = T.PlanConfig()) -> None:
    """One micro-batch: states and decisions go to folders of their epoch, which a retry of the epoch overwrites."""
    batch.write.mode("overwrite").parquet(f"{out}/states/epoch={epoch}")
    states = batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/states/epoch={epoch}")
    decide_states(states, cfg)[0].write.mode("overwrite").parquet(f"{out}/decisions/epoch={epoch}")


def stream_decisions(bars: DataFrame, out: str, checkpoint: str, initial: DataFrame | None = None, cfg: T.PlanConfig = T.PlanConfig(), **options):
    """Decide on each closed trigger bar, once. A micro-batch costs what its own bars cost, whatever came before."""
    return (stream_states(bars, initial, **options).writeStream.foreachBatch(lambda b, e: decide_epoch(b, e, out, cfg))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


# ------------------------------------------------------------------ may decisions leave

MODES_SCHEMA = "symbol string, tf string, now_ms long, last_close_ms long, lag_bars double, mode string, cause string"


class EmissionMode(StatefulProcessor):
    """WARMUP until a closed bar is known, then LIVE or CATCH_UP.

    A wall clock that jumps by more than two trigger bars, or that long a silence, starts CATCH_UP; only a lag of at most one
    trigger bar ends it. In between the mode stays what it was.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.mode = handle.getValueState("mode", "mode string, now_ms long, last_close_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mode, wall, closed = self.mode.get() if self.mode.exists() else ("WARMUP", None, None)
        step, out = TF_MS[key[1]], []
        pdf = _together(rows, ["now_ms", "last_close_ms"])
        for now, close in zip(pdf["now_ms"].tolist(), pdf["last_close_ms"].tolist(), strict=True):
            if close == close and close is not None:
                closed = int(close) if closed is None else max(closed, int(close))
            jumped = wall is not None and now - wall > 2 * step
            wall = now
            lag = None if closed is None else (now - closed) / step
            if lag is not None:
                if mode == "WARMUP":
                    mode = "CATCH_UP"
                mode = "LIVE" if lag <= 1.0 else "CATCH_UP" if jumped else mode
            out.append((*key, now, closed, lag, mode, "row"))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        self.handle.registerTimer(wall + 2 * step + 1)
        self.mode.update((mode, wall, closed))
        yield _modes(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mode, wall, closed = self.mode.get()
        if mode != "LIVE":
            return
        at = expiredTimerInfo.getExpiryTimeInMs()
        self.mode.update(("CATCH_UP", wall, closed))
        yield _modes([(*key, at, closed, (at - closed) / TF_MS[key[1]], "CATCH_UP", "silence")])

    def close(self) -> None:
        pass


def _modes(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=["symbol", "tf", "now_ms", "last_close_ms", "lag_bars", "mode", "cause"])
    return df.astype({"last_close_ms": "Int64", "lag_bars": "Float64"})


def stream_emission(feed: DataFrame, delay: str = "1 minute") -> DataFrame:
    """The mode after each row of a feed ``(symbol, tf, now_ms, last_close_ms)``: wall clock and close of the newest closed bar, NULL where none is.

    Rows with cause ``silence`` come from event-time timers: the clock of the other series passed a series that stayed silent for two trigger bars.
    """
    use_rocksdb(feed.sparkSession)
    rows = feed.select("symbol", "tf", "now_ms", "last_close_ms").withColumn("now", F.timestamp_millis("now_ms")).withWatermark("now", delay)
    return rows.groupBy("symbol", "tf").transformWithStateInPandas(EmissionMode(), MODES_SCHEMA, "append", "eventTime")
