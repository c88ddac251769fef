"""ATR-ZigZag pivots with two clocks: when the extreme was drawn and when it became knowable."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import features as X
from tidemark.operators.bars import number_rows
from tidemark.operators.folds import ZIGZAG, run_folds
from tidemark.operators.indicators import compute
from tidemark.operators.panel import Panel
from tidemark.session import materialize

SERIES = ("symbol", "tf", "variant")


@dataclass(frozen=True)
class Variant:
    name: str = "k1.5"
    k: float = 1.5
    min_pct: float = 0.005
    on_close: bool = False


def zigzag_states(panel: Panel, variants: Sequence[Variant] = (Variant(),)) -> DataFrame:
    """One row per (bar, variant): the pivot confirmed AT that bar (``p_*``, else NULL) and the
    open extreme after it (``x_*``)."""
    a = X.atr(14)
    p = compute(panel, [a])
    arr = F.array(*[F.struct(
        F.lit(v.name).alias("variant"),
        (F.col("close") if v.on_close else F.col("high")).alias("zz_hi"),
        (F.col("close") if v.on_close else F.col("low")).alias("zz_lo"),
        F.when(a.c.isNotNull(), F.greatest(F.lit(v.k) * a.c, F.lit(v.min_pct) * F.col("close"))
               ).alias("zz_thr")) for v in variants])
    df = p.df.select("symbol", "tf", "ck", "bar_idx", "n_bars", "open_time_ms", "close",
                     a.c.alias("atr"), F.explode(arr).alias("v")).select("*", "v.*").drop("v")
    return run_folds(df, [ZIGZAG], series=SERIES, order="bar_idx", chunk=p.chunk,
                     split=p.split, keep=["open_time_ms", "n_bars", "close", "atr"])


def confirmed_pivots(states: DataFrame) -> DataFrame:
    """The append-only pivot table, numbered per series."""
    p = (states.filter("p_kind IS NOT NULL")
         .select(*SERIES, F.col("p_idx").alias("idx"), F.col("p_ts").alias("ts_ms"),
                 F.col("p_price").alias("price"), F.col("p_kind").cast("byte").alias("kind"),
                 F.col("p_thr").alias("thr_at_extreme"), F.col("bar_idx").alias("confirmed_idx"),
                 F.col("open_time_ms").alias("confirmed_ts_ms")))
    return number_rows(p, SERIES, "confirmed_idx", F.floor(F.col("confirmed_idx") / 4096), "pivot_no")


def provisional_pivots(states: DataFrame) -> DataFrame:
    """The one open extreme of each series and the price that would confirm it."""
    return (states.filter((F.col("bar_idx") == F.col("n_bars") - 1) & F.col("x_kind").isNotNull())
            .select(*SERIES, F.col("x_idx").alias("idx"), F.col("x_ts").alias("ts_ms"),
                    F.col("x_price").alias("price"), F.col("x_kind").cast("byte").alias("kind"),
                    F.col("x_thr").alias("thr_at_extreme"),
                    F.lit(None).cast("long").alias("confirmed_idx"),
                    F.lit(None).cast("long").alias("confirmed_ts_ms"),
                    (F.col("x_price") - F.col("x_kind") * F.col("x_thr")).alias("confirm_price")))


def asof_last(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str,
              right_time: str, cols: Sequence[str], span: int) -> DataFrame:
    """For every left row the ``cols`` of the last right row with right_time <= left_time.

    Time is cut into buckets of ``span``; inside a bucket it is a union and a running ``last``,
    and what happened before the bucket comes from the bucket table. No theta join, and no task
    holds more than a bucket of one key.
    """
    packed = F.struct(*cols)
    r = right.select(*keys, F.col(right_time).alias("_t"), packed.alias("_v"))
    last_in = r.groupBy(*keys, F.floor(F.col("_t") / span).alias("_b")).agg(
        F.max_by("_v", "_t").alias("_last"))
    lb = left.select(*keys, F.floor(F.col(left_time) / span).alias("_b")).distinct()
    both = (last_in.unionByName(lb.withColumn("_last", F.lit(None).cast(last_in.schema["_last"].dataType)))
            .groupBy(*keys, "_b").agg(F.first("_last", ignorenulls=True).alias("_last")))
    w = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    before = both.select(*keys, "_b", F.last("_last", ignorenulls=True).over(w).alias("_before"))
    u = (left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1))
         .unionByName(r.withColumn("_side", F.lit(0)), allowMissingColumns=True)
         .withColumn("_b", F.floor(F.col("_t") / span)))
    inner = W.partitionBy(*keys, "_b").orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    u = u.withColumn("_in", F.last("_v", ignorenulls=True).over(inner)).filter("_side = 1")
    out = u.join(before, [*keys, "_b"], "left").withColumn("_v", F.coalesce("_in", "_before"))
    return out.select(*left.columns, *[F.col(f"_v.{c}").alias(c) for c in cols])


def pivots_as_of(pivots: DataFrame, probes: DataFrame, time: str = "t",
                 span: int = 64 * 86_400_000) -> DataFrame:
    """What was known at each probe ``(symbol, tf, variant, t)``: the last confirmed pivot and
    how many there were (``n_known``)."""
    p = pivots.withColumn("n_known", F.col("pivot_no") + 1)
    got = asof_last(probes, p, SERIES, time, "confirmed_ts_ms",
                    ["idx", "ts_ms", "price", "kind", "n_known"], span)
    return got.withColumn("n_known", F.coalesce("n_known", F.lit(0)))


def pivot_windows(pivots: DataFrame, n: int, chunk: int = 4096) -> tuple[DataFrame, object]:
    """Pivots chunked with n copied rows, and the ordered window inside a chunk."""
    from tidemark.operators.bars import with_halo
    return (with_halo(pivots, "pivot_no", chunk, n),
            W.partitionBy(*SERIES, "ck").orderBy("pivot_no"))


def own_pivots(df: DataFrame, chunk: int = 4096) -> DataFrame:
    return df.filter(F.floor(F.col("pivot_no") / chunk) == F.col("ck"))


def pivot_violations(pivots: DataFrame) -> DataFrame:
    """Rows that break the store's contract: unconfirmed, confirmed before drawn, out of order."""
    p, w = pivot_windows(pivots, 1)
    p = own_pivots(p.withColumn("_pi", F.lag("idx").over(w)).withColumn("_pc", F.lag("confirmed_ts_ms").over(w)))
    why = (F.when(F.col("confirmed_ts_ms").isNull(), "not_confirmed")
           .when(F.col("confirmed_ts_ms") < F.col("ts_ms"), "confirmed_before_extreme")
           .when(F.col("idx") <= F.col("_pi"), "index_not_increasing")
           .when(F.col("confirmed_ts_ms") < F.col("_pc"), "confirmation_goes_back"))
    return p.withColumn("violation", why).filter("violation IS NOT NULL").drop("_pi", "_pc", "ck")


def legs_as_of(pivots: DataFrame, provisional: DataFrame | None, now_ms: int,
               since_ms: int | None = None) -> DataFrame:
    """Drawable vertices at ``now_ms``: confirmed ones solid, one extra before ``since_ms`` so the
    first visible leg is anchored, and the open extreme flagged tentative."""
    known = pivots.filter(F.col("confirmed_ts_ms") <= now_ms)
    edge = known.groupBy(*SERIES).agg(
        F.max("ts_ms").alias("_last"), F.count(F.lit(1)).alias("_n"),
        F.min(F.when(F.col("ts_ms") >= (since_ms if since_ms is not None else -(1 << 62)),
                     F.col("pivot_no"))).alias("_from"))
    out = known
    if since_ms is not None:
        out = known.join(edge, list(SERIES)).filter(
            F.col("pivot_no") >= F.coalesce("_from", "_n") - 1).drop("_last", "_from", "_n")
    out = out.select(*SERIES, "ts_ms", "price", "kind", "confirmed_ts_ms", F.lit(False).alias("tentative"))
    if provisional is None:
        return out
    tent = (provisional.filter(F.col("ts_ms") <= now_ms).join(edge, list(SERIES), "left")
            .filter(F.col("_last").isNull() | (F.col("ts_ms") > F.col("_last")))
            .select(*SERIES, "ts_ms", "price", "kind", "confirmed_ts_ms", F.lit(True).alias("tentative")))
    return out.unionByName(tent)


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str, pieces: int = 64) -> DataFrame:
    """Exact median per group, also for a group too large for one task.

    Equal values are counted first; approximate quantiles cut each group into pieces; running
    piece counts tell which pieces hold the two middle ranks, and only those rows are ranked.
    """
    v = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    cuts = v.groupBy(*keys).agg(F.percentile_approx(
        value, [i / pieces for i in range(1, pieces)], 1000).alias("_q"))
    v = v.join(cuts, list(keys)).withColumn(
        "_b", F.size(F.filter("_q", lambda q: q < F.col(value)))).drop("_q")
    sizes = v.groupBy(*keys, "_b").agg(F.sum("_c").alias("_n"))
    w = W.partitionBy(*keys)
    sizes = (sizes.withColumn("_off", F.coalesce(F.sum("_n").over(
        w.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_tot", F.sum("_n").over(w)))
    lo, hi = F.floor((F.col("_tot") - 1) / 2), F.floor(F.col("_tot") / 2)
    near = sizes.filter((F.col("_off") <= hi) & (F.col("_off") + F.col("_n") > lo)).drop("_n")
    inside = W.partitionBy(*keys, "_b").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    r = v.join(near, [*keys, "_b"]).withColumn("_end", F.col("_off") + F.sum("_c").over(inside))
    hit = lambda k: F.min(F.when(F.col("_end") > k, F.col(value)))
    return r.groupBy(*keys).agg(((hit(lo) + hit(hi)) / 2.0).alias(out))


def pivot_stats(pivots: DataFrame, states: DataFrame) -> DataFrame:
    """Pivots, bars per pivot, median |leg| in percent and median confirmation lag per (tf, variant).

    A leg that starts at price 0 is infinitely long, one from 0 to 0 is NaN; both sort last in the median, as in SQL. Where there is no
    leg, its median is null.
    """
    keys = ["tf", "variant"]
    p, w = pivot_windows(pivots, 1)
    p = p.withColumn("_prev", F.lag("price").over(w))
    ratio = F.when(F.col("_prev") == 0, F.col("price") * float("inf")).otherwise(F.col("price") / F.col("_prev"))
    legs = own_pivots(p.withColumn("leg", F.abs(ratio - 1.0) * 100.0))
    legs = legs.withColumn("lag", (F.col("confirmed_idx") - F.col("idx")).cast("double"))
    n = legs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pivots"))
    bars = states.groupBy(*keys).agg(F.count(F.lit(1)).alias("bars"))
    return (n.join(bars, keys)
            .join(exact_median(legs, keys, "leg", "median_leg_pct"), keys, "left")
            .join(exact_median(legs, keys, "lag", "median_lag"), keys)
            .withColumn("bars_per_pivot", F.col("bars") / F.col("pivots")))


# ------------------------------------------------------------------ events only

_EVENT = "p_kind int, p_idx long, p_ts long, p_price double, p_thr double, bar_idx long, open_time_ms long"
_EVENTS_SCHEMA = f"symbol string, tf string, ck long, variant string, {_EVENT}, start array<double>, end array<double>"
_UNSET = [float("nan")] * 5


def _pivot_kernel(batches: Iterator[pa.RecordBatch], variants: Sequence[Variant], chunk: int, period: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by chunk and bar. Out go the pivots of each chunk's own bars and, per variant, one row with the
    state before its first own bar and after its last; bars themselves do not come back.

    Where rows carry ``given`` (variant, state), the chunk starts from that state instead of what its halo says.
    """
    key, states, starts, own, prev, atr, total, seen = None, [], [], False, None, None, 0.0, 0
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * len(_EVENT_TYPES)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _EVENT_TYPES, strict=True)], names=[n for n, _ in _EVENT_TYPES])

    def close() -> None:
        for v, s, e in zip(variants, starts, states, strict=True):
            out.append((*key, v.name, *[None] * 7, s, list(e)))

    for b in batches:
        if not b.num_rows:
            continue
        idx, ts, hi, lo, cl = (b.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("bar_idx", "open_time_ms", "high", "low", "close"))
        given = b.column("given") if "given" in b.schema.names else None
        codes = [b.column(c).dictionary_encode().indices.to_numpy() for c in ("symbol", "tf")] + [b.column("ck").to_numpy()]
        turns = set((np.flatnonzero(np.any([c[1:] != c[:-1] for c in codes], axis=0)) + 1).tolist()) | {0}
        for k in range(b.num_rows):
            if k in turns and (now := tuple(b.column(c)[k].as_py() for c in ("symbol", "tf", "ck"))) != key:
                if key is not None:
                    close()
                key, own, prev, atr, total, seen = now, False, None, None, 0.0, 0
                states = [list(_UNSET) for _ in variants]
                starts = [list(_UNSET) for _ in variants]
            if not own and idx[k] // chunk == key[2]:
                own = True
                if given is not None:
                    told = {g["variant"]: g["state"] for g in given[k].as_py()}
                    states = [list(told.get(v.name, s)) for v, s in zip(variants, states, strict=True)]
                starts = [list(s) for s in states]
            h, l, c = hi[k], lo[k], cl[k]
            if prev is not None:
                tr = max(h - l, abs(h - prev), abs(l - prev))
                seen += 1
                if atr is not None:
                    atr = (atr * (period - 1) + tr) / period
                else:
                    total += tr
                    if seen == period:
                        atr = total / period
            prev = c
            if atr is None:
                continue
            for v, s in zip(variants, states, strict=True):
                top, low = (c, c) if v.on_close else (h, l)
                thr = max(v.k * atr, v.min_pct * c)
                up = s[0]
                if up != up:
                    s[:] = [1.0, idx[k], ts[k], top, thr]
                    continue
                ahead, back = (top, low) if up == 1.0 else (low, top)
                if (ahead - s[3]) * up > 0:
                    s[1:] = [idx[k], ts[k], ahead, thr]
                elif (s[3] - back) * up >= s[4]:
                    if own:
                        out.append((*key, v.name, int(up), int(s[1]), int(s[2]), s[3], s[4], idx[k], ts[k], None, None))
                    s[:] = [-up, idx[k], ts[k], back, thr]
        yield flush()
    if key is not None:
        close()
        yield flush()


_EVENT_TYPES = [("symbol", pa.string()), ("tf", pa.string()), ("ck", pa.int64()), ("variant", pa.string()), ("p_kind", pa.int32()), ("p_idx", pa.int64()), ("p_ts", pa.int64()),
                ("p_price", pa.float64()), ("p_thr", pa.float64()), ("bar_idx", pa.int64()), ("open_time_ms", pa.int64()), ("start", pa.list_(pa.float64())), ("end", pa.list_(pa.float64()))]


def pivot_events(panel: Panel, variants: Sequence[Variant] = (Variant(),), period: int = 14) -> tuple[DataFrame, DataFrame]:
    """(pivots, open extremes): the rows of :func:`zigzag_states` that hold a pivot, and of each series the state after its last bar.

    Bars stream through a small kernel in the panel's own partitioning; only pivots and a state per chunk leave it. A chunk
    starts from what its halo leads to; where the chunk before ends otherwise, it runs again from that end, until all agree.
    """
    need = ["symbol", "tf", "ck", "bar_idx", "open_time_ms", "high", "low", "close"]
    variants = tuple(variants)
    chunk = panel.chunk
    keys = ["symbol", "tf", "ck"]
    ordered = lambda df: df.sortWithinPartitions(*keys, "bar_idx")
    kernel = lambda b: _pivot_kernel(b, variants, chunk, period)
    got = materialize(ordered(panel.df.select(*need)).mapInArrow(kernel, _EVENTS_SCHEMA), "pivot-events")
    w = W.partitionBy("symbol", "tf", "variant").orderBy("ck")
    agree = F.forall(F.zip_with("before", "start", lambda a, b: (F.isnan(a) & F.isnan(b)) | (a == b) | (F.abs(a - b) <= 1e-9 * F.abs(a)) & (a != F.floor(a))), lambda x: x)
    while panel.split:
        ends = got.filter("p_kind IS NULL").withColumn("before", F.lag("end").over(w))
        wrong = materialize(ends.filter("before IS NOT NULL").filter(~agree).select(*keys, "variant", F.col("before").alias("state")), "pivot-redo")
        if wrong.isEmpty():
            break
        given = wrong.groupBy(*keys).agg(F.collect_list(F.struct("variant", "state")).alias("given"))
        again = ordered(panel.df.select(*need).join(given, keys).repartition(*keys)).mapInArrow(kernel, _EVENTS_SCHEMA)
        again = again.join(wrong.select(*keys, "variant"), [*keys, "variant"], "left_semi")
        got = materialize(got.join(wrong.select(*keys, "variant"), [*keys, "variant"], "left_anti").unionByName(again), "pivot-events")
    pivots = got.filter("p_kind IS NOT NULL").drop("ck", "start", "end")
    ends = got.filter("p_kind IS NULL").groupBy(*SERIES).agg(F.max_by("end", "ck").alias("e")).filter(~F.isnan(F.get("e", F.lit(0))))
    e = lambda i: F.get("e", F.lit(i))
    return pivots, ends.select(*SERIES, e(1).cast("long").alias("idx"), e(2).cast("long").alias("ts_ms"), e(3).alias("price"), e(0).cast("byte").alias("kind"),
                               e(4).alias("thr_at_extreme"), (e(3) - e(0) * e(4)).alias("confirm_price"))
