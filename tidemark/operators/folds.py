"""Order-dependent state machines over chunked series, exact and without a whole series in a task.

A fold is a small sequential kernel. Every chunk is run by itself: its start state is guessed by
running the kernel over the halo rows before it. The guesses are then checked against the end
state of the chunk before; chunks whose guess was wrong are run again from the right state, until
every start equals the end before it. State machines that forget (stops, pivots, time-to-live
levels) agree after the first pass; the worst case is one round per chunk, and the result is the
sequential one either way. Only chunk summaries, a few numbers each, take part in the checking.

Machines with three states need no guess: a bar is a map of the states, maps are composed by an
associative scan, and a chunk's composed map takes the state before it to the state after it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize


@dataclass(frozen=True)
class Fold:
    """``run(columns, state) -> (outputs, state)``; NaN stands for undefined in both."""

    name: str
    inputs: tuple[str, ...]
    init: tuple[float, ...]
    run: Callable[[dict[str, np.ndarray], list[float]], tuple[dict[str, np.ndarray], list[float]]]
    outputs: tuple[tuple[str, str], ...] = field(default=())     # (column, spark type)
    maps: Callable[[dict[str, np.ndarray]], np.ndarray] | None = None    # rows of (-1, 0, 1) -> next state


def _columns(pdf: pd.DataFrame, fold: Fold) -> dict[str, np.ndarray]:
    return {c: pdf[c].to_numpy(dtype="float64", na_value=np.nan) for c in fold.inputs}


def _schema(df: DataFrame, keys: Sequence[str], folds: Sequence[Fold], keep: Sequence[str]) -> T.StructType:
    fields = [df.schema[c] for c in (*keys, *keep)]
    for f in folds:
        fields += [T.StructField(n, T._parse_datatype_string(t)) for n, t in f.outputs]
    return T.StructType(fields)


def _emit(pdf: pd.DataFrame, folds, starts, keys, keep) -> pd.DataFrame:
    out = {c: pdf[c] for c in (*keys, *keep)}
    for f in folds:
        res, _ = f.run(_columns(pdf, f), list(starts[f.name]))
        for name, kind in f.outputs:
            v = res[name]
            out[name] = (pd.array(v, dtype="Float64").astype("Int64")
                         if kind in ("int", "long", "bigint") and v.dtype.kind == "f" else v)
            if v.dtype.kind == "f" and kind == "double":
                out[name] = pd.array(np.where(np.isnan(v), 0.0, v), dtype="Float64")
                out[name][np.isnan(v)] = pd.NA
    return pd.DataFrame(out)


def run_folds(df: DataFrame, folds: Sequence[Fold], *, series: Sequence[str], order: str,
              chunk: int, split: bool, keep: Sequence[str] = ()) -> DataFrame:
    """Run every fold over each series of ``df`` (chunked as a panel: ``ck`` plus halo copies).

    Returns the owned rows with the ``keep`` columns and the outputs of all folds.
    """
    keys = [*series, "ck"]
    need = list(dict.fromkeys([*keys, order, *keep, *[c for f in folds for c in f.inputs]]))
    df = df.select(*need)
    carried = list(dict.fromkeys([order, *keep]))
    schema = _schema(df, keys, folds, carried)

    if not split:
        def once(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order)
            return _emit(pdf, folds, {f.name: f.init for f in folds}, keys, carried)
        return df.groupBy(*keys).applyInPandas(once, schema)

    df = materialize(df, "fold")
    summary = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("fold", T.StringType()), T.StructField("start", T.ArrayType(T.DoubleType())),
        T.StructField("end", T.ArrayType(T.DoubleType()))])

    def rows_of(key, results):
        return pd.DataFrame([(*key, n, s, e) for n, s, e in results], columns=summary.names)

    def guess(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        mine = (pdf[order].to_numpy() // chunk) == pdf["ck"].to_numpy()
        halo, own = pdf[~mine], pdf[mine]
        res = []
        for f in folds:
            start = list(f.init)
            if f.maps:
                res.append((f.name, start, compose(f.maps(_columns(own, f))).astype("float64").tolist()))
                continue
            if len(halo):
                _, start = f.run(_columns(halo, f), start)
            _, end = f.run(_columns(own, f), list(start))
            res.append((f.name, list(start), list(end)))
        return rows_of(key, res)

    def redo(key, pdf: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf) or not len(want):
            return pd.DataFrame(columns=summary.names)
        pdf = pdf.sort_values(order)
        own = pdf[(pdf[order].to_numpy() // chunk) == pdf["ck"].to_numpy()]
        by_name = {f.name: f for f in folds}
        res = []
        for name, start in zip(want["fold"], want["start"]):
            _, end = by_name[name].run(_columns(own, by_name[name]), list(start))
            res.append((name, list(start), list(end)))
        return rows_of(key, res)

    machines = {f.name: int(f.init[0]) for f in folds if f.maps}

    def enter(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ck")
        state, starts = machines[key[-1]], []
        for m in pdf["end"]:
            starts.append([float(state)])
            state = int(m[state + 1])
        pdf["start"] = starts
        return pdf

    table = materialize(df.groupBy(*keys).applyInPandas(guess, summary), "fold-state")
    known = table.filter(F.col("fold").isin(*machines)).groupBy(*series, "fold").applyInPandas(enter, summary) if machines else None
    table = table.filter(~F.col("fold").isin(*machines)) if machines else table
    w = W.partitionBy(*series, "fold").orderBy("ck")
    # whole numbers (positions, places, times) must agree exactly
    same = lambda a, b: (F.isnan(a) & F.isnan(b)) | (a == b) | (
        ((a != F.floor(a)) | (b != F.floor(b))) & (F.abs(a - b) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(a))))
    while len(machines) < len(folds):
        checked = table.withColumn("before", F.lag("end").over(w)).withColumn(
            "ok", F.col("before").isNull() | F.forall(F.zip_with("before", "start", same), lambda v: v))
        wrong = materialize(checked.filter("not ok").select(
            *keys, "fold", F.col("before").alias("start")), "fold-redo")
        if wrong.isEmpty():
            break
        fixed = (df.join(wrong.select(*keys).distinct(), keys, "left_semi").groupBy(*keys)
                 .cogroup(wrong.groupBy(*keys)).applyInPandas(redo, summary))
        table = materialize(checked.filter("ok").select(*summary.names).unionByName(fixed), "fold-state")

    table = table.unionByName(known) if known is not None else table

    def emit(key, pdf: pd.DataFrame, st: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        own = pdf[(pdf[order].to_numpy() // chunk) == pdf["ck"].to_numpy()]
        return _emit(own, folds, dict(zip(st["fold"], st["start"])), keys, carried)

    return df.groupBy(*keys).cogroup(table.groupBy(*keys)).applyInPandas(emit, schema)


# ------------------------------------------------------------------ three-state machines

#: Bars of a lane.
LANE = 256


def _prefixes(maps: np.ndarray) -> np.ndarray:
    """Inside every lane of ``LANE`` bars the composition of all maps so far: one step per place in a lane, all lanes at once."""
    n = len(maps)
    out = np.tile(np.array([-1, 0, 1], dtype=np.int8), (-(-n // LANE) * LANE, 1))
    out[:n] = maps
    out = out.reshape(-1, LANE, 3)
    for j in range(1, LANE):
        out[:, j] = np.take_along_axis(out[:, j], out[:, j - 1] + 1, axis=1)
    return out


def compose(maps: np.ndarray) -> np.ndarray:
    """All maps one after the other as one map."""
    while len(maps) > 1:
        maps = _prefixes(maps)[:, -1]
    return maps[0] if len(maps) else np.array([-1, 0, 1], dtype=np.int8)


def scan_states(maps: np.ndarray, start: int) -> np.ndarray:
    """The state after every bar."""
    if not len(maps):
        return np.zeros(0, dtype=np.int8)
    inside = _prefixes(maps)
    if len(inside) == 1:
        begin = np.array([start])
    else:
        begin = np.concatenate([[start], scan_states(inside[:, -1], start)[:-1]])
    return np.take_along_axis(inside, (begin + 1)[:, None, None], axis=2).reshape(-1)[:len(maps)]


def _machine(name: str, inputs: tuple[str, ...], step) -> Fold:
    """A position machine over {-1, 0, +1}: ``step(*columns)`` gives the next state from short, from flat and from long.

    Comparisons with NaN are false, so an undefined input moves nothing by itself.
    """
    out = f"pos_{name}"

    def maps(cols):
        return np.stack(step(*(cols[c] for c in inputs)), axis=1).astype(np.int8)

    def run(cols, state):
        pos = scan_states(maps(cols), int(state[0])).astype("int64")
        return {out: pos}, [float(pos[-1]) if len(pos) else state[0]]
    return Fold(name, inputs, (0.0,), run, ((out, "int"),), maps)


def _reentry(c, up, mid, lo, c1, up1, lo1):
    entry = np.where((c1 < lo1) & (c >= lo), 1, np.where((c1 > up1) & (c <= up), -1, 0))
    off = np.isnan(up) | np.isnan(up1)
    return tuple(np.where(off, 0, m) for m in (np.where(c <= mid, entry, -1), entry, np.where(c >= mid, entry, 1)))


def _exit_flat(c, hi_in, lo_in, hi_out, lo_out):
    return np.where(c > hi_out, 0, -1), np.where(c > hi_in, 1, np.where(c < lo_in, -1, 0)), np.where(c < lo_out, 0, 1)


def _exit_or_reverse(c, hi_in, lo_in, hi_out, lo_out):
    top, bottom, off = c > hi_in, c < lo_in, np.isnan(hi_in)
    return tuple(np.where(off, 0, m) for m in (
        np.where(c <= hi_out, -1, np.where(top, 1, 0)), np.where(top, 1, np.where(bottom, -1, 0)), np.where(c >= lo_out, 1, np.where(bottom, -1, 0))))


def _squeeze(entry, squeezed, c, mid, ok):
    out_short, out_long = (squeezed == 1) | ((ok == 1) & (c > mid)), (squeezed == 1) | ((ok == 1) & (c < mid))
    return tuple(np.where(entry != 0, entry, m) for m in (np.where(out_short, 0, -1), np.zeros(len(c)), np.where(out_long, 0, 1)))


def _keltner(entry, c, mid, ok):
    return _squeeze(entry, np.zeros(len(c)), c, mid, ok)


BAND_REENTRY = _machine("band_reentry", ("close", "bb_up20", "close_sma20", "bb_lo20", "close_l1",
                                         "bb_up20_l1", "bb_lo20_l1"), _reentry)
CHANNEL_FLAT = _machine("channel_flat", ("close", "high_max55_p1", "low_min55_p1", "high_max20_p1",
                                         "low_min20_p1"), _exit_flat)
TURTLE = _machine("turtle", ("close", "high_max55_p1", "low_min55_p1", "high_max20_p1",
                             "low_min20_p1"), _exit_or_reverse)
SQUEEZE = _machine("squeeze", ("sq_entry", "sq_on", "close", "close_sma20", "sq_ok"), _squeeze)
KELTNER = _machine("keltner", ("kc_entry", "close", "close_ema20", "kc_ok"), _keltner)


# ------------------------------------------------------------------ real-valued folds

def _run_supertrend(cols, state):
    """Ratcheting bands: they only tighten, and are released when the close before broke them."""
    upper, lower, pos, prev = state
    c, ub, lb = (cols[k].tolist() for k in ("close", "st_up", "st_lo"))
    out = np.zeros(len(c), dtype="int64")
    for i in range(len(c)):
        if ub[i] == ub[i]:
            if upper != upper:
                upper, lower = ub[i], lb[i]
            else:
                upper = ub[i] if ub[i] < upper or prev > upper else upper
                lower = lb[i] if lb[i] > lower or prev < lower else lower
                pos = 1.0 if c[i] > upper else -1.0 if c[i] < lower else pos
                out[i] = int(pos)
        prev = c[i]
    return {"pos_supertrend": out}, [upper, lower, pos, prev]


SUPERTREND = Fold("supertrend", ("close", "st_up", "st_lo"), (np.nan, np.nan, 0.0, np.nan),
                  _run_supertrend, (("pos_supertrend", "int"),))


def _run_sar(cols, state, accel=0.02, top=0.20):
    """Parabolic stop and reverse. The first direction is the sign of the first directional move
    (down only when the low moved more), the first stop the far extreme of the first bar."""
    long, sar, ep, af, h1, l1 = state
    hi, lo = cols["high"].tolist(), cols["low"].tolist()
    out = np.full(len(hi), np.nan)
    for i in range(len(hi)):
        h, l = hi[i], lo[i]
        if h1 != h1:
            h1, l1 = h, l
            continue
        if long != long:
            dn = l1 - l
            long = 0.0 if dn > 0 and dn > h - h1 else 1.0
            ep, sar = (h, l1) if long else (l, h1)
            af = accel
            # the bar that fixes the direction is also the first one the stop is tested on
            h1, l1 = (h, l)
        if long:
            if l <= sar:
                long, sar = 0.0, max(ep, h1, h)
                out[i] = sar
                af, ep = accel, l
                sar = max(sar + af * (ep - sar), h1, h)
            else:
                out[i] = sar
                if h > ep:
                    ep, af = h, min(af + accel, top)
                sar = min(sar + af * (ep - sar), l1, l)
        else:
            if h >= sar:
                long, sar = 1.0, min(ep, l1, l)
                out[i] = sar
                af, ep = accel, h
                sar = min(sar + af * (ep - sar), l1, l)
            else:
                out[i] = sar
                if l < ep:
                    ep, af = l, min(af + accel, top)
                sar = max(sar + af * (ep - sar), h1, h)
        h1, l1 = h, l
    return {"sar": out}, [long, sar, ep, af, h1, l1]


SAR = Fold("sar", ("high", "low"), (np.nan,) * 6, _run_sar, (("sar", "double"),))


def _run_retest(cols, state, ttl0=10):
    """Breakout level with a time to live: touched again, then closed beyond → a position held
    for as many bars, replaced by any newer event."""
    names = ("close", "high", "low", "high_max20_p1", "low_min20_p1")
    c, hi, lo, top, bot = (cols[k].tolist() for k in names)
    up, dn, held = list(state[:3]), list(state[3:6]), list(state[6:])
    out = np.zeros(len(c), dtype="int64")

    def side(s, broke, level, touch, beyond):
        if broke:
            s[:] = [level, float(ttl0), 0.0]
        elif s[1] > 0:
            s[1] -= 1
            if touch(s[0]):
                s[2] = 1.0
            if s[2] and beyond(s[0]):
                s[1] = 0.0
                return True
        return False

    for i in range(len(c)):
        u = side(up, c[i] > top[i], top[i], lambda v: lo[i] <= v, lambda v: c[i] > v)
        d = side(dn, c[i] < bot[i], bot[i], lambda v: hi[i] >= v, lambda v: c[i] < v)
        for s in (up, dn):
            if s[1] <= 0:
                s[:] = [np.nan, 0.0, 0.0]              # a spent level is no state at all
        held = [float(u) - float(d), float(ttl0)] if u != d else [held[0], held[1] - 1]
        if held[1] <= 0:
            held = [0.0, 0.0]
        out[i] = int(held[0])
    return {"pos_retest": out}, [*up, *dn, *held]


RETEST = Fold("retest", ("close", "high", "low", "high_max20_p1", "low_min20_p1"),
              (np.nan, 0.0, 0.0, np.nan, 0.0, 0.0, 0.0, 0.0), _run_retest, (("pos_retest", "int"),))


def run_zigzag(cols, state):
    """One bar at a time: extreme first, confirmation second; the threshold is latched at the
    extreme. State: direction (NaN before the first ATR), extreme index, time, price, threshold."""
    up, at, when, px, thr = state
    idx, ts, hi, lo, t = (cols[k].tolist() for k in ("bar_idx", "open_time_ms", "zz_hi", "zz_lo", "zz_thr"))
    n = len(idx)
    out = {f"{w}_{k}": np.full(n, np.nan) for w in "px" for k in ("kind", "idx", "ts", "price", "thr")}
    for i in range(n):
        if t[i] != t[i]:
            continue
        if up != up:
            up, at, when, px, thr = 1.0, idx[i], ts[i], hi[i], t[i]
        else:
            ahead, back = (hi[i], lo[i]) if up == 1.0 else (lo[i], hi[i])
            if (ahead - px) * up > 0:
                at, when, px, thr = idx[i], ts[i], ahead, t[i]
            elif (px - back) * up >= thr:
                for k, v in zip(("kind", "idx", "ts", "price", "thr"), (up, at, when, px, thr)):
                    out[f"p_{k}"][i] = v
                up, at, when, px, thr = -up, idx[i], ts[i], back, t[i]
        for k, v in zip(("kind", "idx", "ts", "price", "thr"), (up, at, when, px, thr)):
            out[f"x_{k}"][i] = v
    return out, [up, at, when, px, thr]


ZIGZAG = Fold("zigzag", ("bar_idx", "open_time_ms", "zz_hi", "zz_lo", "zz_thr"), (np.nan,) * 5,
              run_zigzag, tuple((f"{w}_{k}", t) for w in "px" for k, t in (
                  ("kind", "int"), ("idx", "long"), ("ts", "long"), ("price", "double"),
                  ("thr", "double"))))


def spacing_fold(name: str, when: str, span: str, flag: str) -> Fold:
    """Greedy spacing: a flagged row is kept when it is at least ``span`` after the last kept."""
    def run(cols, state):
        last = state[0]
        t, s, f = (cols[k].tolist() for k in (when, span, flag))
        keep = np.zeros(len(t), dtype="int64")
        for i in range(len(t)):
            if f[i] == 1 and not (t[i] - last < s[i]):
                keep[i], last = 1, t[i]
        return {name: keep}, [last]
    return Fold(name, (when, span, flag), (np.nan,), run, ((name, "int"),))
