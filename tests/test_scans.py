"""Composed maps give what the bar-by-bar loop gives, in rounds that do not depend on the number of chunks."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import folds as K
from tidemark.operators.evaluate import effective_n


def greedy(times, span):
    n, last = 0, None
    for t in sorted(times):
        if last is None or t - last >= span:
            n, last = n + 1, t
    return n


def spans(rng):
    rows = []
    for g, (count, every, span) in enumerate([(5000, 1, 37.0), (5000, 1, 1.0), (3000, 3, 250.5), (40, 900, 20_000.0), (1, 1, 5.0), (700, 50, 49.0)]):
        at = np.cumsum(rng.integers(1, 2 * every + 1, count))
        rows += [(f"s{g}", "A", int(i), int(1000 * i), 1000 * span) for i in at]
    return pd.DataFrame(rows, columns=["signal_name", "symbol", "bar_idx", "open_time_ms", "w"])


def test_effective_n_is_the_greedy_count_in_a_fixed_number_of_rounds(spark):
    pdf = spans(np.random.default_rng(3))
    want = {k: greedy(g["open_time_ms"], g["w"].iloc[0]) for k, g in pdf.groupby("signal_name")}
    df = spark.createDataFrame(pdf)
    jobs = []
    for chunk in (65_536, 2048, 256, 64, 16):
        spark.sparkContext.setJobGroup(f"chunk{chunk}", "count")
        got = effective_n(df, ["signal_name", "symbol"], "w", chunk=chunk).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chunk{chunk}")))
        assert {r.signal_name: r.n_effective for r in got} == want
    assert len(set(jobs)) == 1, jobs
    assert effective_n(df.limit(0), ["signal_name", "symbol"], "w").count() == 0


def loop_reentry(pos, c, up, mid, lo, c1, up1, lo1):
    if up != up or up1 != up1:
        return 0
    if (pos == 1 and c >= mid) or (pos == -1 and c <= mid):
        pos = 0
    if pos == 0:
        return 1 if c1 < lo1 and c >= lo else -1 if c1 > up1 and c <= up else 0
    return pos


def loop_flat(pos, c, hi_in, lo_in, hi_out, lo_out):
    if pos == 0:
        return 1 if c > hi_in else -1 if c < lo_in else 0
    return (0 if c < lo_out else 1) if pos == 1 else (0 if c > hi_out else -1)


def loop_turtle(pos, c, hi_in, lo_in, hi_out, lo_out):
    if hi_in != hi_in:
        return 0
    if pos == 0:
        return 1 if c > hi_in else -1 if c < lo_in else 0
    if pos == 1:
        return 1 if c >= lo_out else -1 if c < lo_in else 0
    return -1 if c <= hi_out else 1 if c > hi_in else 0


def loop_squeeze(pos, entry, squeezed, c, mid, ok):
    if (pos == 1 and (squeezed == 1 or (ok == 1 and c < mid))) or (pos == -1 and (squeezed == 1 or (ok == 1 and c > mid))):
        pos = 0
    return int(entry) if entry != 0 else pos


def loop_keltner(pos, entry, c, mid, ok):
    return loop_squeeze(pos, entry, 0, c, mid, ok)


@pytest.mark.parametrize("fold,loop", [(K.BAND_REENTRY, loop_reentry), (K.CHANNEL_FLAT, loop_flat), (K.TURTLE, loop_turtle), (K.SQUEEZE, loop_squeeze), (K.KELTNER, loop_keltner)])
def test_machines_are_the_loop(fold, loop):
    rng = np.random.default_rng(9)
    for n in (0, 1, 255, 256, 257, 5000):
        cols = {}
        for c in fold.inputs:
            if c.endswith("entry"):
                cols[c] = rng.choice([-1.0, 0.0, 0.0, 0.0, 0.0, 1.0], n)
            elif c in ("sq_on", "sq_ok", "kc_ok"):
                cols[c] = rng.choice([0.0, 1.0], n)
            else:
                cols[c] = rng.normal(size=n) + (0.8 if "max" in c or "up" in c else -0.8 if "min" in c or "lo2" in c else 0)
                cols[c][rng.random(n) < 0.05] = np.nan
        for start in (-1, 0, 1):
            pos, want = start, []
            for vals in zip(*(cols[c].tolist() for c in fold.inputs), strict=True):
                pos = loop(pos, *vals)
                want.append(pos)
            out, end = fold.run(cols, [float(start)])
            assert out[fold.outputs[0][0]].tolist() == want and end == [float(pos)]
            assert int(K.compose(fold.maps(cols))[start + 1]) == pos
