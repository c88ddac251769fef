"""Evaluate feature graphs over a panel, and the indicator table."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import features as X
from tidemark.functions.features import Feature
from tidemark.operators.panel import CHUNK, MAX_HALO, Panel, carry_last, carry_sum


def _levels(wanted: Iterable[Feature]) -> list[list[Feature]]:
    level: dict[Feature, int] = {}

    def depth(f: Feature) -> int:
        if f not in level:
            level[f] = 0 if f.expr is None else 1 + max((depth(d) for d in f.deps), default=0)
        return level[f]

    for f in wanted:
        depth(f)
    out: list[list[Feature]] = []
    for f, k in sorted(level.items(), key=lambda kv: (kv[1], kv[0].name)):
        if k:
            while len(out) < k:
                out.append([])
            out[k - 1].append(f)
    return out


def _carry_depth(f: Feature) -> int:
    return (1 if f.carry else 0) + max((_carry_depth(d) for d in f.deps), default=0)


def served(panel: Panel, wanted: Iterable[Feature]) -> bool:
    """Is the halo long enough for every wanted feature? Base columns are right in all of it; an expression loses its
    span, a carry needs events from its trusted part on and is itself right there. Owned rows must be left."""
    right: dict[Feature, int] = {}

    def bars(f: Feature) -> int:
        if f not in right:
            got = min((bars(d) for d in f.deps), default=panel.halo) - f.span
            if f.carry:
                sub = panel.reach(_carry_depth(f))
                got = sub if got >= sub else -1
            right[f] = got
        return right[f]
    return all(bars(f) >= 0 for f in wanted)


def reaching(panel: Panel, wanted: Iterable[Feature]) -> Panel:
    """``panel`` with a halo, doubled as often as needed, that serves the wanted features; ``MAX_HALO`` is the end."""
    wanted, halo = list(wanted), panel.halo
    while panel.split and not served(Panel(panel.df, max(panel.chunk, halo) if halo > CHUNK else panel.chunk, halo, True), wanted):
        halo *= 2
        if halo > MAX_HALO:
            break
    return panel.widened(halo)


def compute(panel: Panel, wanted: Iterable[Feature]) -> Panel:
    """Add the wanted features and everything they read. One select per level of the graph; a
    level with carried features also resolves them across chunks. A halo too short for what the
    features read is widened first, so the panel that comes back may have another than that given."""
    wanted = list(wanted)
    panel = reaching(panel, wanted)
    for lv in _levels(wanted):
        plain = [f for f in lv if not f.carry]
        carried = [f for f in lv if f.carry]
        if plain:
            panel = panel.with_df(panel.df.select("*", *[f.expr().alias(f.name) for f in plain]))
        by_depth: dict[int, dict[str, str]] = {}
        for f in carried:
            by_depth.setdefault(_carry_depth(f), {})[f.name] = f.deps[0].name
        for d, cols in sorted(by_depth.items()):
            panel = carry_last(panel, cols, d)
    return panel


def indicators(panel: Panel, wanted: dict[str, Feature]) -> DataFrame:
    """``symbol, tf, bar_idx, open_time_ms`` and one column per requested indicator."""
    p = compute(panel, wanted.values())
    return p.owned().select("symbol", "tf", "bar_idx", "open_time_ms",
                            *[f.c.alias(n) for n, f in wanted.items()])


def running_totals(panel: Panel) -> DataFrame:
    """The unbounded totals themselves: OBV, cumulative AD and NVI, exact across chunks."""
    nv = X.nvi_rel()
    f = nv.deps[0]
    p = compute(panel, [X.SIGNED_VOLUME, X.AD_STEP, f])
    p = p.with_df(p.df.withColumn("ln_factor", F.ln(f.c)))
    t = carry_sum(p, {"obv": "obv_step", "ad": "ad_step", "_nvi": "ln_factor"})
    return t.select("symbol", "tf", "bar_idx", "open_time_ms", "obv", "ad",
                    (1000.0 * F.exp("_nvi")).alias("nvi"))
