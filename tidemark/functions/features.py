"""Lazy column graph: named features, their inputs, and the helpers that build them.

A feature is a name, the features it reads and a Column. ``compute`` (operators.indicators) sorts
the requested graph into levels and adds one ``select`` per level, so every window of a level
shares one Window node. Undefined is NULL everywhere, never NaN.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.operators.panel import BLOCK, block_running, blocks_before, rows, running, win


@dataclass(frozen=True, eq=False)
class Feature:
    name: str
    deps: tuple
    expr: Callable[[], Column] | None      # None: a column of the bar table
    carry: bool = False                    # ``expr`` is an event to be carried forward
    first: int = 0                         # the bar it is defined from, if its inputs have no holes
    params: tuple = ()                     # what tells it from others of the same inputs, beyond the name
    span: int = 0                          # how many bars before its own ``expr`` reads its inputs

    @property
    def c(self) -> Column:
        return F.col(self.name)


_KNOWN: dict[str, Feature] = {}


def feature(name: str, deps, expr, carry: bool = False, first: int | None = None, params: tuple = (),
            span: int = 0) -> Feature:
    """Get or define the feature ``name``. One name cannot stand for two definitions: other inputs or
    parameters under a known name are refused. ``first`` is that of the latest input unless given.
    ``span`` must cover every window and lag of ``expr``: the halo of a panel is derived from it."""
    deps = tuple(deps)
    if first is None:
        first = max((d.first for d in deps), default=0)
    have = _KNOWN.setdefault(name, Feature(name, deps, expr, carry, first, params, span))
    if ([d.name for d in have.deps], have.first, have.params, have.carry, have.span) != ([d.name for d in deps], first, params, carry, span):
        raise ValueError(f"'{name}' is already defined with other inputs or parameters")
    return have


def number(x: float) -> str:
    """``x`` in full, as a part of a name."""
    short = f"{x:g}"
    return (short if float(short) == float(x) else repr(float(x))).replace(".", "_").replace("-", "m").replace("+", "")


def since(x: Feature, start: int) -> str:
    """The part of a name that tells a recursion from one that begins where ``x`` does."""
    return "" if start == x.first else f"_s{start}"


def base(name: str) -> Feature:
    return feature(name, (), None)


OPEN, HIGH, LOW, CLOSE, VOLUME = (base(x) for x in ("open", "high", "low", "close", "volume"))
TS, IDX = base("open_time_ms"), base("bar_idx")


def pos_in_block() -> Column:
    return F.pmod(F.col("bar_idx"), F.lit(BLOCK)).cast("double")


# ------------------------------------------------------------------ bounded windows

def lag(x: Feature, k: int = 1) -> Feature:
    if k < 1:
        raise ValueError("lag only reads the past (k >= 1)")
    return feature(f"{x.name}_l{k}", [x], lambda: F.lag(x.c, k).over(win()), first=x.first + k, span=k)


def guard(n: int, x: Feature, value: Column, skip: int = 0, holes: bool = False) -> Column:
    """``value`` only where all n bars of the window carry a defined x. Most series are undefined
    only at their head, so looking at the oldest bar is enough; ``holes`` counts them all."""
    if holes:
        return F.when(F.count(x.c).over(rows(n, skip)) == n, value)
    if n + skip == 1:
        return F.when(x.c.isNotNull(), value)
    return F.when(F.lag(x.c, n - 1 + skip).over(win()).isNotNull(), value)


def prefix(x: Feature) -> tuple[Feature, Feature]:
    """(running sum inside the 512-bar block, total of the block before)."""
    p = feature(f"{x.name}_ps", [x],
                lambda: F.sum(F.coalesce(x.c, F.lit(0.0))).over(block_running()), span=BLOCK)
    t = feature(f"{x.name}_pt", [x],
                lambda: F.coalesce(F.sum(x.c).over(blocks_before(1)), F.lit(0.0)), span=2 * BLOCK)
    return p, t


def rsum(x: Feature, n: int, holes: bool = False) -> Feature:
    """Sum of the last n bars from running sums inside blocks and totals of whole blocks: constant
    work per bar for any n, and rounding that cannot build up past the blocks of the window."""
    p, t = prefix(x)
    name = f"{x.name}_sum{n}" + ("_holes" if holes else "")
    if n > BLOCK:
        # bar i-n lies n // BLOCK blocks back, or one more when i stands too near its block's start
        less, more = (feature(f"{x.name}_pt{m}", [x], lambda m=m: F.coalesce(F.sum(x.c).over(blocks_before(m)), F.lit(0.0)),
                              span=(m + 1) * BLOCK)
                      for m in (n // BLOCK, n // BLOCK + 1))

        def far():
            old = F.coalesce(F.lag(p.c, n).over(win()), F.lit(0.0))
            return guard(n, x, p.c + F.when(pos_in_block() >= n % BLOCK, less.c).otherwise(more.c) - old, holes=holes)
        return feature(name, [x, p, less, more], far, first=x.first + n - 1, span=n)

    def e():
        at = pos_in_block()
        old = F.lag(p.c, n).over(win())
        total = F.when(at >= n, p.c - old).when(at == n - 1, p.c).otherwise(p.c + (t.c - old))
        return guard(n, x, total, holes=holes)
    return feature(name, [x, p, t], e, first=x.first + n - 1, span=n)


def sma(x: Feature, n: int, holes: bool = False) -> Feature:
    s = rsum(x, n, holes)
    return feature(f"{x.name}_sma{n}" + ("_holes" if holes else ""), [s], lambda: s.c / n)


def std(x: Feature, n: int) -> Feature:
    return feature(f"{x.name}_std{n}", [x], lambda: guard(n, x, F.stddev_pop(x.c).over(rows(n))), first=x.first + n - 1, span=n - 1)


NEAR = 32                   # windows up to this many bars are compared value by value


def _doubled(x: Feature, k: int, best: str) -> Feature:
    """Extreme of the last 2**k bars (fewer at the head) as that of two halves."""
    if k == 0:
        return x
    half = _doubled(x, k - 1, best)
    pick = F.greatest if best == "max" else F.least
    return feature(f"{x.name}_{best}_of_{1 << k}", [half], lambda: pick(half.c, F.lag(half.c, 1 << (k - 1)).over(win())),
                   first=x.first, span=1 << (k - 1))


def _extreme(name: str, x: Feature, n: int, skip: int, best: str, defined: Feature) -> Feature:
    """Extreme of the n bars ending ``skip`` bars ago, of numbers or structs, where ``defined`` has a value n bars back.

    A long window is covered by two overlapping ones of a power of two, each built from halves: log2(n) lags a bar
    instead of n comparisons, all in the one sort order of the panel, and shared by every length over the same input.
    """
    if n <= NEAR:
        over = F.max if best == "max" else F.min
        return feature(name, [x, defined], lambda: guard(n, defined, over(x.c).over(rows(n, skip)), skip),
                       first=x.first + n - 1 + skip, span=n - 1 + skip)
    k = n.bit_length() - 1
    part, pick = _doubled(x, k, best), F.greatest if best == "max" else F.least
    ends = (skip, skip + n - (1 << k))
    return feature(name, [part, defined], lambda: guard(n, defined, pick(*[
        F.lag(part.c, e).over(win()) if e else part.c for e in ends]), skip), first=x.first + n - 1 + skip, span=n - 1 + skip)


def rmax(x: Feature, n: int, skip: int = 0) -> Feature:
    return _extreme(f"{x.name}_max{n}" + (f"_p{skip}" if skip else ""), x, n, skip, "max", x)


def rmin(x: Feature, n: int, skip: int = 0) -> Feature:
    return _extreme(f"{x.name}_min{n}" + (f"_p{skip}" if skip else ""), x, n, skip, "min", x)


def roc(x: Feature, n: int) -> Feature:
    """Percent change against n bars ago."""
    def e():
        p = F.lag(x.c, n).over(win())
        return F.when(p != 0, (x.c / p - 1.0) * 100.0).when(p == 0, 0.0)
    return feature(f"{x.name}_roc{n}", [x], e, first=x.first + n, span=n)


def slope(x: Feature, n: int) -> Feature:
    """Least-squares slope against 0..n-1."""
    return feature(f"{x.name}_slope{n}", [x], lambda: guard(
        n, x, F.regr_slope(x.c, F.col("bar_idx").cast("double")).over(rows(n))), span=n - 1)


def rank_pct(x: Feature, n: int) -> Feature:
    """Share of the other n-1 window values strictly below the current one."""
    def e():
        arr = F.collect_list(x.c).over(rows(n))
        below = F.size(F.filter(arr, lambda v: v < x.c))
        return F.when(x.c.isNotNull() & (F.size(arr) == n), below / F.lit(float(n - 1)))
    return feature(f"{x.name}_rank{n}", [x], e, span=n - 1)


def hold_bars(ev: Feature, n: int) -> Feature:
    """The last non-zero event if it is younger than n bars, else 0."""
    def e():
        last = F.last(F.when(ev.c != 0, F.struct(F.col("bar_idx").alias("i"), ev.c.alias("v"))),
                      ignorenulls=True).over(rows(n))
        return F.coalesce(last["v"], F.lit(0))
    return feature(f"{ev.name}_hold{n}", [ev], e, span=n - 1)


def ffill(x: Feature) -> Feature:
    """Last defined value, however long ago (resolved across chunks by ``carry_last``)."""
    return feature(f"{x.name}_ff", [x], lambda: x.c, carry=True)


def hold(ev: Feature) -> Feature:
    """Last non-zero event, however long ago; NULL before the first."""
    nz = feature(f"{ev.name}_nz", [ev], lambda: F.when(ev.c != 0, ev.c))
    return ffill(nz)


# ------------------------------------------------------------------ blocked affine scan

def affine(name: str, u: Feature, q: float, first: int) -> Feature:
    """y_i = q·y_{i-1} + u_i with y = 0 before the series, defined from bar ``first`` on.

    Inside a 512-bar block the closed form ``q^p · Σ u_j q^-j`` is one running sum; the blocks
    before contribute ``q^(p+1) · Σ_k q^(512(k-1)) · end_k`` over as many blocks as the
    coefficient remembers at double precision. Seeds are part of ``u``.
    """
    if q == 0:
        return feature(name, [u], lambda: F.when(F.col("bar_idx") >= first, u.c), first=first)
    loss = -math.log(q)
    if loss * BLOCK > 600:
        raise ValueError("coefficient too small for the block length")
    m = q ** BLOCK
    reach = max(1, math.ceil(40.0 / (loss * BLOCK)))
    p = feature(f"{name}_blk", [u], lambda: F.pow(F.lit(q), pos_in_block()) * F.sum(
        u.c * F.pow(F.lit(q), -pos_in_block())).over(block_running()), span=BLOCK)

    def e():
        end = F.when(F.pmod(F.col("bar_idx"), F.lit(BLOCK)) == BLOCK - 1, p.c)
        if reach == 1:
            carry = F.coalesce(F.sum(end).over(blocks_before(1)), F.lit(0.0))
        else:
            carry = F.aggregate(F.collect_list(end).over(blocks_before(reach)), F.lit(0.0),
                                lambda acc, v: acc * m + v)
        y = p.c + F.pow(F.lit(q), pos_in_block() + 1) * carry
        return F.when(F.col("bar_idx") >= first, y)
    return feature(name, [p], e, first=first, params=(q,), span=(reach + 1) * BLOCK)


def _first(x: Feature, start: int, n: int) -> Column:
    """Sum of the n values from bar ``start`` on, read at the last of them: a running sum, because
    a sliding one would do n updates on every bar for a value needed once."""
    return F.sum(F.when(F.col("bar_idx").between(start, start + n - 1), x.c)).over(running())


def smooth(name: str, x: Feature, n: int, alpha: float, start: int) -> Feature:
    """Exponential smoothing of x (defined from bar ``start``) seeded by the mean of its first n
    values at bar start+n-1."""
    at = start + n - 1

    def e():
        return (F.when(F.col("bar_idx") > at, F.coalesce(x.c, F.lit(0.0)) * alpha)
                .when(F.col("bar_idx") == at, _first(x, start, n) / n).otherwise(0.0))
    return affine(name, feature(f"{name}_u", [x], e, span=n), 1.0 - alpha, at)


def trailing(name: str, x: Feature, n: int, start: int, seed: str = "mean") -> Feature:
    """Exponential average as x minus its distance d_i = q·(d_{i-1} + x_i - x_{i-1}).

    The same value as ``smooth``, but the scan runs over changes: on a stretch of equal prices the
    average is exactly the price, as it is in the sequential loop, and no comparison with it can
    turn rounding into a position.
    """
    q = 1.0 - 2.0 / (n + 1.0)
    at = start + n - 1 if seed == "mean" else start

    def e():
        step = F.coalesce(x.c - F.lag(x.c, 1).over(win()), F.lit(0.0))
        first = x.c - _first(x, start, n) / n if seed == "mean" else F.lit(0.0)
        return (F.when(F.col("bar_idx") > at, q * step).when(F.col("bar_idx") == at, first).otherwise(0.0))
    d = affine(f"{name}_d", feature(f"{name}_du", [x], e, span=n), q, at)
    return feature(name, [x, d], lambda: x.c - d.c, first=at)


def ema(x: Feature, n: int, start: int = 0) -> Feature:
    return trailing(f"{x.name}_ema{n}{since(x, start)}", x, n, start)


def wilder(x: Feature, n: int, start: int) -> Feature:
    return smooth(f"{x.name}_wil{n}{since(x, start)}", x, n, 1.0 / n, start)


def wilder_sum(x: Feature, n: int, start: int) -> Feature:
    """Decayed running sum: plain sum of the first n-1 values, then y = y·(1-1/n) + x."""
    at = start + n - 2
    name = f"{x.name}_wsum{n}{since(x, start)}"
    u = feature(f"{name}_u", [x], lambda: F.when(
        F.col("bar_idx") > at, F.coalesce(x.c, F.lit(0.0)))
        .when(F.col("bar_idx") == at, _first(x, start, n - 1)).otherwise(0.0), span=n)
    return affine(name, u, 1.0 - 1.0 / n, at + 1)


def affine_varying(name: str, coef: Feature, u: Feature, first: int, slowest: float) -> Feature:
    """y_i = m_i·y_{i-1} + u_i with a per-bar coefficient in (0, 1]: same scheme, with block
    products kept as logs. ``slowest`` is the largest coefficient that can persist."""
    reach = max(1, math.ceil(40.0 / (-math.log(slowest) * BLOCK)))
    lp = feature(f"{name}_lp", [coef], lambda: F.sum(F.ln(coef.c)).over(block_running()), span=BLOCK)
    p = feature(f"{name}_blk", [lp, u],
                lambda: F.exp(lp.c) * F.sum(u.c * F.exp(-lp.c)).over(block_running()), span=BLOCK)

    def e():
        end = F.when(F.pmod(F.col("bar_idx"), F.lit(BLOCK)) == BLOCK - 1,
                     F.struct(F.exp(lp.c).alias("m"), p.c.alias("y")))
        carry = F.aggregate(F.collect_list(end).over(blocks_before(reach)), F.lit(0.0),
                            lambda acc, v: acc * v["m"] + v["y"])
        return F.when(F.col("bar_idx") >= first, p.c + F.exp(lp.c) * carry)
    return feature(name, [p], e, first=first, params=(slowest,), span=(reach + 1) * BLOCK)


# ------------------------------------------------------------------ named indicators

def row(name: str, deps, fn, span: int = 0) -> Feature:
    """An expression over other features, of the same bar unless ``span`` says otherwise."""
    return feature(name, deps, fn, span=span)


RANGE = row("range", [HIGH, LOW], lambda: F.col("high") - F.col("low"))
BODY = row("body", [OPEN, CLOSE], lambda: F.col("close") - F.col("open"))
TYPICAL = row("typical", [HIGH, LOW, CLOSE],
              lambda: (F.col("high") + F.col("low") + F.col("close")) / 3.0)
MEDIAN = row("median_price", [HIGH, LOW], lambda: (F.col("high") + F.col("low")) / 2.0)
_PC = lag(CLOSE)
TRUE_RANGE = row("tr", [HIGH, LOW, _PC], lambda: F.when(_PC.c.isNotNull(), F.greatest(
    F.col("high") - F.col("low"), F.abs(F.col("high") - _PC.c), F.abs(F.col("low") - _PC.c))))


def atr(n: int) -> Feature:
    return wilder(TRUE_RANGE, n, 1)


def natr(n: int) -> Feature:
    a = atr(n)
    return row(f"natr{n}", [a, CLOSE], lambda: 100.0 * a.c / F.col("close"))


GAIN = row("gain", [CLOSE, _PC], lambda: F.when(_PC.c.isNotNull(), F.greatest(CLOSE.c - _PC.c, F.lit(0.0))))
LOSS = row("loss", [CLOSE, _PC], lambda: F.when(_PC.c.isNotNull(), F.greatest(_PC.c - CLOSE.c, F.lit(0.0))))


def rsi(n: int = 14) -> Feature:
    g, d = wilder(GAIN, n, 1), wilder(LOSS, n, 1)
    return row(f"rsi{n}", [g, d], lambda: F.when(g.c + d.c > 0, 100.0 * g.c / (g.c + d.c))
               .when(g.c.isNotNull(), 0.0))


def rsi_of(x: Feature, n: int = 14, start: int = 0) -> Feature:
    """RSI of any series; ``start`` is the first bar x is defined on."""
    p = lag(x)
    g = row(f"{x.name}_gain", [x, p], lambda: F.greatest(x.c - p.c, F.lit(0.0)) + (p.c - p.c))
    d = row(f"{x.name}_loss", [x, p], lambda: F.greatest(p.c - x.c, F.lit(0.0)) + (p.c - p.c))
    ag, ad = wilder(g, n, start + 1), wilder(d, n, start + 1)
    return row(f"{x.name}_rsi{n}{since(x, start)}", [ag, ad], lambda: F.when(
        ag.c + ad.c > 0, 100.0 * ag.c / (ag.c + ad.c)).when(ag.c.isNotNull(), 0.0))


def macd(fast: int = 12, slow: int = 26, sig: int = 9) -> tuple[Feature, Feature]:
    f, s = ema(CLOSE, fast), ema(CLOSE, slow)
    line = row(f"macd{fast}_{slow}", [f, s], lambda: f.c - s.c)
    return line, ema(line, sig, slow - 1)


def bbands(n: int = 20, k: float = 2.0) -> tuple[Feature, Feature, Feature]:
    m, s = sma(CLOSE, n), std(CLOSE, n)
    wide = "" if k == 2.0 else f"_k{number(k)}"
    return (row(f"bb_up{n}{wide}", [m, s], lambda: m.c + k * s.c), m,
            row(f"bb_lo{n}{wide}", [m, s], lambda: m.c - k * s.c))


def dmi(n: int = 14) -> tuple[Feature, Feature, Feature]:
    """(+DI, -DI, ADX)."""
    ph, pl = lag(HIGH), lag(LOW)
    up = lambda: HIGH.c - ph.c
    dn = lambda: pl.c - LOW.c
    pdm = row("plus_dm", [ph, pl], lambda: F.when((up() > 0) & (up() > dn()), up())
              .when(ph.c.isNotNull(), 0.0))
    mdm = row("minus_dm", [ph, pl], lambda: F.when((dn() > 0) & (dn() > up()), dn())
              .when(ph.c.isNotNull(), 0.0))
    sp, sm, st = (wilder_sum(x, n, 1) for x in (pdm, mdm, TRUE_RANGE))
    pdi = row(f"plus_di{n}", [sp, st], lambda: F.when(st.c > 0, 100.0 * sp.c / st.c)
              .when(st.c.isNotNull(), 0.0))
    mdi = row(f"minus_di{n}", [sm, st], lambda: F.when(st.c > 0, 100.0 * sm.c / st.c)
              .when(st.c.isNotNull(), 0.0))
    dx = row(f"dx{n}", [pdi, mdi], lambda: F.when(
        pdi.c + mdi.c > 0, 100.0 * F.abs(pdi.c - mdi.c) / (pdi.c + mdi.c))
        .when(pdi.c.isNotNull(), 0.0))
    return pdi, mdi, wilder(dx, n, n)


def aroon(n: int = 25) -> tuple[Feature, Feature]:
    """(up, down) over n+1 bars; the newest extreme wins a tie."""
    def age(pick, x, sgn):
        at = pick(F.struct(x.alias("x"), (F.col("bar_idx") * sgn).alias("i"))).over(rows(n + 1))
        return F.col("bar_idx") - at["i"] * sgn
    full = lambda: F.lag(HIGH.c, n).over(win()).isNotNull()
    up = row(f"aroon_up{n}", [HIGH, IDX], lambda: F.when(
        full(), 100.0 * (n - age(F.max, HIGH.c, 1)) / n), span=n)
    dn = row(f"aroon_dn{n}", [LOW, IDX], lambda: F.when(
        full(), 100.0 * (n - age(F.min, LOW.c, -1)) / n), span=n)
    return up, dn


def efficiency(n: int = 10) -> Feature:
    """|net move| / path length."""
    step = row("abs_step", [CLOSE, _PC], lambda: F.abs(CLOSE.c - _PC.c))
    path, back = rsum(step, n), lag(CLOSE, n)
    return row(f"er{n}", [path, back], lambda: F.when(path.c > 0, F.abs(CLOSE.c - back.c) / path.c))


def kama(n: int = 10) -> Feature:
    er = efficiency(n)
    fast, slow = 2.0 / 3.0, 2.0 / 31.0
    al = row(f"kama{n}_alpha", [er, IDX], lambda: F.when(
        F.col("bar_idx") >= n, F.pow(F.coalesce(er.c, F.lit(0.0)) * (fast - slow) + slow, 2.0)))
    m = row(f"kama{n}_m", [al], lambda: F.coalesce(1.0 - al.c, F.lit(1.0)))
    # as in ``trailing``: the distance from the price is scanned, seeded with 0 at bar n-1
    u = feature(f"kama{n}_u", [m, CLOSE], lambda: F.when(
        F.col("bar_idx") >= n, m.c * F.coalesce(CLOSE.c - F.lag(CLOSE.c, 1).over(win()), F.lit(0.0))).otherwise(0.0), span=1)
    d = affine_varying(f"kama{n}_d", m, u, n, 1.0 - slow ** 2)
    return row(f"kama{n}", [d, CLOSE], lambda: CLOSE.c - d.c)


def willr(n: int = 14) -> Feature:
    hh, ll = rmax(HIGH, n), rmin(LOW, n)
    return row(f"willr{n}", [hh, ll], lambda: F.when(
        hh.c > ll.c, -100.0 * (hh.c - CLOSE.c) / (hh.c - ll.c)).when(hh.c.isNotNull(), 0.0))


def cci(n: int = 20) -> Feature:
    mean = sma(TYPICAL, n)

    def e():
        arr = F.collect_list(TYPICAL.c).over(rows(n))
        mad = F.aggregate(arr, F.lit(0.0), lambda a, v: a + F.abs(v - mean.c)) / n
        return F.when(mean.c.isNotNull(), F.when(mad > 0, (TYPICAL.c - mean.c) / (0.015 * mad))
                      .otherwise(0.0))
    return feature(f"cci{n}", [TYPICAL, mean], e, span=n - 1)


SIGNED_VOLUME = row("obv_step", [CLOSE, _PC, VOLUME], lambda: F.when(
    _PC.c.isNull() & (F.col("bar_idx") == 0), VOLUME.c)
    .when(CLOSE.c > _PC.c, VOLUME.c).when(CLOSE.c < _PC.c, -VOLUME.c).otherwise(0.0))
# Chunk-relative: differs from the exact total by a constant per chunk. Used where only
# differences matter (against its own average or extremes); ``obv`` itself is operators.indicators.
OBV_REL = feature("obv_rel", [SIGNED_VOLUME], lambda: F.sum("obv_step").over(_run()))
CLV = row("clv", [HIGH, LOW, CLOSE], lambda: F.when(
    HIGH.c > LOW.c, ((CLOSE.c - LOW.c) - (HIGH.c - CLOSE.c)) / (HIGH.c - LOW.c)).otherwise(0.0))
AD_STEP = row("ad_step", [CLV, VOLUME], lambda: CLV.c * VOLUME.c)
AD_REL = feature("ad_rel", [AD_STEP], lambda: F.sum("ad_step").over(_run()))


def _run():
    from tidemark.operators.panel import running
    return running()


def adosc(fast: int = 3, slow: int = 10) -> Feature:
    """Difference of two averages of cumulative AD, both seeded at the first AD value."""
    f = trailing(f"ad_ema{fast}", AD_REL, fast, 0, seed="first")
    s = trailing(f"ad_ema{slow}", AD_REL, slow, 0, seed="first")
    return row(f"adosc{fast}_{slow}", [f, s], lambda: F.when(
        F.col("bar_idx") >= slow - 1, f.c - s.c))


def mfi(n: int = 14) -> Feature:
    p = lag(TYPICAL)
    pos = row("mf_pos", [p, TYPICAL, VOLUME], lambda: F.when(TYPICAL.c > p.c, TYPICAL.c * VOLUME.c)
              .when(p.c.isNotNull(), 0.0))
    neg = row("mf_neg", [p, TYPICAL, VOLUME], lambda: F.when(TYPICAL.c < p.c, TYPICAL.c * VOLUME.c)
              .when(p.c.isNotNull(), 0.0))
    a, b = rsum(pos, n), rsum(neg, n)
    return row(f"mfi{n}", [a, b], lambda: F.when(a.c + b.c > 0, 100.0 * a.c / (a.c + b.c))
               .when(a.c.isNotNull(), 0.0))


DAY_BARS = 1_440            # a day of the finest timeframe


def session_vwap() -> tuple[Feature, Feature, Feature]:
    """(vwap, volume-weighted σ, bar of the day), accumulated from UTC midnight."""
    from pyspark.sql import Window as W

    from tidemark.functions.clock import day_of
    from tidemark.operators.panel import KEYS
    day = row("utc_day", [TS], lambda: day_of(F.col("open_time_ms")))
    w = lambda: W.partitionBy(*KEYS, "utc_day").orderBy("bar_idx").rowsBetween(
        W.unboundedPreceding, 0)
    v = feature("sess_vol", [day], lambda: F.sum(VOLUME.c).over(w()), span=DAY_BARS)
    pv = feature("sess_pv", [day, TYPICAL], lambda: F.sum(TYPICAL.c * VOLUME.c).over(w()), span=DAY_BARS)
    pv2 = feature("sess_pv2", [day, TYPICAL], lambda: F.sum(TYPICAL.c * TYPICAL.c * VOLUME.c).over(w()), span=DAY_BARS)
    k = feature("sess_bar", [day], lambda: F.row_number().over(
                W.partitionBy(*KEYS, "utc_day").orderBy("bar_idx")), span=DAY_BARS)
    vwap = row("vwap", [v, pv], lambda: F.when(v.c > 0, pv.c / v.c))
    sd = row("vwap_sd", [vwap, pv2, v], lambda: F.when(
        v.c > 0, F.sqrt(F.greatest(pv2.c / v.c - vwap.c * vwap.c, F.lit(0.0)))))
    return vwap, sd, k


def session_open() -> Feature:
    from pyspark.sql import Window as W

    from tidemark.functions.clock import day_of
    from tidemark.operators.panel import KEYS
    day = row("utc_day", [TS], lambda: day_of(F.col("open_time_ms")))
    return feature("sess_open", [day, OPEN], lambda: F.first(OPEN.c).over(
        W.partitionBy(*KEYS, "utc_day").orderBy("bar_idx").rowsBetween(W.unboundedPreceding, 0)), span=DAY_BARS)


AO = row("ao", [sma(MEDIAN, 5), sma(MEDIAN, 34)],
         lambda: F.col("median_price_sma5") - F.col("median_price_sma34"))


def prior_extreme(high_side: bool, far: int = 100, near: int = 10) -> Feature:
    """Close and oscillator at the extreme close of bars [i-far, i-near]; first on ties."""
    tag = "hi" if high_side else "lo"
    at = row(f"prior_{tag}_at", [AO, CLOSE, IDX], lambda: F.struct(
        CLOSE.c.alias("c"), (F.col("bar_idx") * (-1 if high_side else 1)).alias("i"), AO.c.alias("ao")))
    away = "" if (far, near) == (100, 10) else f"_{far}_{near}"
    return _extreme(f"prior_{tag}{away}", at, far - near + 1, near, "max" if high_side else "min", CLOSE)


RS_TERM = row("rs_term", [OPEN, HIGH, LOW, CLOSE], lambda: F.when(
    (OPEN.c > 0) & (HIGH.c > 0) & (LOW.c > 0) & (CLOSE.c > 0),
    F.greatest(F.lit(0.0), F.ln(HIGH.c / CLOSE.c) * F.ln(HIGH.c / OPEN.c)
               + F.ln(LOW.c / CLOSE.c) * F.ln(LOW.c / OPEN.c))))


def rs_vol(n: int = 24) -> Feature:
    # summed in bar order for every window: quiet stretches give exactly equal values, which a
    # difference of running sums would blur, and the percentile rank counts ties
    m = feature(f"rs_mean{n}", [RS_TERM], lambda: guard(n, RS_TERM, F.sum(RS_TERM.c).over(rows(n)) / n, holes=True), span=n - 1)
    return row(f"rs_vol{n}", [m], lambda: F.sqrt(m.c))


def nvi_rel() -> Feature:
    """Negative volume index relative to the chunk start (a constant factor per chunk)."""
    pv = lag(VOLUME)
    f = row("nvi_factor", [_PC, pv, CLOSE, VOLUME], lambda: F.greatest(F.when(
        VOLUME.c < pv.c, F.when(_PC.c > 0, 1.0 + (CLOSE.c - _PC.c) / _PC.c).otherwise(1.0))
        .otherwise(1.0), F.lit(0.01)))
    return feature("nvi_rel", [f], lambda: F.lit(1000.0) * F.exp(F.sum(F.ln(f.c)).over(_run())))


# ------------------------------------------------------------------ swing structure

FR_HI = feature("fractal_hi", [HIGH], lambda: F.when(
    F.lag(HIGH.c, 4).over(win()).isNotNull() & (F.lag(HIGH.c, 2).over(win()) == F.max(HIGH.c).over(rows(5))),
    F.lag(HIGH.c, 2).over(win())), span=4)
FR_LO = feature("fractal_lo", [LOW], lambda: F.when(
    F.lag(LOW.c, 4).over(win()).isNotNull() & (F.lag(LOW.c, 2).over(win()) == F.min(LOW.c).over(rows(5))),
    F.lag(LOW.c, 2).over(win())), span=4)
SWING_HI, SWING_LO = ffill(FR_HI), ffill(FR_LO)
_PH, _PL = lag(SWING_HI), lag(SWING_LO)
SWING_HI2 = ffill(row("fractal_hi_prev", [FR_HI, _PH], lambda: F.when(FR_HI.c.isNotNull(), _PH.c)))
SWING_LO2 = ffill(row("fractal_lo_prev", [FR_LO, _PL], lambda: F.when(FR_LO.c.isNotNull(), _PL.c)))
STRUCT_STATE = row("struct_state", [SWING_HI, SWING_LO, SWING_HI2, SWING_LO2], lambda: F.when(
    (SWING_HI.c > SWING_HI2.c) & (SWING_LO.c > SWING_LO2.c), 1).when(
    (SWING_HI.c < SWING_HI2.c) & (SWING_LO.c < SWING_LO2.c), -1).otherwise(0))


def yes(cond: Column) -> Column:
    """Null-safe condition: undefined is false."""
    return F.coalesce(cond, F.lit(False))


def events(up: Column, dn: Column) -> Column:
    """±1 where exactly one side fires, 0 otherwise."""
    up, dn = yes(up), yes(dn)
    return F.when(up & ~dn, 1).when(dn & ~up, -1).otherwise(0)


def side(up: Column, dn: Column) -> Column:
    """Positions where the second assignment wins a tie."""
    return F.when(yes(dn), -1).when(yes(up), 1).otherwise(0)


def fresh(name: str, cond: Feature) -> Feature:
    """Rising edge of a boolean feature; the first bar keeps the condition."""
    return feature(name, [cond], lambda: cond.c & ~F.coalesce(F.lag(cond.c).over(win()), F.lit(False)), span=1)


# ------------------------------------------------------------------ candle shapes

# body/shadow yardsticks of the published candle definitions (10-bar averages).
CANDLE_WINDOW = 10
DOJI_FACTOR = 0.1
VERY_SHORT_SHADOW = 0.1
NEAR_FACTOR = 0.2
FAR_FACTOR = 0.6
NEAR_WINDOW = 5

ABS_BODY = row("abs_body", [BODY], lambda: F.abs(BODY.c))
UPPER = row("upper_wick", [OPEN, HIGH, CLOSE], lambda: HIGH.c - F.greatest(OPEN.c, CLOSE.c))
LOWER = row("lower_wick", [OPEN, LOW, CLOSE], lambda: F.least(OPEN.c, CLOSE.c) - LOW.c)


def _avg_before(x: Feature, n: int, skip: int = 1) -> Feature:
    """Mean of the n bars ending ``skip`` bars ago."""
    return feature(f"{x.name}_avg{n}_p{skip}", [x],
                   lambda: guard(n, x, F.avg(x.c).over(rows(n, skip)), skip), span=n - 1 + skip)


def engulfing() -> Feature:
    o1, c1 = lag(OPEN), lag(CLOSE)

    def e():
        white, black = CLOSE.c >= OPEN.c, CLOSE.c < OPEN.c
        pw, pb = c1.c >= o1.c, c1.c < o1.c
        bull = white & pb & (((CLOSE.c >= o1.c) & (OPEN.c < c1.c)) | ((CLOSE.c > o1.c) & (OPEN.c <= c1.c)))
        bear = black & pw & (((OPEN.c >= c1.c) & (CLOSE.c < o1.c)) | ((OPEN.c > c1.c) & (CLOSE.c <= o1.c)))
        return F.when(yes(bull), 1).when(yes(bear), -1).otherwise(0)
    return feature("cdl_engulfing", [o1, c1, OPEN, CLOSE], e)


def _bottom(k: int = 0) -> Column:
    return F.least(OPEN.c, CLOSE.c)


def hammer() -> Feature:
    """Short body, lower shadow longer than the body, tiny upper shadow, body near the prior low."""
    ab, ar = _avg_before(ABS_BODY, CANDLE_WINDOW), _avg_before(RANGE, CANDLE_WINDOW)
    near = _avg_before(RANGE, NEAR_WINDOW, 2)
    pl = lag(LOW)
    return feature("cdl_hammer", [ABS_BODY, ab, ar, near, pl, UPPER, LOWER], lambda: F.when(yes(
        (ABS_BODY.c < ab.c) & (LOWER.c > ABS_BODY.c) & (UPPER.c < VERY_SHORT_SHADOW * ar.c)
        & (F.least(OPEN.c, CLOSE.c) <= pl.c + NEAR_FACTOR * near.c)), 1).otherwise(0))


def shooting_star() -> Feature:
    """Short body gapped above the prior body, long upper shadow, tiny lower shadow."""
    ab, ar = _avg_before(ABS_BODY, CANDLE_WINDOW), _avg_before(RANGE, CANDLE_WINDOW)
    o1, c1 = lag(OPEN), lag(CLOSE)
    return feature("cdl_shooting_star", [ABS_BODY, ab, ar, o1, c1, UPPER, LOWER], lambda: F.when(yes(
        (ABS_BODY.c < ab.c) & (UPPER.c > ABS_BODY.c) & (LOWER.c < VERY_SHORT_SHADOW * ar.c)
        & (F.least(OPEN.c, CLOSE.c) > F.greatest(o1.c, c1.c))), -1).otherwise(0))


def closing_marubozu() -> Feature:
    """Long body closing at its extreme."""
    ab, ar = _avg_before(ABS_BODY, CANDLE_WINDOW), _avg_before(RANGE, CANDLE_WINDOW)
    return feature("cdl_marubozu", [ABS_BODY, ab, ar, UPPER, LOWER, BODY], lambda: F.when(
        yes((ABS_BODY.c > ab.c) & (BODY.c >= 0) & (UPPER.c < VERY_SHORT_SHADOW * ar.c)), 1).when(
        yes((ABS_BODY.c > ab.c) & (BODY.c < 0) & (LOWER.c < VERY_SHORT_SHADOW * ar.c)), -1)
        .otherwise(0))


def doji() -> Feature:
    ar = _avg_before(RANGE, CANDLE_WINDOW)
    return feature("cdl_doji", [ABS_BODY, ar], lambda: yes(ABS_BODY.c <= DOJI_FACTOR * ar.c))


def three_soldiers() -> Feature:
    """Three rising white bars with tiny upper shadows, each opening in the body before (or near
    it), none far shorter than the one before, the last not short."""
    o1, c1, o2, c2 = lag(OPEN), lag(CLOSE), lag(OPEN, 2), lag(CLOSE, 2)
    u1, u2 = lag(UPPER), lag(UPPER, 2)
    r0, r1, r2 = (_avg_before(RANGE, CANDLE_WINDOW, k) for k in (1, 2, 3))
    n1, n2 = _avg_before(RANGE, NEAR_WINDOW, 2), _avg_before(RANGE, NEAR_WINDOW, 3)
    ab = _avg_before(ABS_BODY, CANDLE_WINDOW)

    def e():
        b0, b1, b2 = CLOSE.c - OPEN.c, c1.c - o1.c, c2.c - o2.c
        return F.when(yes(
            (b0 >= 0) & (b1 >= 0) & (b2 >= 0)
            & (u2.c < VERY_SHORT_SHADOW * r2.c) & (u1.c < VERY_SHORT_SHADOW * r1.c)
            & (UPPER.c < VERY_SHORT_SHADOW * r0.c)
            & (CLOSE.c > c1.c) & (c1.c > c2.c)
            & (o1.c > o2.c) & (o1.c <= c2.c + NEAR_FACTOR * n2.c)
            & (OPEN.c > o1.c) & (OPEN.c <= c1.c + NEAR_FACTOR * n1.c)
            & (b1 > b2 - FAR_FACTOR * n2.c) & (b0 > b1 - FAR_FACTOR * n1.c)
            & (b0 > ab.c)), 1).otherwise(0)
    return feature("cdl_soldiers", [o1, c1, o2, c2, u1, u2, r0, r1, r2, n1, n2, ab, UPPER], e)


def three_crows() -> Feature:
    """After a white bar, three falling black bars with tiny lower shadows, each opening inside
    the body before, the first closing under the white bar's high."""
    o1, c1, o2, c2 = lag(OPEN), lag(CLOSE), lag(OPEN, 2), lag(CLOSE, 2)
    o3, c3, h3 = lag(OPEN, 3), lag(CLOSE, 3), lag(HIGH, 3)
    l1, l2 = lag(LOWER), lag(LOWER, 2)
    r0, r1, r2 = (_avg_before(RANGE, CANDLE_WINDOW, k) for k in (1, 2, 3))

    def e():
        return F.when(yes(
            (c3.c >= o3.c) & (c2.c < o2.c) & (c1.c < o1.c) & (CLOSE.c < OPEN.c)
            & (l2.c < VERY_SHORT_SHADOW * r2.c) & (l1.c < VERY_SHORT_SHADOW * r1.c)
            & (LOWER.c < VERY_SHORT_SHADOW * r0.c)
            & (o1.c < o2.c) & (o1.c > c2.c) & (OPEN.c < o1.c) & (OPEN.c > c1.c)
            & (h3.c > c2.c) & (c2.c > c1.c) & (c1.c > CLOSE.c)), -1).otherwise(0)
    return feature("cdl_crows", [o1, c1, o2, c2, o3, c3, h3, l1, l2, r0, r1, r2, LOWER], e)
