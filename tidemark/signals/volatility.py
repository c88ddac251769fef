"""Volatility-regime signals."""

from pyspark.sql import functions as F

from tidemark.functions import features as X
from tidemark.functions.features import CLOSE, HIGH, LOW, OPEN, events, side, yes
from tidemark.operators import folds
from tidemark.signals.registry import sig

_I, _H = "15m/1h/4h", "1h/4h/1d"
_c = CLOSE
_up, _mid, _lo = X.bbands()
_e20, _e21, _e55 = X.ema(_c, 20), X.ema(_c, 21), X.ema(_c, 55)
_a10, _a14, _a20, _a22 = X.atr(10), X.atr(14), X.atr(20), X.atr(22)

_ok = X.row("sq_ok", [_up, _e20, _a20], lambda: (
    _up.c.isNotNull() & _e20.c.isNotNull() & _a20.c.isNotNull()).cast("int"))
_on = X.row("sq_on", [_up, _lo, _e20, _a20], lambda: yes(
    (_up.c < _e20.c + 1.5 * _a20.c) & (_lo.c > _e20.c - 1.5 * _a20.c)).cast("int"))
_on1 = X.lag(_on)
_sqe = X.row("sq_entry", [_on, _on1, _ok, _c, _mid], lambda: F.when(
    yes((_on1.c == 1) & (_on.c == 0) & (_ok.c == 1)), side(_c.c > _mid.c, _c.c < _mid.c)).otherwise(0))
sig("volatility.squeeze_bb_kc_release", _H, 200, [_sqe, _on, _c, _mid, _ok],
    lambda: F.col("pos_squeeze"), "Release of a volatility squeeze",
    "Compressed ranges resolve in one direction", fold=folds.SQUEEZE)

_rs = X.rank_pct(X.rs_vol(24), 252)
sig("volatility.rs_vol_pct_low_carry", _H, 300, [_rs, _c, _e55],
    lambda: side((_rs.c < 0.20) & (_c.c > _e55.c), (_rs.c < 0.20) & (_c.c < _e55.c)),
    "Quiet market, side of the average", "Calm regimes let trends run")
_bw = X.row("bb_width", [_up, _mid, _lo], lambda: F.when(_mid.c != 0, (_up.c - _lo.c) / _mid.c))
_bwr = X.rank_pct(_bw, 252)
sig("volatility.bbw_pct_low_carry", _H, 300, [_bwr, _c, _e55],
    lambda: side((_bwr.c < 0.20) & (_c.c > _e55.c), (_bwr.c < 0.20) & (_c.c < _e55.c)),
    "Narrow bands, side of the average", "Band width as the measure of calm")
_c3 = X.lag(_c, 3)
sig("volatility.rs_vol_pct_high_fade", _H, 300, [_rs, _c, _c3],
    lambda: side((_rs.c > 0.90) & (_c.c < _c3.c), (_rs.c > 0.90) & (_c.c > _c3.c)),
    "Fade the move in extreme volatility", "Panics overshoot")
sig("volatility.rs_vol_pct_high_carry", _H, 300, [_rs, _c, _c3],
    lambda: side((_rs.c > 0.90) & (_c.c > _c3.c), (_rs.c > 0.90) & (_c.c < _c3.c)),
    "Follow the move in extreme volatility", "The opposite claim, tested beside its twin")
_tr = X.TRUE_RANGE
_nr7 = X.row("is_nr7", [_tr, X.rmin(_tr, 7)], lambda: _tr.c <= F.col("tr_min7"))
_nr7p, _h1, _l1, _h2, _l2 = X.lag(_nr7), X.lag(HIGH), X.lag(LOW), X.lag(HIGH, 2), X.lag(LOW, 2)
sig("volatility.nr7_breakout", _I, 200, [_nr7p, _h1, _l1, _c],
    lambda: side(_nr7p.c & (_c.c > _h1.c), _nr7p.c & (_c.c < _l1.c)),
    "Break of the narrowest bar of seven", "Contraction precedes expansion")
sig("volatility.inside_bar_breakout", _I, 200, [_h1, _l1, _h2, _l2, _c],
    lambda: side((_h1.c < _h2.c) & (_l1.c > _l2.c) & (_c.c > _h1.c),
                 (_h1.c < _h2.c) & (_l1.c > _l2.c) & (_c.c < _l1.c)),
    "Break of a strictly inside bar", "A pause inside the previous range resolves")
_a14p, _rkp = X.lag(_a14), X.lag(X.rank_pct(_a14, 100))
sig("volatility.wide_range_thrust", _I, 200, [_tr, _a14p, _rkp, _c, OPEN],
    lambda: side((_rkp.c < 0.50) & (_tr.c > 2.0 * _a14p.c) & (_c.c > OPEN.c),
                 (_rkp.c < 0.50) & (_tr.c > 2.0 * _a14p.c) & (_c.c < OPEN.c)),
    "Wide bar out of a quiet market", "The first wide bar starts a regime")
_kok = X.row("kc_ok", [_e20, _a10], lambda: (_e20.c.isNotNull() & _a10.c.isNotNull()).cast("int"))
_kce = X.row("kc_entry", [_c, _e20, _a10],
             lambda: side(_c.c > _e20.c + 2.0 * _a10.c, _c.c < _e20.c - 2.0 * _a10.c))
sig("volatility.keltner_breakout", _H, 200, [_kce, _c, _e20, _kok], lambda: F.col("pos_keltner"),
    "Channel breakout until the average is lost", "A close outside the channel starts a run",
    fold=folds.KELTNER)
_hh, _ll = X.rmax(HIGH, 22), X.rmin(LOW, 22)
_chev = X.row("chandelier_ev", [_c, _hh, _ll, _a22],
              lambda: events(_c.c > _ll.c + 3.0 * _a22.c, _c.c < _hh.c - 3.0 * _a22.c))
_chh = X.hold(_chev)
sig("volatility.chandelier_atr_trail", "4h/1d", 200, [_chh], lambda: _chh.c,
    "Trailing stop hung from the extreme", "Stops scaled by volatility keep the trend")
_natr = X.rank_pct(X.natr(14), 252)
sig("volatility.natr_low_regime_trend", _H, 300, [_natr, _e21, _e55],
    lambda: side((_natr.c < 0.50) & (_e21.c > _e55.c), (_natr.c < 0.50) & (_e21.c < _e55.c)),
    "Trend in the calm half", "Trends are cleaner when volatility is below its median")
sig("volatility.natr_high_regime_trend", _H, 300, [_natr, _e21, _e55],
    lambda: side((_natr.c >= 0.50) & (_e21.c > _e55.c), (_natr.c >= 0.50) & (_e21.c < _e55.c)),
    "Trend in the volatile half", "The complement of the calm half")
sig("volatility.ema55_side_unfiltered", _H, 300, [_c, _e55], lambda: side(_c.c > _e55.c, _c.c < _e55.c),
    "Side of the 55 average, no filter", "Control for the filtered versions")
_chf = X.row("chandelier_pct_ev", [_c, _hh, _ll], lambda: events(
    _c.c > _ll.c * (1.0 + 0.06), _c.c < _hh.c * (1.0 - 0.06)))
_chfh = X.hold(_chf)
sig("volatility.chandelier_fixed_pct", "4h/1d", 200, [_chfh], lambda: _chfh.c,
    "Trailing stop at a fixed six percent", "Control for the volatility scaling")
