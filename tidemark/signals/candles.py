"""Candle-shape signals."""

from pyspark.sql import functions as F

from tidemark.functions import features as X
from tidemark.functions.features import CLOSE, HIGH, LOW, OPEN, side
from tidemark.signals.registry import sig

_I, _H, _ALL = "15m/1h/4h", "1h/4h/1d", "15m/1h/4h/1d"
_c = CLOSE
MIN_BARS = 320


def _add(name, tfs, deps, expr, title, rationale, warmup=200):
    sig(f"candles.{name}", tfs, warmup, deps, expr, title, rationale, min_bars=MIN_BARS)


_eng, _ham, _star, _mar, _doji = (X.engulfing(), X.hammer(), X.shooting_star(),
                                  X.closing_marubozu(), X.doji())
_sol, _crow = X.three_soldiers(), X.three_crows()
_e200, _rsi, _a14 = X.ema(_c, 200), X.rsi(14), X.atr(14)
_pdi, _mdi, _adx = X.dmi()

_add("engulfing_raw", _H, [_eng], lambda: _eng.c, "Engulfing bar", "One side overpowers the other")
_add("engulfing_trend", _H, [_eng, _c, _e200],
     lambda: side((_eng.c > 0) & (_c.c > _e200.c), (_eng.c < 0) & (_c.c < _e200.c)),
     "Engulfing bar with the trend", "The pattern only where the trend agrees", 300)
_add("hammer_oversold", _H, [_ham, _rsi], lambda: side((_ham.c > 0) & (_rsi.c < 30.0), F.lit(False)),
     "Hammer when oversold", "Rejection of lows after a decline")
_add("shooting_star_overbought", _H, [_star, _rsi],
     lambda: side(F.lit(False), (_star.c < 0) & (_rsi.c > 70.0)),
     "Shooting star when overbought", "Rejection of highs after a rise")
_cir = X.row("close_in_range", [_c, HIGH, LOW, X.RANGE],
             lambda: F.when(X.RANGE.c > 0, (_c.c - LOW.c) / X.RANGE.c))
_add("close_in_range", _ALL, [_cir], lambda: side(_cir.c >= 0.80, _cir.c <= 0.20),
     "Close near an extreme of the bar", "Where the bar closes shows who won")
_add("marubozu_continuation", _H, [_mar], lambda: _mar.c, "Long bar closing at its extreme",
     "Full conviction continues")
_add("doji_after_thrust", _H, [_doji, _pdi, _mdi, _adx],
     lambda: -side(_doji.c & (_adx.c > 25.0) & (_pdi.c > _mdi.c),
                   _doji.c & (_adx.c > 25.0) & (_mdi.c > _pdi.c)),
     "Doji against a strong trend", "Indecision after a thrust marks its end")
_add("outsized_wick", _ALL, [X.ABS_BODY, X.LOWER, X.UPPER, X.RANGE],
     lambda: side((X.RANGE.c > 0) & (X.LOWER.c >= 2.0 * X.ABS_BODY.c) & (X.LOWER.c >= 0.60 * X.RANGE.c),
                  (X.RANGE.c > 0) & (X.UPPER.c >= 2.0 * X.ABS_BODY.c) & (X.UPPER.c >= 0.60 * X.RANGE.c)),
     "Wick far longer than the body", "Rejected prices are avoided")
_a14p = X.lag(_a14)
_shock = X.row("range_shock", [X.TRUE_RANGE, _a14p, _c, OPEN], lambda: side(
    (_a14p.c > 0) & (X.TRUE_RANGE.c >= 2.0 * _a14p.c) & (_c.c > OPEN.c),
    (_a14p.c > 0) & (X.TRUE_RANGE.c >= 2.0 * _a14p.c) & (_c.c < OPEN.c)))
_add("range_expansion", _I, [X.hold_bars(_shock, 3)], lambda: F.col("range_shock_hold3"),
     "Bar twice the usual range", "Shocks carry on for a few bars")
_h1, _l1, _h2, _l2 = X.lag(HIGH), X.lag(LOW), X.lag(HIGH, 2), X.lag(LOW, 2)
_add("inside_bar_break", _H, [_c, _h1, _l1, _h2, _l2],
     lambda: side((_h1.c <= _h2.c) & (_l1.c >= _l2.c) & (_c.c > _h2.c),
                  (_h1.c <= _h2.c) & (_l1.c >= _l2.c) & (_c.c < _l2.c)),
     "Break of the bar around an inside bar", "A coiled bar resolves with the mother bar")
_add("range_gap", _I, [HIGH, LOW, _h1, _l1], lambda: side(HIGH.c < _l1.c, LOW.c > _h1.c),
     "Fade a gap between ranges", "Gaps fill")
_three = X.row("three_bars", [_sol, _crow], lambda: side(_sol.c > 0, _crow.c < 0))
_add("three_directional_bars", "4h/1d", [X.hold_bars(_three, 3)], lambda: F.col("three_bars_hold3"),
     "Three strong bars in a row", "Persistent pressure continues")
_sb, _sr = X.rsum(X.BODY, 20), X.rsum(X.RANGE, 20)
_add("body_flow_20", _H, [_sb, _sr],
     lambda: side((_sr.c > 0) & (_sb.c / _sr.c >= 0.30), (_sr.c > 0) & (_sb.c / _sr.c <= -0.30)),
     "Net body share of the range", "Bodies against ranges measure efficient pressure")
