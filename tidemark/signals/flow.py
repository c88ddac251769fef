"""Volume and order-flow proxies."""

from pyspark.sql import functions as F

from tidemark.functions import features as X
from tidemark.functions.features import CLOSE, HIGH, LOW, VOLUME, side
from tidemark.signals.registry import sig

_I, _H, _ALL = "15m/1h/4h", "1h/4h/1d", "15m/1h/4h/1d"
_c, _v = CLOSE, VOLUME
_obv, _tr, _a14 = X.OBV_REL, X.TRUE_RANGE, X.atr(14)
_obve = X.ema(_obv, 21)

sig("flow.obv_ema21", _H, 200, [_obv, _obve], lambda: side(_obv.c > _obve.c, _obv.c < _obve.c),
    "Volume balance against its average", "Accumulated volume leads price", min_bars=60)
_cx, _cn, _ox, _on = X.rmax(_c, 20), X.rmin(_c, 20), X.rmax(_obv, 20), X.rmin(_obv, 20)
_div = X.row("obv_div", [_c, _obv, _cx, _cn, _ox, _on], lambda: -side(
    (_c.c >= _cx.c) & (_obv.c < _ox.c), (_c.c <= _cn.c) & (_obv.c > _on.c)))
sig("flow.obv_divergence20", _H, 200, [X.hold_bars(_div, 5)], lambda: F.col("obv_div_hold5"),
    "Price extreme without volume extreme", "Moves without volume behind them fade", min_bars=60)
_lead = X.row("obv_lead", [_c, _obv, _cx, _cn, _ox, _on], lambda: side(
    (_obv.c >= _ox.c) & (_c.c < _cx.c), (_obv.c <= _on.c) & (_c.c > _cn.c)))
sig("flow.obv_leads20", _H, 200, [X.hold_bars(_lead, 5)], lambda: F.col("obv_lead_hold5"),
    "Volume extreme before the price extreme", "Volume breaks out first", min_bars=60)
_mfi = X.mfi(14)
sig("flow.mfi14_extremes", _ALL, 200, [_mfi], lambda: side(_mfi.c < 20.0, _mfi.c > 80.0),
    "Money-flow extremes faded", "An oscillator weighted by traded value", min_bars=40)
_vw, _sd, _k = X.session_vwap()
sig("flow.vwap_session_side", _I, 200, [_vw, _c], lambda: side(_c.c > _vw.c, _c.c < _vw.c),
    "Side of the session average price", "Who is in profit today sets the tone", min_bars=10)
sig("flow.vwap_band2sigma", "15m/1h", 200, [_vw, _sd, _k, _c],
    lambda: -side((_sd.c > 0) & (_k.c >= 12) & (_c.c > _vw.c + 2.0 * _sd.c),
                  (_sd.c > 0) & (_k.c >= 12) & (_c.c < _vw.c - 2.0 * _sd.c)),
    "Fade two sigma from the session average", "Intraday stretch returns to the average", min_bars=40)
_v20 = X.sma(_v, 20)
_busy = lambda: (_v20.c > 0) & (_v.c / _v20.c > 2.0) & (_a14.c > 0)
_thrust = X.row("vol_thrust", [_v, _v20, _a14, _tr, X.CLV], lambda: side(
    _busy() & (_tr.c > _a14.c) & (X.CLV.c > 0.5), _busy() & (_tr.c > _a14.c) & (X.CLV.c < -0.5)))
sig("flow.volume_thrust", _I, 200, [X.hold_bars(_thrust, 5)], lambda: F.col("vol_thrust_hold5"),
    "Wide bar on double volume", "Aggressive volume continues", min_bars=60)
_lv = X.row("ln_volume", [_v], lambda: F.log1p(_v.c))
_lm, _ls = X.sma(_lv, 100), X.std(_lv, 100)
_climax = X.row("vol_climax", [_lv, _lm, _ls, _c, _cx, _cn], lambda: F.when(
    X.yes((_ls.c > 0) & ((_lv.c - _lm.c) / _ls.c > 3.0)),
    F.when(_c.c <= _cn.c, 1).when(_c.c >= _cx.c, -1).otherwise(0)).otherwise(0))
sig("flow.volume_climax", _ALL, 200, [X.hold_bars(_climax, 5)], lambda: F.col("vol_climax_hold5"),
    "Fade a volume spike at an extreme", "Exhaustion prints the largest volume", min_bars=140)
_osc = X.adosc()
sig("flow.chaikin_osc_3_10", _H, 200, [_osc], lambda: side(_osc.c > 0, _osc.c < 0),
    "Sign of the accumulation oscillator", "Closing location weighted by volume", min_bars=40)
_r20, _r5, _v5, _v100 = X.roc(_c, 20), X.roc(_c, 5), X.sma(_v, 5), X.sma(_v, 100)
sig("flow.trend_with_participation", "4h/1d", 200, [_r20, _v20, _v100],
    lambda: side((_v20.c > _v100.c) & (_r20.c > 0), (_v20.c > _v100.c) & (_r20.c < 0)),
    "Trend while volume expands", "Rising participation sustains a move", min_bars=140)
sig("flow.move_without_volume", _I, 200, [_r5, _v5, _v20],
    lambda: -side((_v20.c > 0) & (_v5.c < _v20.c) & (_r5.c > 0),
                  (_v20.c > 0) & (_v5.c < _v20.c) & (_r5.c < 0)),
    "Fade a move on shrinking volume", "Nobody is behind it", min_bars=40)
_abs = X.row("vol_absorb", [_v, _v20, _a14, _tr, X.CLV], lambda: side(
    _busy() & (_tr.c < _a14.c) & (X.CLV.c > 0), _busy() & (_tr.c < _a14.c) & (X.CLV.c < 0)))
sig("flow.absorption_narrow_range", _I, 200, [X.hold_bars(_abs, 5)], lambda: F.col("vol_absorb_hold5"),
    "Heavy volume in a narrow bar", "Resting orders absorb the flow", min_bars=60)
_nvi = X.nvi_rel()
_nve = X.ema(_nvi, 255)
sig("flow.nvi_fosback", "1d", 600, [_nvi, _nve], lambda: side(_nvi.c > _nve.c, F.lit(False)),
    "Quiet-day index above its yearly average", "Quiet days show the patient buyers", min_bars=400)
sig("flow.roc20_unfiltered", _H, 200, [_r20], lambda: side(_r20.c > 0, _r20.c < 0),
    "Sign of the 20-bar change, no filter", "Control for the volume filters", min_bars=40)
