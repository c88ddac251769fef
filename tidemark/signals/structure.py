"""Market-structure signals: channels, swings, retests."""

from pyspark.sql import functions as F

from tidemark.functions import features as X
from tidemark.functions.features import CLOSE, HIGH, LOW, VOLUME, events, yes
from tidemark.operators import folds
from tidemark.signals.registry import sig

_I, _H, _ALL = "15m/1h/4h", "1h/4h/1d", "15m/1h/4h/1d"
_c = CLOSE
_hh, _ll = X.rmax(HIGH, 20, 1), X.rmin(LOW, 20, 1)
_hi, _lo, _hi2, _lo2 = X.SWING_HI, X.SWING_LO, X.SWING_HI2, X.SWING_LO2


def _held(name, deps, up, dn):
    return X.hold(X.row(name, deps, lambda: events(up(), dn())))


def _timed(name, deps, up, dn, n=10):
    return X.hold_bars(X.row(name, deps, lambda: events(up(), dn())), n)


def _add(name, tfs, f, title, rationale):
    sig(f"structure.{name}", tfs, 200, [f], lambda: f.c, title, rationale, min_bars=200)


_add("donchian_break_20", _ALL, _held("dc20_ev", [_c, _hh, _ll], lambda: _c.c > _hh.c,
                                      lambda: _c.c < _ll.c),
     "Last 20-bar channel break", "Breaks of the range set the direction")
_ch = [_c, X.rmax(HIGH, 55, 1), X.rmin(LOW, 55, 1), _hh, _ll]
sig("structure.donchian_55_exit_20", _ALL, 200, _ch, lambda: F.col("pos_channel_flat"),
    "Channel entry 55, exit 20 to flat", "Leave on the short channel, wait for the long one",
    min_bars=200, fold=folds.CHANNEL_FLAT)
_add("bos_swing", _H, _held("bos_ev", [_c, _hi, _lo], lambda: _c.c > _hi.c, lambda: _c.c < _lo.c),
     "Break of the last swing", "A broken swing continues")
_upseq = lambda: yes((_hi.c > _hi2.c) & (_lo.c > _lo2.c))
_dnseq = lambda: yes((_hi.c < _hi2.c) & (_lo.c < _lo2.c))
_add("choch", _H, _held("choch_ev", [_c, _hi, _lo, _hi2, _lo2],
                        lambda: _dnseq() & (_c.c > _hi.c), lambda: _upseq() & (_c.c < _lo.c)),
     "First break against the sequence", "The first failed swing turns the trend")
_add("swing_trend_state", _H, X.STRUCT_STATE, "Higher or lower swings", "The definition of a trend")
_add("sweep_reversal_20", _I, _timed("sweep_ev", [_c, HIGH, LOW, _hh, _ll],
                                     lambda: (LOW.c < _ll.c) & (_c.c > _ll.c),
                                     lambda: (HIGH.c > _hh.c) & (_c.c < _hh.c)),
     "Pierced channel closed back inside", "Stop hunts reverse")
sig("structure.retest_hold", _ALL, 200, [_c, HIGH, LOW, _hh, _ll], lambda: F.col("pos_retest"),
    "Broken level retested and held", "A level that holds on the way back confirms the break",
    min_bars=200, fold=folds.RETEST)
_w = X.row("channel_width", [_hh, _ll], lambda: _hh.c - _ll.c)
_wmin = X.rmin(_w, 60)
_add("compression_break", _ALL, _held("comp_ev", [_c, _hh, _ll, _w, _wmin],
                                      lambda: (_w.c <= _wmin.c) & (_c.c > _hh.c),
                                      lambda: (_w.c <= _wmin.c) & (_c.c < _ll.c)),
     "Break of the narrowest channel", "The tighter the range the cleaner the break")
_v20 = X.sma(VOLUME, 20)
_add("volume_confirmed_break", _ALL, _held("vcb_ev", [_c, _hh, _ll, VOLUME, _v20],
                                           lambda: (_c.c > _hh.c) & (VOLUME.c > _v20.c),
                                           lambda: (_c.c < _ll.c) & (VOLUME.c > _v20.c)),
     "Channel break on volume", "Volume separates breaks from noise")
_a14 = X.atr(14)
_add("atr_buffered_break", _ALL, _held("abb_ev", [_c, _hh, _ll, _a14],
                                       lambda: _c.c > _hh.c + 0.5 * _a14.c,
                                       lambda: _c.c < _ll.c - 0.5 * _a14.c),
     "Channel break by half an ATR", "A margin filters marginal breaks")
_above = X.row("above_swing", [_c, _hi], lambda: yes(_c.c > _hi.c))
_below = X.row("below_swing", [_c, _lo], lambda: yes(_c.c < _lo.c))
_fa, _fb = X.fresh("above_swing_new", _above), X.fresh("below_swing_new", _below)
_add("range_fade_swing", _I, _timed("rfs_ev", [_fa, _fb, X.STRUCT_STATE],
                                    lambda: (X.STRUCT_STATE.c == 0) & _fb.c,
                                    lambda: (X.STRUCT_STATE.c == 0) & _fa.c),
     "First touch beyond a swing in a mixed structure", "Without a trend the extremes hold")
_add("swing_fade_unfiltered", _I, _timed("sfu_ev", [_fa, _fb], lambda: _fb.c, lambda: _fa.c),
     "First touch beyond any swing", "Control for the structure filter")
