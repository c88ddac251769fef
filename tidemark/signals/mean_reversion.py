"""Mean-reversion signals."""

from pyspark.sql import functions as F

from tidemark.functions import features as X
from tidemark.functions.features import CLOSE, HIGH, LOW, VOLUME, side
from tidemark.operators import folds
from tidemark.signals.registry import sig

_I, _H, _ALL = "15m/1h/4h", "1h/4h/1d", "15m/1h/4h/1d"
_c = CLOSE
_up, _mid, _lo = X.bbands()
_atr14, _adx = X.atr(14), X.dmi()[2]
_rsi = X.rsi(14)

sig("mean_reversion.bb20_2_fade", _I, 200, [_c, _up, _lo], lambda: side(_c.c < _lo.c, _c.c > _up.c),
    "Fade closes outside the bands", "Two-sigma closes overshoot")
sig("mean_reversion.bb20_2_reentry", _I, 200,
    [_c, _up, _mid, _lo, X.lag(_c), X.lag(_up), X.lag(_lo)], lambda: F.col("pos_band_reentry"),
    "Enter on the way back into the bands", "Waiting for the return avoids standing in a trend",
    fold=folds.BAND_REENTRY)
sig("mean_reversion.bb20_2_range_adx14", _H, 200, [_c, _up, _lo, _adx],
    lambda: side((_adx.c < 20.0) & (_c.c < _lo.c), (_adx.c < 20.0) & (_c.c > _up.c)),
    "Fade the bands only without a trend", "Reversion lives in ranges")
_e20 = X.ema(_c, 20)
sig("mean_reversion.keltner20_atr14_fade", _H, 200, [_c, _e20, _atr14],
    lambda: side(_c.c < _e20.c - 2.0 * _atr14.c, _c.c > _e20.c + 2.0 * _atr14.c),
    "Fade two ATR from the average", "True range measures stretch better than closes")
sig("mean_reversion.rsi14_fixed_3070", _H, 200, [_rsi], lambda: side(_rsi.c < 30.0, _rsi.c > 70.0),
    "Oversold and overbought", "The textbook oscillator rule")
_s200 = X.sma(_c, 200)
sig("mean_reversion.rsi14_cardwell_sma200", _H, 260, [_c, _rsi, _s200],
    lambda: side(((_c.c > _s200.c) & (_rsi.c < 40.0)) | ((_c.c <= _s200.c) & (_rsi.c < 20.0)),
                 ((_c.c > _s200.c) & (_rsi.c > 80.0)) | ((_c.c <= _s200.c) & (_rsi.c > 60.0))),
    "Oscillator thresholds shifted by regime", "The oscillator's range moves with the trend")
_wr = X.willr(14)
sig("mean_reversion.willr14_fade", _I, 200, [_wr], lambda: side(_wr.c < -80.0, _wr.c > -20.0),
    "Fade closes at the range extreme", "Closes at the extreme of the range overshoot")
_cci = X.cci(20)
sig("mean_reversion.cci20_fade", _I, 200, [_cci], lambda: side(_cci.c < -100.0, _cci.c > 100.0),
    "Fade large deviations of the typical price", "Deviation in units of mean absolute deviation")
_e200 = X.ema(_c, 200)
sig("mean_reversion.stretch_ema200_atr14", "4h/1d", 420, [_c, _e200, _atr14],
    lambda: side(_c.c < _e200.c - 3.0 * _atr14.c, _c.c > _e200.c + 3.0 * _atr14.c),
    "Fade three ATR from the slow average", "Far from the slow mean the pull is strongest")
_v20 = X.sma(VOLUME, 20)
sig("mean_reversion.bb20_2_volume_climax", _I, 200, [_c, VOLUME, _up, _lo, _v20],
    lambda: side((VOLUME.c > 2.0 * _v20.c) & (_c.c < _lo.c), (VOLUME.c > 2.0 * _v20.c) & (_c.c > _up.c)),
    "Fade the bands on a volume climax", "Forced flow ends moves")
_pmin, _pmax = X.rmin(LOW, 20, 1), X.rmax(HIGH, 20, 1)
sig("mean_reversion.sweep_rejection_20", _I, 200, [_c, HIGH, LOW, X.RANGE, _pmin, _pmax],
    lambda: side((_pmax.c.isNotNull()) & (X.RANGE.c > 0) & (LOW.c < _pmin.c)
                 & ((_c.c - LOW.c) / X.RANGE.c > 2.0 / 3.0),
                 (_pmin.c.isNotNull()) & (X.RANGE.c > 0) & (HIGH.c > _pmax.c)
                 & ((HIGH.c - _c.c) / X.RANGE.c > 2.0 / 3.0)),
    "Pierced extreme, close on the far side", "Stops taken and rejected reverse")
_c1, _c2, _c3 = X.lag(_c), X.lag(_c, 2), X.lag(_c, 3)
sig("mean_reversion.streak3_fade", _ALL, 200, [_c, _c1, _c2, _c3],
    lambda: side((_c.c < _c1.c) & (_c1.c < _c2.c) & (_c2.c < _c3.c),
                 (_c.c > _c1.c) & (_c1.c > _c2.c) & (_c2.c > _c3.c)),
    "Fade three closes in a row", "Short runs revert")
