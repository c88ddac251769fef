"""Trend-following signals."""

from pyspark.sql import functions as F

from tidemark.functions import features as X
from tidemark.functions.features import CLOSE, HIGH, LOW, side
from tidemark.operators import folds
from tidemark.signals.registry import sig

_ALL = "15m/1h/4h/1d"
_c = CLOSE
_e21, _e55, _e200 = X.ema(_c, 21), X.ema(_c, 55), X.ema(_c, 200)

sig("trend.ema_cross_21_55", _ALL, 250, [_e21, _e55],
    lambda: side(_e21.c > _e55.c, _e21.c < _e55.c),
    "Fast average against slow average", "A shorter average above a longer one marks an up-move")
sig("trend.ema_stack_21_55_200", _ALL, 600, [_e21, _e55, _e200],
    lambda: side((_e21.c > _e55.c) & (_e55.c > _e200.c), (_e21.c < _e55.c) & (_e55.c < _e200.c)),
    "Three averages in order", "Agreement of three horizons filters sideways markets")
sig("trend.ema200_filter", _ALL, 600, [_c, _e200], lambda: side(_c.c > _e200.c, _c.c < _e200.c),
    "Side of the 200 average", "Long moves keep price on one side of a slow average")
_line, _signal = X.macd()
sig("trend.macd_12_26_9", _ALL, 250, [_line, _signal],
    lambda: side(_line.c > _signal.c, _line.c < _signal.c),
    "MACD against its signal line", "A widening spread of averages leads the trend")
_pdi, _mdi, _adx = X.dmi()
sig("trend.adx_dmi_14", _ALL, 250, [_pdi, _mdi, _adx],
    lambda: side((_adx.c >= 25.0) & (_pdi.c > _mdi.c), (_adx.c >= 25.0) & (_mdi.c > _pdi.c)),
    "Directional leader in a strong trend", "Directional movement matters only when ADX is high")
_ch = [_c, X.rmax(HIGH, 55, 1), X.rmin(LOW, 55, 1), X.rmax(HIGH, 20, 1), X.rmin(LOW, 20, 1)]
sig("trend.donchian_turtle_55_20", _ALL, 250, _ch, lambda: F.col("pos_turtle"),
    "Channel entry 55, exit 20, reversible", "Breakouts of long ranges start trends",
    fold=folds.TURTLE)
_atr14 = X.atr(14)
_up = X.row("st_up", [X.MEDIAN, _atr14], lambda: X.MEDIAN.c + 3.0 * _atr14.c)
_lo = X.row("st_lo", [X.MEDIAN, _atr14], lambda: X.MEDIAN.c - 3.0 * _atr14.c)
sig("trend.supertrend_atr14_x3", _ALL, 250, [_c, _up, _lo], lambda: F.col("pos_supertrend"),
    "Ratcheting volatility bands", "A trailing band only gives way when the trend breaks",
    fold=folds.SUPERTREND)
sig("trend.psar_002_020", _ALL, 250, [HIGH, LOW, _c],
    lambda: side(_c.c > F.col("sar"), _c.c < F.col("sar")),
    "Parabolic stop side", "An accelerating stop follows the move", fold=folds.SAR)
_sl55 = X.slope(_c, 55)
sig("trend.linreg_slope_55_atr14", _ALL, 250, [_sl55, _atr14],
    lambda: side((_atr14.c > 0) & (_sl55.c * 55.0 / _atr14.c > 1.0),
                 (_atr14.c > 0) & (_sl55.c * 55.0 / _atr14.c < -1.0)),
    "Regression drift larger than noise", "Drift over 55 bars measured in ATR units")
_tenkan = X.row("tenkan", [X.rmax(HIGH, 9), X.rmin(LOW, 9)],
                lambda: (F.col("high_max9") + F.col("low_min9")) / 2.0)
_kijun = X.row("kijun", [X.rmax(HIGH, 26), X.rmin(LOW, 26)],
               lambda: (F.col("high_max26") + F.col("low_min26")) / 2.0)
_mid = X.row("span_a0", [_tenkan, _kijun], lambda: (_tenkan.c + _kijun.c) / 2.0)
_far = X.row("span_b0", [X.rmax(HIGH, 52), X.rmin(LOW, 52)],
             lambda: (F.col("high_max52") + F.col("low_min52")) / 2.0)
_sa, _sb = X.lag(_mid, 26), X.lag(_far, 26)
sig("trend.ichimoku_kumo", _ALL, 250, [_c, _tenkan, _kijun, _sa, _sb],
    lambda: side(_sa.c.isNotNull() & _sb.c.isNotNull() & (_c.c > F.greatest(_sa.c, _sb.c))
                 & (_tenkan.c > _kijun.c),
                 _sa.c.isNotNull() & _sb.c.isNotNull() & (_c.c < F.least(_sa.c, _sb.c))
                 & (_tenkan.c < _kijun.c)),
    "Outside the cloud with the lines agreeing", "Old range midpoints act as a moving border")
_au, _ad = X.aroon(25)
sig("trend.aroon_25", _ALL, 250, [_au, _ad],
    lambda: side((_au.c > 70.0) & (_ad.c < 30.0), (_ad.c > 70.0) & (_au.c < 30.0)),
    "Recency of extremes", "Fresh highs with stale lows mark an up-trend")
_y = X.lag(_c, 365)
sig("trend.tsmom_365d", "1d", 420, [_c, _y],
    lambda: side((_y.c > 0) & (_c.c > _y.c), (_y.c > 0) & (_c.c < _y.c)),
    "Above or below a year ago", "Yearly momentum persists across assets", "weakly positive")
