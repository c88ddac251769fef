"""Momentum signals."""

from pyspark.sql import functions as F

from tidemark.functions import features as X
from tidemark.functions.features import CLOSE, VOLUME, side
from tidemark.signals.registry import sig

_H = "1h/4h/1d"
_c = CLOSE
_r10, _r20 = X.roc(_c, 10), X.roc(_c, 20)

_m1, _m12 = X.lag(_c, 30), X.lag(_c, 360)
sig("momentum.tsmom_12_1", "1d", 420, [_m1, _m12],
    lambda: side((_m12.c > 0) & (_m1.c / _m12.c - 1.0 > 0), (_m12.c > 0) & (_m1.c / _m12.c - 1.0 < 0)),
    "Twelve-month momentum skipping the last month", "The last month tends to revert, the year to persist")
_q1, _q3, _q6 = X.roc(_c, 30), X.roc(_c, 90), X.roc(_c, 180)
sig("momentum.tsmom_consensus", "1d", 240, [_q1, _q3, _q6],
    lambda: side((_q1.c > 0) & (_q3.c > 0) & (_q6.c > 0), (_q1.c < 0) & (_q3.c < 0) & (_q6.c < 0)),
    "Three horizons agree", "Agreement of horizons is rarer and cleaner than any one of them")
sig("momentum.roc10", _H, 200, [_r10], lambda: side(_r10.c > 0, _r10.c < 0),
    "Sign of the 10-bar change", "The plainest momentum rule")
sig("momentum.roc_term_structure", _H, 200, [_r10, _r20],
    lambda: side((_r20.c / 20.0 > 0) & (_r10.c / 10.0 > _r20.c / 20.0),
                 (_r20.c / 20.0 < 0) & (_r10.c / 10.0 < _r20.c / 20.0)),
    "Short rate faster than long rate", "Acceleration per bar in the direction of the move")
sig("momentum.ao_sign", _H, 200, [X.AO], lambda: side(X.AO.c > 0, X.AO.c < 0),
    "Sign of the awesome oscillator", "Median-price momentum without closes")
_hi, _lo = X.prior_extreme(True), X.prior_extreme(False)
sig("momentum.ao_confirms_extreme", "4h/1d", 200, [_c, X.AO, _hi, _lo],
    lambda: side((_c.c > _hi.c["c"]) & (X.AO.c > _hi.c["ao"]) & (X.AO.c > 0),
                 (_c.c < _lo.c["c"]) & (X.AO.c < _lo.c["ao"]) & (X.AO.c < 0)),
    "New extreme confirmed by the oscillator", "A new extreme with more momentum behind it continues")
# the long side is assigned last here, so it wins a tie
sig("momentum.ao_divergence_extreme", "4h/1d", 200, [_c, X.AO, _hi, _lo],
    lambda: -side((_c.c > _hi.c["c"]) & (X.AO.c < _hi.c["ao"]) & (X.AO.c > 0) & (_hi.c["ao"] > 0),
                  (_c.c < _lo.c["c"]) & (X.AO.c > _lo.c["ao"]) & (X.AO.c < 0) & (_lo.c["ao"] < 0)),
    "New extreme not confirmed by the oscillator", "A new extreme on less momentum fades")
_lnc = X.row("ln_close", [_c], lambda: F.when(_c.c > 0, F.ln(_c.c)))
_s20 = X.slope(_lnc, 20)
_s20b = X.lag(_s20, 20)
sig("momentum.linreg_acceleration", _H, 200, [_s20, _s20b],
    lambda: side((_s20.c > 0) & (_s20.c - _s20b.c > 0), (_s20.c < 0) & (_s20.c - _s20b.c < 0)),
    "Slope and its change agree", "A trend that is still gaining pace")
_c1 = X.lag(_c)
_upb = X.row("is_up", [_c, _c1], lambda: F.coalesce((_c.c > _c1.c).cast("double"), F.lit(0.0)))
_dnb = X.row("is_down", [_c, _c1], lambda: F.coalesce((_c.c < _c1.c).cast("double"), F.lit(0.0)))
_nu, _nd = X.rsum(_upb, 20), X.rsum(_dnb, 20)
sig("momentum.sign_persistence", _H, 200, [_nu, _nd], lambda: side(_nu.c >= 14, _nd.c >= 14),
    "Share of rising closes", "Many small steps one way beat one large one")
_er, _c10 = X.efficiency(10), X.lag(_c, 10)
sig("momentum.er_kaufman_filtered", _H, 200, [_c, _er, _c10],
    lambda: side((_er.c >= 0.30) & (_c.c - _c10.c > 0), (_er.c >= 0.30) & (_c.c - _c10.c < 0)),
    "Momentum along an efficient path", "A straight path carries more information than a noisy one")
_k = X.kama(10)
sig("momentum.kama_cross", _H, 200, [_c, _k], lambda: side(_c.c > _k.c, _c.c < _k.c),
    "Side of the adaptive average", "An average that slows down in noise")
_v5, _v20 = X.sma(VOLUME, 5), X.sma(VOLUME, 20)
sig("momentum.momentum_with_volume", _H, 200, [_r20, _v5, _v20],
    lambda: side((_v20.c > 0) & (_v5.c > _v20.c) & (_r20.c > 0),
                 (_v20.c > 0) & (_v5.c > _v20.c) & (_r20.c < 0)),
    "Momentum on rising volume", "Participation separates moves from drift")
