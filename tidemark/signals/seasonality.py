"""Calendar signals. The calendar is that of the bar during which the position is HELD."""

from pyspark.sql import functions as F

from tidemark.functions import features as X
from tidemark.functions.clock import (DAY_MS, date_of, day_of, hour_of, last_friday, tf_ms,
                                      weekday_of)
from tidemark.functions.features import CLOSE, side
from tidemark.operators.panel import rows
from tidemark.signals.registry import sig

# Supply-halving times, UTC epoch milliseconds
# (2012-11-28 15:24, 2016-07-09 16:46, 2020-05-11 19:23, 2024-04-20 00:09).
HALVINGS_MS = (1354116240000, 1468082760000, 1589225040000, 1713571740000)

_held = X.row("held_ms", [X.TS], lambda: F.col("open_time_ms") + tf_ms("tf"))
_hour = X.row("held_hour", [_held], lambda: hour_of(_held.c))
_wd = X.row("held_weekday", [_held], lambda: weekday_of(_held.c))
_date = X.row("held_date", [_held], lambda: date_of(_held.c))
NO = F.lit


def _add(name, tfs, deps, expr, title, rationale):
    sig(f"seasonality.{name}", tfs, 200, deps, expr, title, rationale)


_add("us_cash_hours_long", "15m/1h", [_hour], lambda: side(_hour.c.between(13, 20), NO(False)),
     "Long during US cash hours", "Most flow arrives when US desks are open")
_add("asia_hours_short", "15m/1h", [_hour], lambda: side(NO(False), _hour.c.between(0, 7)),
     "Short during Asian hours", "Thin hours drift against the day")
_so = X.session_open()
_add("overlap_day_trend", "15m/1h", [_hour, _so, CLOSE],
     lambda: side(_hour.c.between(13, 16) & (CLOSE.c - _so.c > 0),
                  _hour.c.between(13, 16) & (CLOSE.c - _so.c < 0)),
     "Day's direction during the overlap", "The overlap continues the morning")
_add("weekend_short", "1h/4h/1d", [_wd], lambda: side(NO(False), _wd.c >= 5),
     "Short at weekends", "Liquidity leaves")
_add("friday_derisk_short", "15m/1h", [_wd, _hour], lambda: side(NO(False), (_wd.c == 4) & (_hour.c >= 18)),
     "Short on Friday evening", "Risk is cut before the weekend")
_a14 = X.atr(14)
_ref = X.feature("friday_close", [X.TS, CLOSE], lambda: F.last(F.when(
    (weekday_of(F.col("open_time_ms")) == 4) & (hour_of(F.col("open_time_ms")) == 21), CLOSE.c),
    ignorenulls=True).over(rows(97)), span=96)


def _cme():
    gap = CLOSE.c - _ref.c
    window = ((_wd.c == 6) & (_hour.c >= 22)) | ((_wd.c == 0) & (_hour.c <= 11))
    big = window & (F.abs(gap) > _a14.c)
    return -side(big & (gap > 0), big & (gap < 0))


_add("cme_gap_monday", "1h", [_wd, _hour, _ref, _a14, CLOSE], _cme,
     "Fade the weekend gap", "Futures reopen and pull price back to Friday's close")
_r8 = X.roc(CLOSE, 8)
_add("pre_funding_fade", "1h", [_hour, _r8],
     lambda: -side(_hour.c.isin(7, 15, 23) & (_r8.c > 0), _hour.c.isin(7, 15, 23) & (_r8.c < 0)),
     "Fade the move before funding", "Payers close before they pay")
_add("turn_of_month_long", "4h/1d", [_date],
     lambda: side((F.dayofmonth(_date.c) <= 3) | (_date.c == F.last_day(_date.c)), NO(False)),
     "Long around the turn of the month", "Regular inflows arrive at month end")
_to = lambda: F.datediff(last_friday(_date.c), _date.c)
_add("pre_quarterly_expiry_short", "4h/1d", [_date],
     lambda: side(NO(False), F.month(_date.c).isin(3, 6, 9, 12) & _to().between(1, 7)),
     "Short before quarterly expiry", "Positions are unwound into expiry")


def _since_expiry():
    this = last_friday(_date.c)
    prev = last_friday(F.add_months(F.trunc(_date.c, "month"), -1))
    return F.datediff(_date.c, F.when(_date.c >= this, this).otherwise(prev))


_add("post_monthly_expiry_long", "4h/1d", [_date],
     lambda: side(_since_expiry().between(1, 3), NO(False)),
     "Long after monthly expiry", "Hedging pressure lifts after expiry")


def _halving():
    t = _held.c
    last = F.lit(None).cast("long")
    for h in HALVINGS_MS:                      # ascending: the last one not after t remains
        last = F.when(t >= h, F.lit(h)).otherwise(last)
    days = F.floor((t - last) / DAY_MS)
    return side(days.between(180, 540), (days > 540) & (days <= 900))


_add("halving_cycle_phase", "1d", [_held], _halving,
     "Phase of the supply cycle", "Supply shocks reach price with a delay")
