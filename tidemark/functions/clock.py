"""UTC bar grid: epoch milliseconds, timeframes, open/close rules, held-bar calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_MS = 60_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000

# The timeframes and their length in milliseconds.
TF_MS = {"1m": MINUTE_MS, "5m": 5 * MINUTE_MS, "15m": 15 * MINUTE_MS,
         "1h": HOUR_MS, "4h": 4 * HOUR_MS, "1d": DAY_MS}
TF_ROLE = {"1m": "SOURCE", "5m": "TRIGGER", "15m": "TRIGGER", "1h": "TRIGGER",
           "4h": "REGIME", "1d": "GATE"}


def as_ms(ts: Column | str) -> Column:
    """Epoch milliseconds of a timestamp column (NTZ columns are read as UTC)."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_millis(c.cast("timestamp"))


def tf_ms(tf: Column | str = "tf") -> Column:
    """Length of the timeframe named in a column, as a literal CASE (no lookup table)."""
    c = F.col(tf) if isinstance(tf, str) else tf
    out = F.lit(None).cast("long")
    for name, ms in TF_MS.items():
        out = F.when(c == name, F.lit(ms).cast("long")).otherwise(out)
    return out


def floor_to(ms: Column, step: Column | int) -> Column:
    """Largest grid point not after ``ms``."""
    step = F.lit(step).cast("long") if isinstance(step, int) else step
    return ms - F.pmod(ms, step)


def close_time(open_ms: Column, step: Column | int) -> Column:
    return open_ms + step - 1


def hour_of(ms: Column) -> Column:
    return F.pmod(F.floor(ms / HOUR_MS), F.lit(24)).cast("int")


def weekday_of(ms: Column) -> Column:
    """0 = Monday … 6 = Sunday (epoch day 0 was a Thursday)."""
    return F.pmod(F.floor(ms / DAY_MS) + 3, F.lit(7)).cast("int")


def day_of(ms: Column) -> Column:
    return F.floor(ms / DAY_MS).cast("long")


def date_of(ms: Column) -> Column:
    return F.date_from_unix_date(F.floor(ms / DAY_MS).cast("int"))


def last_friday(d: Column) -> Column:
    """Last Friday of the month of ``d``: the first Friday after (month end − 7 days)."""
    return F.next_day(F.date_sub(F.last_day(d), 7), "FRI")


def month_key(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM")
