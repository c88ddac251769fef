"""Building blocks for user rules: an allow-list of series and functions, null-safe conditions.

A rule is a pair of conditions over named features. Every comparison is false where an input is
undefined, so ``~where(a > b)`` is true there, as a reader of the rule would expect.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import features as X
from tidemark.functions.features import Feature, feature
from tidemark.operators.indicators import compute
from tidemark.operators.panel import Panel

RULE_SERIES: dict[str, Feature] = {
    "close": X.CLOSE, "open": X.OPEN, "high": X.HIGH, "low": X.LOW, "volume": X.VOLUME,
    "atr": X.atr(14), "range": X.RANGE, "body": X.BODY}

sma, std, highest, lowest, change = X.sma, X.std, X.rmax, X.rmin, X.roc
MIN_ACTIVE, MIN_BARS = 30, 400


def ema(x: Feature, n: int) -> Feature:
    return X.ema(x, n, x.first)


def rsi(x: Feature, n: int = 14) -> Feature:
    return X.rsi_of(x, n, x.first)


def shift(x: Feature, n: int = 1) -> Feature:
    """The value n bars ago; 0 is x itself, negative would be the future and is refused."""
    if n < 0:
        raise ValueError("shift() takes no negative n: that would read the future")
    return x if n == 0 else X.lag(x, n)


def absolute(x: Feature) -> Feature:
    return feature(f"{x.name}_abs", [x], lambda: F.abs(x.c))


def where(cond: Column) -> Column:
    """A condition that is false where it is undefined."""
    return F.coalesce(cond, F.lit(False))


def _cross(a: Feature, b: Feature | float, up: bool) -> Feature:
    const = not isinstance(b, Feature)
    p, q = X.lag(a), None if const else X.lag(b)

    def e():
        cur, old = (F.lit(float(b)), F.lit(float(b))) if const else (b.c, q.c)
        return where((a.c > cur) & (p.c <= old)) if up else where((a.c < cur) & (p.c >= old))
    tag = X.number(b) if const else b.name
    return feature(f"{a.name}_x{'up' if up else 'dn'}_{tag}", [a, p] + ([] if const else [b, q]), e)


def crosses_above(a: Feature, b: Feature | float) -> Feature:
    return _cross(a, b, True)


def crosses_below(a: Feature, b: Feature | float) -> Feature:
    return _cross(a, b, False)


def evaluate_rule(panel: Panel, uses: dict[str, Feature], long: Callable, short: Callable | None = None,
                  name: str = "rule") -> DataFrame:
    """Positions of a rule: ``long``/``short`` get the Columns of ``uses`` by name and return a
    condition. Both sides at once is a contradiction and gives 0."""
    p = compute(panel, uses.values())
    cols = {k: f.c for k, f in uses.items()}
    up = long(cols)
    dn = short(cols) if short else F.lit(False)
    for c in (up, dn):
        if not isinstance(c, Column):
            raise TypeError("a rule side must be a condition over the series, not a constant")
    up, dn = where(up), where(dn)
    pos = F.when(up & ~dn, 1).when(dn & ~up, -1).otherwise(0).cast("byte")
    return p.owned().select(F.lit(name).alias("signal_name"), "symbol", "tf", "bar_idx", "open_time_ms",
                            pos.alias("position"))


def rule_counts(signals: DataFrame) -> DataFrame:
    """Long and short bars per series, and why the rule is refused, if it is."""
    n = signals.groupBy("signal_name", "symbol", "tf").agg(
        F.count(F.lit(1)).alias("n_bars"), F.count_if(F.col("position") == 1).alias("n_long"),
        F.count_if(F.col("position") == -1).alias("n_short"))
    return n.withColumn("refused", F.when(F.col("n_bars") < MIN_BARS, "too_few_bars").when(
        F.col("n_long") + F.col("n_short") < MIN_ACTIVE, "too_few_active_bars"))
