"""Causality audits as jobs: a value at a bar may depend only on what was known at that bar."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.panel import Panel, build_panel
from tidemark.operators.signals import signal_positions

ID = ["signal_name", "symbol", "tf", "bar_idx"]
DEFAULT_CUTS = (("q1", 0.25), ("q2", 0.5), ("q3", 0.75), ("last", None))


def _cut_at(fraction: float | None) -> Column:
    return F.col("n_bars") - 1 if fraction is None else F.floor(F.col("n_bars") * fraction).cast("long")


def _base() -> Column:
    """The series a copy was made of."""
    return F.regexp_replace("symbol", "#[^#]*$", "").alias("symbol")


def _with_cuts(bars: DataFrame, cuts) -> DataFrame:
    """Copies of every series, one per cut; the cut is part of the series key, so one job runs
    them all and no two copies can see each other."""
    arr = F.array(*[F.struct(F.lit(n).alias("cut"), _cut_at(f).alias("at")) for n, f in cuts])
    return bars.withColumn("_k", F.explode(arr)).select("*", "_k.cut", F.col("_k.at").alias("cut_at")).drop("_k").withColumn(
        "symbol", F.concat_ws("#", "symbol", "cut"))


def _compare(full: DataFrame, part: DataFrame, cuts_table: DataFrame) -> DataFrame:
    """Per (signal, series, cut): rows compared, rows that differ, first bar that differs."""
    p = part.select("signal_name", _base(), F.substring_index("symbol", "#", -1).alias("cut"), "tf", "bar_idx",
                    F.col("position").alias("_p")).join(cuts_table, ["symbol", "tf", "cut"]).filter("bar_idx < cut_at")
    j = p.join(full.select(*ID, F.col("position").alias("_f")), ID, "left")
    differs = ~F.col("_p").eqNullSafe(F.col("_f"))
    return j.groupBy("signal_name", "symbol", "tf", "cut").agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(differs).alias("mismatches"),
        F.min(F.when(differs, F.col("bar_idx"))).alias("first_bar"))


def _cuts_table(bars: DataFrame, cuts) -> DataFrame:
    return _with_cuts(bars.select("symbol", "tf", "n_bars").distinct(), cuts).select(
        _base(), "tf", "cut", "cut_at")


def _positions(bars: DataFrame, names, like: Panel, run) -> DataFrame:
    p = build_panel(bars, chunk=like.chunk, halo=like.halo, indexed=True)
    return (run or signal_positions)(p, names)


def audit_prefix(bars: DataFrame, panel: Panel, names: Iterable[str] | None = None, *, cuts=DEFAULT_CUTS, run=None) -> DataFrame:
    """Signals over a prefix must equal the first rows of the full run. ``bars`` is indexed."""
    part = _with_cuts(bars, cuts).filter("bar_idx < cut_at").withColumn("n_bars", F.col("cut_at")).drop("cut", "cut_at")
    return _compare((run or signal_positions)(panel, names), _positions(part, names, panel, run), _cuts_table(bars, cuts))


def audit_rewrite_future(bars: DataFrame, panel: Panel, names: Iterable[str] | None = None, *, cuts=(("q2", 0.5),),
                         run=None) -> DataFrame:
    """Replacing everything from a cut on must change nothing before it."""
    after = F.col("bar_idx") >= F.col("cut_at")
    other = _with_cuts(bars, cuts)
    for c, k in (("open", 1.7), ("high", 1.9), ("low", 1.5), ("close", 1.6), ("volume", 7.0)):
        other = other.withColumn(c, F.when(after, F.col(c) * k).otherwise(F.col(c)))
    return _compare((run or signal_positions)(panel, names), _positions(other.drop("cut", "cut_at"), names, panel, run),
                    _cuts_table(bars, cuts))


def audit_determinism(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Column by column: rows where two runs differ (a missing row differs in every column)."""
    cols = [c for c in a.columns if c not in keys]
    j = a.select(*keys, F.struct(*cols).alias("_a")).join(b.select(*keys, F.struct(*cols).alias("_b")), keys, "full")
    counts = j.agg(F.count(F.lit(1)).alias("rows"), *[
        F.count_if(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")) | F.col("_a").isNull() | F.col("_b").isNull()).alias(c)
        for c in cols])
    return counts.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mismatches"))
                                                     for c in cols])).alias("m")).select("m.column", "rows", "m.mismatches")


def audit_available_at(df: DataFrame, available: Column | str, now: Column | str, in_flight: Column | None = None) -> DataFrame:
    """Rows that used an input before it could be known; in-flight bars are never an input."""
    a = F.col(available) if isinstance(available, str) else available
    n = F.col(now) if isinstance(now, str) else now
    bad = F.when(in_flight, "in_flight") if in_flight is not None else F.lit(None).cast("string")
    return df.withColumn("violation", F.coalesce(bad, F.when(a.isNull(), "never_available").when(a > n, "from_the_future"))
                         ).filter("violation IS NOT NULL")


def audit_signal_properties(bars: DataFrame, panel: Panel, names: Iterable[str] | None = None, scale: float = 4.0) -> DataFrame:
    """Per signal: values outside {-1,0,1}, positions inside the warm-up, and positions that change
    when every price is multiplied by a power of two (which is exact in floating point)."""
    from tidemark.signals.registry import catalogue
    full = signal_positions(panel, names)
    scaled = bars
    for c in ("open", "high", "low", "close"):
        scaled = scaled.withColumn(c, F.col(c) * scale)
    twin = _positions(scaled, names, panel, None)
    warm = F.create_map(*[F.lit(x) for s in catalogue().values() for x in (s.name, s.warmup)])
    j = full.join(twin.select(*ID, F.col("position").alias("_s")), ID, "left")
    return j.groupBy("signal_name").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("position").isin(-1, 0, 1)).alias("bad_values"),
        F.count_if((F.col("bar_idx") < warm[F.col("signal_name")]) & (F.col("position") != 0)).alias("warmup_positions"),
        F.count_if(~F.col("position").eqNullSafe(F.col("_s"))).alias("scale_mismatches"))
