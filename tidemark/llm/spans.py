"""Places of regular expressions in texts, in DataFrame functions only. Used by the PII and the secret scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def find(rows: DataFrame, kinds: list[tuple[str, str, Column | None]]) -> DataFrame:
    """(id, th, kind, start, end, match) for every leftmost non-overlapping match in ``text``.

    ``kinds``: name, Java pattern and, if wanted, a condition under which a row is searched at all. Places
    count code points, the end is exclusive. A text is split at the matches; running sums over the lengths of
    parts and matches, one row per match, give the places, so that no list is rebuilt match by match.
    """
    parts = []
    for name, pattern, gate in kinds:
        gaps = F.transform(F.split("text", pattern, -1), F.length)
        hit = F.col("text").rlike(pattern)
        parts.append(F.when(hit if gate is None else gate & hit, F.struct(
            F.lit(name).alias("kind"), gaps.alias("gaps"), F.regexp_extract_all("text", F.lit(pattern), F.lit(0)).alias("found"))))
    each = rows.select("id", "th", F.explode_outer(F.array_compact(F.array(*parts))).alias("x")).filter("x IS NOT NULL")
    each = each.select("id", "th", "x.kind", "x.gaps", F.posexplode_outer("x.found").alias("k", "match"))
    each = each.select("id", "th", "kind", "k", "match", F.get("gaps", F.col("k")).alias("gap"), F.length("match").alias("n")).filter("match IS NOT NULL").distinct()
    upto = Window.partitionBy("id", "th", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(upto)
    return each.select("id", "th", "kind", (end - F.col("n")).cast("long").alias("start"), end.cast("long").alias("end"), "match")


def listed(spans: DataFrame, base: list[str], order: list[str]) -> DataFrame:
    """(id, th, n_<base kind>..., base, spans): counts, and ``kind:start:end`` by start, then kind as in ``order``, comma-joined."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    one = F.struct("start", rank.alias("rank"), "end", F.concat_ws(":", "kind", F.col("start").cast("string"), F.col("end").cast("string")).alias("s"))
    is_base = F.col("kind").isin(base)
    joined = lambda c: F.concat_ws(",", F.transform(F.array_sort(c), lambda x: x["s"]))
    return spans.groupBy("id", "th").agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in base),
        joined(F.collect_list(F.when(is_base, one))).alias("base"), joined(F.collect_list(one)).alias("spans"))


def redacted(rows: DataFrame, spans: DataFrame, label) -> DataFrame:
    """(id, th, clean) for the texts of ``rows`` (id, th, text) that have spans; each covered stretch becomes ``label(kind of its first span, its length)``."""
    by = Window.partitionBy("id", "th").orderBy("start", "end", "kind")
    far = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    isle = F.sum(F.when(F.col("start") < F.col("far"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    isles = spans.select("id", "th", "start", "end", "kind").withColumn("far", far).withColumn("isle", isle).groupBy("id", "th", "isle").agg(
        F.min("start").alias("s"), F.max("end").alias("e"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
    lists = isles.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("s", "e", "kind"))).alias("cut"))
    cut = rows.join(lists, ["id", "th"])
    upto = lambda i: F.coalesce(F.get("cut", i)["e"], F.lit(0))
    pieces = F.transform("cut", lambda x, i: F.concat(F.col("text").substr((upto(i - 1) + 1).cast("int"), (x["s"] - upto(i - 1)).cast("int")), label(x["kind"], (x["e"] - x["s"]).cast("int"))))
    tail = F.col("text").substr((F.element_at("cut", -1)["e"] + 1).cast("int"), F.length("text"))
    return cut.select("id", "th", F.concat(F.concat_ws("", pieces), tail).alias("clean"))
