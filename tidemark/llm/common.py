"""What the operators share: stored intermediates, text bytes as numpy arrays, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import checkpoint_root

#: Stands for a null id inside joins and orders; a null id is thus the smallest.
NULL_ID = -(2**63)
#: Shuffle files of a finished write are of no more use; Spark removes them when this is on.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again; its shuffle files are dropped at once."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/tidemark/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Remove stored tables that no later plan reads."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str | Column) -> DataFrame:
    """The two columns an operator needs as ``id`` (null: the smallest) and ``text`` (null: empty)."""
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *more)


def unkeyed(name: str = "id") -> Column:
    """The id as it came in."""
    return F.when(F.col(name) != NULL_ID, F.col(name))


def fresh(*labels: str) -> list[str]:
    """Column names that no input table has, for joins with whole input rows."""
    mark = uuid.uuid4().hex
    return [f"_{x}_{mark}" for x in labels]


def same_text(docs: DataFrame, id_col: str, text_col: str, id_name: str, th_name: str) -> Column:
    """A row of ``docs`` is the text known by (id, hash)."""
    th = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    return (F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)) == F.col(id_name)) & (th == F.col(th_name))


def numbered(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` (id, text) as (id, text, doc): ``doc`` is the id, ``id`` one number for each different pair of id and text.

    Numbers are in the order of the id, then of the text's hash; where no id repeats, ids are their own numbers.
    """
    if rows.groupBy("id").count().filter("count > 1").isEmpty():
        return rows.withColumn("doc", F.col("id"))
    rows = rows.withColumn("th", F.xxhash64("text"))
    keys = rows.select("id", "th").distinct().repartitionByRange("id", "th").sortWithinPartitions("id", "th")
    keys = stored(keys.withColumn("key", F.monotonically_increasing_id()), f"{label}-keys")
    return rows.join(keys, ["id", "th"]).select(F.col("key").alias("id"), "text", F.col("id").alias("doc"))


# ---------------------------------------------------------------- bytes of many texts at once

def slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``most`` bytes; a longer text is a run of its own."""
    col = batch.column(column)
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    n = len(col)
    if not n:
        return
    off = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset: col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(off, off[row] + most, side="right")) - 1)
        yield row, end, data[off[row]: off[end]], off[row: end + 1] - off[row]
        row = end


def lookup(chars: list[int] | range) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


#: Separators of the word pattern ``[^\x20\x09-\x0D]+``.
BLANK = lookup([0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: An odd multiplier for running sums over bytes, one over words, and their inverses modulo 2**64.
BASE = {"byte": 0x9E3779B97F4A7C15, "word": 0xD6E8FEB86659FD93}
_POW: dict[tuple[str, bool], np.ndarray] = {}


def powers(kind: str, n: int, inverse: bool = False) -> np.ndarray:
    """BASE**0 .. BASE**(n-1), or of its inverse, modulo 2**64."""
    have = _POW.get((kind, inverse))
    if have is None or len(have) < n:
        b = pow(BASE[kind], -1, 2**64) if inverse else BASE[kind]
        have = np.full(max(n, 1 << 16), b, dtype=np.uint64)
        have[0] = 1
        np.cumprod(have, out=have)
        _POW[kind, inverse] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Running:
    """Hash of any stretch of a sequence in constant time, from one running sum modulo 2**64."""

    def __init__(self, symbols: np.ndarray, kind: str):
        self.kind, n = kind, len(symbols)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(symbols * powers(kind, n), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        inv = powers(self.kind, len(self.sums), True)
        h = (self.sums[end] - self.sums[start]) * inv[start]
        return mix(mix(h) + (end - start).astype(np.uint64))

    def every(self, width: int) -> np.ndarray:
        """Of all stretches of one width."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix(mix((self.sums[width:] - self.sums[:n]) * powers(self.kind, len(self.sums), True)[:n]) + np.uint64(width))


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def word_bounds(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and at which word each text begins (one more entry than texts)."""
    inside = ~separator[data]
    lo, hi = offsets[:-1], offsets[1:]
    full = hi > lo
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[lo[full]] = inside[lo[full]]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[hi[full] - 1] = inside[hi[full] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sliding_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """For every stretch of ``width`` values the place of the one with the least upper half, the leftmost of equals."""
    if len(x) < width:
        return np.zeros(0, np.int64)
    val, size = (x & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(x), dtype=np.uint64), 1
    while size < width:
        step = min(size, width - size)
        val = np.minimum(val[step:], val[:-step])
        size += step
    return (val & np.uint64(0xFFFFFFFF)).astype(np.int64)


# ---------------------------------------------------------------- components of a graph of links

def components(links: DataFrame, label: str) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that occurs in ``links`` (a, b).

    Every round each label takes the least label around it, then the label of its label; the table of
    labels is written between rounds, so a lost executor costs one round. The number of rounds grows with
    the logarithm of the longest path.
    """
    spark = links.sparkSession
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{label}-links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("id"), F.least("a", "m").alias("component")), f"{label}-labels")
    while True:
        around = (both.join(labels.select(F.col("id").alias("b"), "component"), "b")
                  .groupBy("a").agg(F.min("component").alias("m")))
        least = labels.join(around.select(F.col("a").alias("id"), "m"), "id").select(
            "id", F.col("component").alias("was"), F.least("component", "m").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("next"))
        new = stored(least.join(jump, "component").select(
            "id", "was", F.least("component", "next").alias("component")), f"{label}-labels")
        changed = new.filter("component <> was").limit(1).count()
        forget(labels)
        labels = new
        if not changed:
            forget(both)
            return labels.select("id", "component")


#: Rounds of stars before the pairs left are listed.
ROUNDS = 2


def linked_groups(members: DataFrame, fits, confirm, label: str, refine=None, sketches: DataFrame | None = None, close=None) -> DataFrame:
    """(id, component) from buckets (key, id, w): what the confirmed pairs of bucket mates connect.

    ``fits(w, other_w)`` is a cheap exact condition on a pair, ``confirm(pairs)`` keeps the pairs (a, b) that
    are links. Bucket mates need not be compared if they are in one component already. So a round compares
    the mates in each bucket with one of them, which is linear in the bucket; then only buckets with several
    components stay open. Where ``refine`` is given, it makes finer buckets for the ids that are still in open
    ones, and rounds begin anew with those. When few pairs of different components are left (or after
    ``ROUNDS`` rounds, or one that did not settle half of the pairs), all of them are compared: no pair of bucket mates is given up, whatever the bucket's
    size. Where ``sketches`` (id, s) are given, ``close(w, s, other_w, other_s)`` must hold for every link; it
    is tested where pairs are formed, so that few are listed. ``members`` must be a stored table.
    """
    def side(x: DataFrame, name: str) -> DataFrame:
        return x.join(sketches.select(F.col("id").alias(name), F.col("s").alias(f"{name}_s")), name)

    open_, tested, near, turn, before = members.withColumn("component", F.col("id")), None, None, 0, None
    while True:
        left = None
        if near is not None:
            now = members.join(near, "id", "left").withColumn("component", F.coalesce("component", "id"))
            mixed = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
            open_ = stored(now.join(mixed, "key"), f"{label}-open")
            part = open_.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(
                F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"))
            left = part.agg(F.sum((F.col("c") * F.col("c") - F.col("cc")) / 2).alias("pairs"), F.sum("c").alias("members")).first()
            if not left["pairs"]:
                return near
            if refine is not None:
                members, refine, turn = stored(refine(open_.select("id", "w").distinct()), f"{label}-finer"), None, 0
                continue
        last = turn >= ROUNDS or (left is not None and (left["pairs"] <= 2 * left["members"] or (before is not None and 2 * left["pairs"] > before)))
        before = None if left is None else left["pairs"]
        if last:
            mates = open_.select("key", F.col("id").alias("other"), F.col("w").alias("other_w"), F.col("component").alias("its"))
            apart = F.col("id") < F.col("other")
            if sketches is not None:
                open_, mates = side(open_, "id"), side(mates, "other")
                apart = apart & close(F.col("w"), F.col("id_s"), F.col("other_w"), F.col("other_s"))
        else:
            order = F.xxhash64("id", F.lit(turn))
            mates = open_.groupBy("key").agg(*(F.min_by(x, order).alias(y) for x, y in (("id", "other"), ("w", "other_w"), ("component", "its"))))
            apart = F.col("id") != F.col("other")
        pairs = open_.join(mates, "key").filter((F.col("component") != F.col("its")) & fits(F.col("w"), F.col("other_w")) & apart)
        if sketches is not None and not last:
            pairs = pairs.select("id", "w", "other", "other_w").distinct()
            pairs = side(side(pairs, "other"), "id").filter(close(F.col("w"), F.col("id_s"), F.col("other_w"), F.col("other_s")))
        pairs = pairs.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        pairs = stored(pairs.join(tested, ["a", "b"], "left_anti") if tested is not None else pairs, f"{label}-pairs")
        good = stored(confirm(pairs), f"{label}-good")
        tested = pairs if tested is None else tested.unionByName(pairs)
        # what is connected already enters as one link to the smallest id
        links = good if near is None else good.unionByName(near.filter("id <> component").select(F.col("component").alias("a"), F.col("id").alias("b")))
        near = components(links, label)
        if last:
            return near
        turn += 1
