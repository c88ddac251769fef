"""Which stretches of ``n`` symbols occur more than once in a corpus, without shipping every stretch.

A window is ``n`` consecutive symbols (bytes or words) of one text. Its anchor is the ``q``-gram inside
it with the least hash, the leftmost of equals: a function of the window's content, so that equal windows
have equal anchors at equal places. Consecutive windows with the same anchor make a run, and a run's
content is its window starts plus ``n - 1`` further symbols. About two symbols in ``n - q + 2`` start a
run. From runs everything follows:

1. a run whose anchor occurs once in the corpus holds no repeated window;
2. runs of equal content are one class and hold equal windows, pair by pair;
3. only where one anchor has several classes may windows of different classes be equal; there, and only
   for one run of each class, single windows are hashed and compared.

Hot anchors and hot classes (a passage in a third of all documents) meet only in partial aggregates and
in plain joins against a table with one row per key, whose hot side adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C

_RUNS = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("id", pa.int64()), ("p", pa.int32()), ("k", pa.int32())])
_WINDOWS = pa.schema([("window", pa.int64()), ("id", pa.int64()), ("p", pa.int32())])


def symbols_of(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit value for each symbol of all texts, and where each text begins among them."""
    if unit == "byte":
        return C.byte_symbols(data), offsets
    starts, ends, first = C.word_bounds(data, offsets)
    return C.Running(C.byte_symbols(data), "byte").of(starts, ends), first


def find_runs(batches: Iterator[pa.RecordBatch], unit: str, n: int, q: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_numpy()
        for row, end, data, offsets in C.slices(batch):
            sym, first = symbols_of(data, offsets, unit)
            if len(sym) < n:
                continue
            h = C.Running(sym, unit)
            at = C.sliding_argmin(h.every(q), n - q + 1)                      # one for every window start
            text = np.repeat(np.arange(end - row), np.diff(first))[: len(at)]
            good = np.arange(len(at)) + n <= first[text + 1]
            new = good.copy()
            new[1:] &= ~(good[:-1] & (at[1:] == at[:-1]))
            stop = good.copy()
            stop[:-1] &= ~(good[1:] & (at[1:] == at[:-1]))
            a, b = np.flatnonzero(new), np.flatnonzero(stop)
            if not len(a):
                continue
            anchor = h.of(at[a], at[a] + q)
            yield pa.RecordBatch.from_arrays([
                pa.array(C.signed(anchor)), pa.array(C.signed(h.of(a, b + n))), pa.array(ids[row + text[a]]),
                pa.array((a - first[text[a]]).astype(np.int32)), pa.array((b - a + 1).astype(np.int32))], schema=_RUNS)


def expand(batches: Iterator[pa.RecordBatch], unit: str, n: int) -> Iterator[pa.RecordBatch]:
    """The hash of every window of the runs listed beside each text."""
    for batch in batches:
        ids, lists = batch.column("id").to_numpy(), batch.column("runs")
        for row, end, data, offsets in C.slices(batch):
            sym, first = symbols_of(data, offsets, unit)
            h = C.Running(sym, unit)
            part = lists.slice(row, end - row)
            flat, count = part.flatten(), np.asarray(part.value_lengths())
            p, k = flat.field("p").to_numpy(), flat.field("k").to_numpy().astype(np.int64)
            text = np.repeat(np.arange(end - row), count)
            begun = np.cumsum(k) - k
            local = np.repeat(p - begun, k) + np.arange(k.sum())
            text = np.repeat(text, k)
            s = first[text] + local
            yield pa.RecordBatch.from_arrays([pa.array(C.signed(h.of(s, s + n))), pa.array(ids[row + text]),
                                              pa.array(local.astype(np.int32))], schema=_WINDOWS)


def repeated(docs: DataFrame, unit: str, n: int, q: int, label: str) -> DataFrame:
    """Runs and single windows that are not alone: (id, p, k, kind, is_first).

    ``docs`` has ``id`` and ``text``; an id has one text. ``k`` window starts from ``p`` on, all of which occur at some other
    place (id, p) too; ``is_first`` says that they are the earliest of their class. A row of one class is
    complete with regard to its own class; windows that a class shares with other classes come as further
    rows with ``k`` = 1, where ``is_first`` regards all classes of the anchor.
    """
    runs = C.stored(docs.mapInArrow(lambda b: find_runs(b, unit, n, q), "anchor long, content long, id long, p int, k int"), f"{label}-runs")
    anchors = C.stored(runs.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("c"), F.min("content").alias("lo"), F.max("content").alias("hi"))
        .filter("c > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("many")), f"{label}-anchors")
    met = C.stored(runs.join(anchors, "anchor").select("content", "many", "id", "p", "k"), f"{label}-met")
    C.forget(runs, anchors)
    place = F.struct("id", "p")
    classes = C.stored(met.groupBy("content").agg(
        F.min(place).alias("lo"), F.max(place).alias("hi"), F.first("k").alias("k"), F.first("many").alias("many")), f"{label}-classes")
    own = (met.select("content", "id", "p", "k").join(classes.filter("lo <> hi").select("content", "lo"), "content")
           .select("id", "p", "k", (F.struct("id", "p") == F.col("lo")).alias("is_first")))
    wanted = (classes.filter("many").select("lo.id", F.struct("lo.p", "k").alias("run"))
              .groupBy("id").agg(F.collect_list("run").alias("runs")))
    single = C.stored(docs.select("id", "text").join(wanted, "id").mapInArrow(lambda b: expand(b, unit, n), "window long, id long, p int"), f"{label}-windows")
    shared = C.stored(single.groupBy("window").agg(
        F.count(F.lit(1)).alias("c"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.min("p").alias("a"), F.max("p").alias("b"))
        .filter("c > 1 AND (lo <> hi OR a <> b)").select("window", "lo"), f"{label}-shared")
    between = C.stored(single.join(shared, "window").select("window", "id", "p", (F.col("id") == F.col("lo")).alias("low")), f"{label}-between")
    C.forget(single, shared)
    # among equal windows of the smallest id, one document's at most, the first is the one that starts first
    start = Window.partitionBy("window").orderBy("p")
    low = between.filter("low").select("id", "p", F.lit(1).alias("k"), (F.rank().over(start) == 1).alias("is_first"))
    high = between.filter("NOT low").select("id", "p", F.lit(1).alias("k"), F.lit(False).alias("is_first"))
    return own.unionByName(low).unionByName(high)


def ranges(found: DataFrame, n: int) -> DataFrame:
    """(id, spans): the covered stretches [s, e) of each text, as they come."""
    return found.select("id", F.struct(F.col("p").alias("s"), (F.col("p") + F.col("k") + F.lit(n - 1)).alias("e")).alias("r")).groupBy(
        "id").agg(F.collect_list("r").alias("spans"))


def merged(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered stretches of [s, e), whatever their order and overlaps."""
    if not len(s):
        return s, e
    order = np.argsort(s, kind="stable")
    s, far = s[order], np.maximum.accumulate(e[order])
    new = np.flatnonzero(np.concatenate([[True], s[1:] > far[:-1]]))
    return s[new], far[np.concatenate([new[1:] - 1, [len(s) - 1]])]


def spans_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Merged spans of each row of an Arrow list of (s, e); none for null."""
    flat = column.flatten()
    s, e = flat.field("s").to_numpy().astype(np.int64), flat.field("e").to_numpy().astype(np.int64)
    at = 0
    for c in column.value_lengths().fill_null(0).to_numpy():
        yield merged(s[at: at + c], e[at: at + c])
        at += c
