"""Near-duplicate documents: tensored MinHash tables propose pairs, full shingle sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

WORDS = 5
#: Keys in each of the two collections, and MinHash values in each key. Every key of one collection is paired with
#: every key of the other, so SIDE * SIDE tables cost 2 * SIDE * DEPTH MinHash values. A pair of similarity s is missed
#: with a chance of at most 2 * (1 - s**DEPTH)**SIDE: 0.0005 at s = 0.75, 0.00007 at 0.8.
SIDE, DEPTH = 10, 2

#: Plain tables of FINE_DEPTH values each, for documents whose buckets stay mixed, such as all those with one common
#: passage. A pair is missed with a chance of (1 - s**FINE_DEPTH)**FINE_TABLES: 0.0002 at s = 0.75; at s = 0.3 it meets with 0.005.
FINE_TABLES, FINE_DEPTH = 80, 8

#: Words of 64 bits in the parity sketch of a set: every shingle flips one bit. Two sketches differ in no more bits than their sets do in
#: shingles, so a sketch rules pairs out without error.
SKETCH = 8

_SIGNS = "id long, n long, h1 long, h2 long, a array<long>, b array<long>, s struct<" + ", ".join(f"s{i}:long" for i in range(SKETCH)) + ">"
_MULTIPLIERS = np.random.Generator(np.random.PCG64(71)).integers(0, 2**63, 2 * SIDE * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of every text, and where each text begins among them."""
    data = C.LOWER[data]
    starts, ends, first = C.word_bounds(data, offsets)
    h = C.Running(C.Running(C.byte_symbols(data), "byte").of(starts, ends), "word")
    n_words = np.diff(first)
    count = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    s = np.repeat(first[:-1] - begin[:-1], count) + np.arange(begin[-1])
    return h.of(s, s + np.repeat(np.minimum(n_words, width), count)), begin


def _sign(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_numpy()
        for row, end, data, offsets in C.slices(batch):
            sh, begin = _shingles(data, offsets, width)
            n_texts = end - row
            n, h1, h2 = (np.zeros(n_texts, dtype=np.uint64) for _ in range(3))
            flips = np.zeros((n_texts, 64 * SKETCH), dtype=np.uint8)
            for i in np.flatnonzero(np.diff(begin)):
                u = np.unique(sh[begin[i]: begin[i + 1]])
                n[i], h1[i], h2[i] = len(u), C.mix(u).sum(), C.mix(u ^ np.uint64(0x5DEECE66D)).sum()
                flips[i] = np.bincount((u % np.uint64(64 * SKETCH)).view(np.int64), minlength=64 * SKETCH) & 1
            full = np.flatnonzero(np.diff(begin))
            keys = np.zeros((n_texts, 2 * SIDE), dtype=np.uint64)
            if len(full):
                for k in range(2 * SIDE):
                    for j in range(DEPTH):
                        low = np.minimum.reduceat(sh * _MULTIPLIERS[k * DEPTH + j], begin[:-1][full])
                        keys[full, k] = C.mix(keys[full, k] + C.mix(low) + np.uint64(j))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(C.signed(np.ascontiguousarray(keys[:, x]).reshape(-1))), SIDE).cast(pa.list_(pa.int64()))
                     for x in (slice(0, SIDE), slice(SIDE, None))]
            words = np.packbits(flips, axis=1).view(np.int64)
            sketch = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(words[:, i])) for i in range(SKETCH)], names=[f"s{i}" for i in range(SKETCH)])
            yield pa.RecordBatch.from_arrays([pa.array(ids[row:end]), *(pa.array(C.signed(x)) for x in (n, h1, h2)), *lists, sketch],
                                             names=["id", "n", "h1", "h2", "a", "b", "s"])


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("id").to_numpy()
        for row, end, data, offsets in C.slices(batch):
            sh, begin = _shingles(data, offsets, width)
            sets = [np.unique(sh[begin[i]: begin[i + 1]]) for i in range(end - row)]
            flat = C.signed(np.concatenate([np.zeros(0, np.uint64), *sets]))
            off = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids[row:end]), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], names=["id", "set"])


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, w, keys) of the plain tables, from full sets."""
    factors = np.random.Generator(np.random.PCG64(72)).integers(0, 2**63, FINE_TABLES * FINE_DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        sets = batch.column("set")
        keys = np.zeros((batch.num_rows, FINE_TABLES), dtype=np.uint64)
        for i in range(batch.num_rows):
            s = sets[i].values.to_numpy().view(np.uint64)
            low = np.array([(s * f).min() for f in factors]) if len(s) > 4096 else (s[None, :] * factors[:, None]).min(axis=1)
            low = C.mix(low).reshape(FINE_TABLES, FINE_DEPTH)
            key = np.arange(FINE_TABLES, dtype=np.uint64)
            for j in range(FINE_DEPTH):
                key = C.mix(key + low[:, j])
            keys[i] = key
        flat = pa.array(C.signed(keys.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("w"), pa.FixedSizeListArray.from_arrays(flat, FINE_TABLES).cast(pa.list_(pa.int64()))], names=["id", "w", "keys"])


def _finer(ids: DataFrame, sets: DataFrame) -> DataFrame:
    keys = C.stored(ids.join(sets, "id").mapInArrow(_fine, "id long, w long, keys array<long>"), "op2-fine")
    keys = keys.select(F.explode("keys").alias("key"), "id", "w")
    shared = keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("key")
    return keys.join(C.stored(shared, "op2-fine-shared"), "key")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(right, "b").join(left, "a").withColumn("both", both).filter(
        100 * F.col("both") >= percent * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")


def _close(x: Column, s: Column, y: Column, t: Column, percent: int) -> Column:
    """Necessary for a link of sets of sizes ``x`` and ``y``: sketches that differ in no more bits than linked sets may in shingles."""
    apart = reduce(add, (F.bit_count(s[f"s{i}"].bitwiseXOR(t[f"s{i}"])) for i in range(SKETCH)))
    return (100 + percent) * apart <= (100 - percent) * (x + y)


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Documents are linked when their sets of ``width``-word shingles (A-Z in lower case; fewer words make one
    shingle) have at least ``percent`` percent of their union in common; a component is what links reach.

    Documents with equal sets are one class from the start. In each bucket of the tables a few stars link the
    classes to one of them; classes that are already in one component need no further comparison, and pairs
    from different components that share a bucket are all compared in the end, whatever the bucket's size;
    parity sketches rule most of those out before they are listed.

    Null ids count as the smallest id, null texts and texts without words have an empty set, are linked with
    nothing and stay. Rows that repeat an id are one document in the links; each gets a result row of its
    own. Other columns are not read.
    """
    rows = C.keyed(docs, id_col, text_col)
    signs = C.stored(rows.mapInArrow(lambda b: _sign(b, width), _SIGNS), "op2-signs")
    same = ["n", "h1", "h2"]
    classes = C.stored(signs.filter("n > 0").groupBy(*same).agg(F.min("id").alias("rep")), "op2-classes")
    reps = signs.join(classes, same).filter("id = rep").select("id", "n", "a", "b")
    table = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda i: F.transform(
        F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda j: F.xxhash64(i, j, F.get("a", i), F.get("b", j))))))
    keys = C.stored(reps.select("id", "n", table.alias("key")), "op2-keys")
    shared = C.stored(keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo <> hi").select("key"), "op2-shared")
    members = C.stored(keys.join(shared, "key"), "op2-members")
    C.forget(keys, shared)
    sets = C.stored(rows.join(members.select("id").distinct(), "id", "left_semi").mapInArrow(lambda b: _sets(b, width), "id long, set array<long>"), "op2-sets")
    sketches = C.stored(signs.join(classes, same).filter("id = rep").select("id", "s").distinct(), "op2-sketches")     # read twice in every round
    near = C.linked_groups(members.withColumnRenamed("n", "w"), lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y),
                           lambda pairs: _confirm(pairs, sets, percent), "op2", lambda ids: _finer(ids, sets),
                           sketches, lambda x, s, y, t: _close(x, s, y, t, percent))
    whole = classes.join(near.withColumnRenamed("id", "rep"), "rep", "left").select(*same, F.coalesce("component", "rep").alias("component"))
    whole = C.stored(whole, "op2-whole")
    C.forget(sketches, sets, members)
    return _result(signs.select("id", *same).join(whole, same, "left"))


def _result(rows: DataFrame) -> DataFrame:
    found = F.coalesce("component", "id")
    return rows.select(C.unkeyed().alias("doc_id"), F.col("n").alias("n_shingles"),
                       F.when(found != C.NULL_ID, found).alias("component_id"), (F.col("id") == found).alias("kept"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "documents"))
