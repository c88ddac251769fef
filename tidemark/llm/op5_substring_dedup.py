"""Repeated word spans by compaction of a De Bruijn graph: every copy of a long span is cut out, the first included.

An edge of the graph is ``n`` consecutive words of one text, its nodes are the first and the last ``n - 1`` of them. The graph
holds the edges that start at two places or more. From the corpus to spans in Spark joins:

1. texts become runs of edges with one minimiser (:func:`tidemark.llm.windows.find_runs`); a run whose minimiser occurs
   once in the corpus holds no repeated edge;
2. equal runs are one class; one run of each class is written out as edges (:func:`edges_of`), grouped to those of two places;
3. nodes with one edge in and one out link these; linked edges that follow each other at their source coordinates are a segment,
   segments are joined to unitigs (nonbranching paths) by pointer doubling (:func:`compact`);
4. every run is laid along the unitigs of its class, which gives pieces with source coordinates;
5. the words at these coordinates must have the second fingerprint that the unitig has (:func:`verified`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import windows as W

_CUT = "doc_id long, n_words long, spans array<struct<s:long,e:long>>, kept string"
_DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_EDGES = pa.schema([("tail", pa.int64()), ("head", pa.int64()), ("proof", pa.int64()), ("id", pa.int64()),
                    ("p", pa.int32()), ("content", pa.int64()), ("o", pa.int32()), ("copied", pa.bool_())])
#: Runs of one class that a join brings to one task.
PER_TASK = 20_000


def second_fingerprint(data: np.ndarray, offsets: np.ndarray) -> tuple[C.Running, np.ndarray]:
    """A fingerprint of words that shares no table with the one edges are grouped by, and where each text begins."""
    starts, ends, first = C.word_bounds(data, offsets)
    return C.Running(C.mix(C.Running(C.mix(C.byte_symbols(data)), "byte").of(starts, ends)), "word"), first


def edges_of(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """Every edge of the runs listed beside each text: its nodes, its second fingerprint, its place and that in its run."""
    for batch in batches:
        ids, lists = batch.column("id").to_numpy(), batch.column("runs")
        for row, end, data, offsets in C.slices(batch):
            sym, first = W.symbols_of(data, offsets, "word")
            h, other = C.Running(sym, "word"), second_fingerprint(data, offsets)[0]
            part = lists.slice(row, end - row)
            flat, count = part.flatten(), np.asarray(part.value_lengths())
            p, k = flat.field("p").to_numpy(), flat.field("k").to_numpy().astype(np.int64)
            text = np.repeat(np.repeat(np.arange(end - row), count), k)
            o = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            local = np.repeat(p, k) + o
            s = first[text] + local
            yield pa.RecordBatch.from_arrays([
                pa.array(C.signed(h.of(s, s + n - 1))), pa.array(C.signed(h.of(s + 1, s + n))), pa.array(C.signed(other.of(s, s + n))), pa.array(ids[row + text]), pa.array(local.astype(np.int32)),
                pa.array(np.repeat(flat.field("content").to_numpy(), k)), pa.array(o.astype(np.int32)),
                pa.array(np.repeat(np.asarray(flat.field("copied").to_pylist(), bool), k))], schema=_EDGES)


def _follow(segments: DataFrame, label: str) -> DataFrame:
    """(seg, root, dist, least): where the pointers of (seg, ptr, dist) lead, and the edges passed on the way.

    A segment that points to itself is a root. Each round doubles the length of the pointers, so rounds grow with the logarithm
    of the longest path. Segments on a cycle reach no root; they end with a ``root`` that is none, and all with the ``least`` of the cycle.
    """
    state = C.stored(segments.select("seg", "ptr", "dist", F.least("seg", "ptr").alias("least")), f"{label}-pointers")
    left = None
    while True:
        onward = state.select(F.col("seg").alias("ptr"), F.col("ptr").alias("to"), F.col("dist").alias("more"), F.col("least").alias("low"))
        new = C.stored(state.join(onward, "ptr").select(
            "seg", F.col("to").alias("ptr"), (F.col("dist") + F.col("more")).alias("dist"), F.least("least", "low").alias("least"),
            (F.col("to") != F.col("ptr")).alias("moved"), (F.col("low") < F.col("least")).alias("lower")), f"{label}-pointers")
        C.forget(state)
        moved, lower = new.agg(F.count_if("moved"), F.count_if("lower")).first()
        state = new
        if not moved or (moved == left and not lower):
            return state.select("seg", F.col("ptr").alias("root"), "dist", "least")
        left = moved


def compact(edges: DataFrame, label: str) -> DataFrame:
    """(edge, unitig, at): the maximal nonbranching path of each of the ``edges`` (edge, tail, head, id, p) and its place on it.

    Linked edges that follow each other in the text they were read from form segments first; what is left for the joins
    are the segments of one path. A cycle without branches is cut before its segment of the smallest number.
    """
    ends = edges.select(F.col("tail").alias("node"), F.col("edge").alias("leaves"), F.lit(None).cast("long").alias("enters")).unionByName(
        edges.select(F.col("head").alias("node"), F.lit(None).cast("long").alias("leaves"), F.col("edge").alias("enters")))
    links = C.stored(ends.groupBy("node").agg(F.count("leaves").alias("n_out"), F.count("enters").alias("n_in"),
                                              F.max("leaves").alias("edge"), F.max("enters").alias("prev"))
                     .filter("n_out = 1 AND n_in = 1").select("edge", "prev"), f"{label}-links")
    text = Window.partitionBy("id").orderBy("p")
    told = edges.select("edge", "id", "p").join(links, "edge", "left").select(
        "edge", "id", "p", "prev", ((F.lag("edge").over(text) == F.col("prev")) & (F.lag("p").over(text) == F.col("p") - 1)).alias("on"))
    begun = F.last(F.when(~F.coalesce("on", F.lit(False)), F.struct("edge", "p")), ignorenulls=True).over(
        text.rowsBetween(Window.unboundedPreceding, 0))
    located = C.stored(told.withColumn("begun", begun).select(
        "edge", "prev", F.col("begun.edge").alias("seg"), (F.col("p") - F.col("begun.p")).alias("off")), f"{label}-located")
    C.forget(links)
    sizes = C.stored(located.groupBy("seg").agg(F.count(F.lit(1)).alias("len"), F.max(F.when(F.col("off") == 0, F.col("prev"))).alias("prev")), f"{label}-segments")
    before = (sizes.filter("prev IS NOT NULL").select("seg", F.col("prev").alias("edge"))
              .join(located.select("edge", F.col("seg").alias("ptr")), "edge").drop("edge")
              .join(sizes.select(F.col("seg").alias("ptr"), F.col("len").alias("dist")), "ptr"))
    heads = sizes.filter("prev IS NULL").select("seg", F.col("seg").alias("ptr"), F.lit(0).cast("long").alias("dist"))
    chain = C.stored(before.select("seg", "ptr", "dist").unionByName(heads), f"{label}-chain")
    ways = _follow(chain, label)
    ended = ways.join(heads.select(F.col("seg").alias("root")), "root", "left_semi").select("seg", "root", "dist")
    round_ones = ways.join(heads.select(F.col("seg").alias("root")), "root", "left_anti").select("seg", "least")
    if not round_ones.isEmpty():
        cut = F.col("seg") == F.col("least")
        opened = chain.join(round_ones, "seg").select("seg", F.when(cut, F.col("seg")).otherwise(F.col("ptr")).alias("ptr"),
                                                      F.when(cut, 0).otherwise(F.col("dist")).cast("long").alias("dist"))
        ended = ended.unionByName(_follow(opened, f"{label}-cycles").select("seg", "root", "dist"))
    paths = C.stored(located.join(ended, "seg").select("edge", F.col("root").alias("unitig"), (F.col("dist") + F.col("off")).alias("at")), f"{label}-unitigs")
    C.forget(located, sizes, chain)
    return paths


def pieces_of_corpus(rows: DataFrame, n: int, q: int) -> DataFrame:
    """(id, p, k, unitig, at, proof): ``k`` edges from word ``p`` on that lie on one unitig from ``at`` on, for every place of the corpus.

    ``proof`` is the exclusive or of the second fingerprints that these edges have where the graph read them.
    """
    runs = C.stored(rows.mapInArrow(lambda b: W.find_runs(b, "word", n, q), "anchor long, content long, id long, p int, k int"), "op5-runs")
    anchors = C.stored(runs.groupBy("anchor").agg(
        F.count(F.lit(1)).alias("c"), F.min("content").alias("lo"), F.max("content").alias("hi"))
        .filter("c > 1").select("anchor", (F.col("lo") != F.col("hi")).alias("many"), F.expr(f"1 + c DIV {PER_TASK}").alias("shares")), "op5-anchors")
    met = C.stored(runs.join(anchors, "anchor").select("content", "many", "shares", "id", "p", "k"), "op5-met")
    C.forget(runs, anchors)
    classes = C.stored(met.groupBy("content").agg(
        F.min(F.struct("id", "p")).alias("lo"), F.max(F.struct("id", "p")).alias("hi"), F.first("k").alias("k"), F.first("many").alias("many"),
        F.first("shares").alias("shares")).select("content", "lo", "k", "shares", (F.col("lo") != F.col("hi")).alias("copied"), "many")
        .filter("copied OR many"), "op5-classes")
    wanted = classes.select("lo.id", F.struct("lo.p", "k", "content", "copied").alias("run")).groupBy("id").agg(F.collect_list("run").alias("runs"))
    windows = C.stored(rows.select("id", "text").join(wanted, "id").mapInArrow(
        lambda b: edges_of(b, n), "tail long, head long, proof long, id long, p int, content long, o int, copied boolean"), "op5-windows")
    edge = F.xxhash64("tail", "head").alias("edge")                             # both nodes together are the words of the edge
    edges = C.stored(windows.groupBy("tail", "head", "proof").agg(
        F.max("copied").alias("copied"), F.min("id").alias("id"), F.max("id").alias("hi"), F.min("p").alias("a"), F.max("p").alias("b"),
        F.min_by("p", "id").alias("p")).filter("copied OR id <> hi OR a <> b").select("tail", "head", "id", "p"), "op5-edges")
    paths = compact(edges.select(edge, "*"), "op5")
    C.forget(edges)
    run = Window.partitionBy("content").orderBy("o")
    laid = (windows.select(edge, "proof", "content", "o").join(paths, "edge").drop("edge")
            .withColumn("o_before", F.lag("o").over(run)).filter("o_before IS NULL OR o_before <> o")     # rows that repeat another wholly
            .withColumn("new", (F.coalesce(F.lag("o").over(run), F.lit(-2)) != F.col("o") - 1) | (F.lag("unitig").over(run) != F.col("unitig"))
                        | (F.lag("at").over(run) != F.col("at") - 1))
            .withColumn("piece", F.count_if("new").over(run)))
    pieces = C.stored(laid.groupBy("content", "piece").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("k"), F.first("unitig").alias("unitig"),
                                                           F.min("at").alias("at"), F.bit_xor("proof").alias("proof")), "op5-pieces")
    C.forget(windows, paths)
    pieces = pieces.join(classes.select("content", "shares"), "content")
    shared = pieces.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1))).drop("piece", "shares")
    placed = met.select("content", "id", "p", F.pmod(F.xxhash64("id", "p"), "shares").alias("share")).join(shared, ["content", "share"])
    return placed.select("id", (F.col("p") + F.col("o")).alias("p"), "k", "unitig", "at", "proof")


def verified(batches: Iterator[pa.RecordBatch], n: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Pieces beside each text become word spans [s, e); a piece whose words have another second fingerprint than its unitig is left out."""
    for batch in batches:
        lists, out = batch.column("pieces"), []
        for row, end, data, offsets in C.slices(batch):
            other, first = second_fingerprint(data, offsets)
            folded = np.zeros(len(other.sums), np.uint64)
            every = other.every(n)
            np.bitwise_xor.accumulate(every, out=folded[1: len(every) + 1])
            for i in range(end - row):
                one = lists.slice(row + i, 1).flatten()
                p, k = one.field("p").to_numpy().astype(np.int64), one.field("k").to_numpy().astype(np.int64)
                s = first[i] + p
                same = (folded[s + k] ^ folded[s]).view(np.int64) == one.field("proof").to_numpy()
                s, e = W.merged(p[same], (p + k + n - 1)[same])
                out.append([{"s": int(x), "e": int(y)} for x, y in zip(s, e, strict=True)])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text"), batch.column("doc"), pa.array(out, schema.field("spans").type)], schema=schema)


def repeated_spans(docs: DataFrame, n: int = 35, q: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, doc, spans): per row the word spans covered by an ``n``-word window found at another place too.

    Null ids count as the smallest id, null texts as without words. Rows that repeat another wholly are
    the same document at the same place and do not count as a repetition; different texts of one id are different documents. Other
    columns are not read.
    """
    rows = C.numbered(C.keyed(docs, id_col, text_col), "op5")
    found = pieces_of_corpus(rows, n, q).groupBy("id").agg(F.collect_list(F.struct("p", "k", "proof")).alias("pieces"))
    spans = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("doc", pa.int64()), ("spans", spans)])
    return rows.join(found, "id", "left").mapInArrow(lambda b: verified(b, n, schema), "id long, text string, doc long, spans array<struct<s:long,e:long>>")


def _cut(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = batch.column("doc"), []
        for row, end, data, offsets in C.slices(batch):
            starts, ends, first = C.word_bounds(data, offsets)
            raw = data.tobytes()
            for i, (s, e) in enumerate(W.spans_of(batch.column("spans").slice(row, end - row))):
                a, n = int(first[i]), int(first[i + 1] - first[i])
                gone = np.zeros(n + 1, np.int64)
                gone[s] += 1
                gone[e] -= 1
                keep = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + a
                kept = b" ".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)])
                doc = ids[row + i].as_py()
                doc = None if doc == C.NULL_ID else doc
                if digest:
                    out.append((doc, n, n - len(keep), hashlib.sha256(kept).hexdigest()))
                else:
                    out.append((doc, n, [{"s": int(x), "e": int(y)} for x, y in zip(s, e, strict=True)], kept.decode()))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        kinds = [pa.int64()] * 3 + [pa.string()] if digest else [pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.string()]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] if digest else ["doc_id", "n_words", "spans", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def substring_dedup(docs: DataFrame, n: int = 35, **columns) -> DataFrame:
    """Per document the removed word spans and the words that stay, one space between."""
    return repeated_spans(docs, n, **columns).mapInArrow(lambda b: _cut(b, False), _CUT)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(C.table(spark, sf_dir, "documents")).mapInArrow(lambda b: _cut(b, True), _DIGEST)
