"""Exact substring dedup: later copies of long byte strings are cut out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import windows as W

_CUT = "doc_id long, n_bytes long, spans array<struct<s:long,e:long>>, kept binary"
_DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def later_copies(docs: DataFrame, n: int = 100, q: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, doc, spans): per row of ``docs`` the stretches covered by an ``n``-byte string that starts earlier.

    Earlier is a smaller id, or the same id and a smaller start. No suffix is sorted: runs of windows with one minimiser
    (:mod:`tidemark.llm.windows`) are hashed and grouped by minimiser and content; single windows are hashed and compared only
    where one minimiser has several contents.

    Null ids count as the smallest id, null texts as empty; texts under ``n`` bytes lose nothing. Rows that
    repeat another wholly are the same document at the same place, so they take nothing from each other; different texts of
    one id are different documents, in the order of their hashes. Other columns are not read.
    """
    rows = C.numbered(C.keyed(docs, id_col, text_col), "op3")
    found = W.repeated(rows, "byte", n, q, "op3").filter("NOT is_first")
    return rows.join(W.ranges(found, n), "id", "left")


def _cut(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = batch.column("doc"), []
        for row, end, data, offsets in C.slices(batch, most=16 << 20):
            spans = W.spans_of(batch.column("spans").slice(row, end - row))
            for i, (s, e) in enumerate(spans):
                text = data[offsets[i]: offsets[i + 1]]
                keep = np.concatenate([[0], e]), np.concatenate([s, [len(text)]])
                kept = [text[a:b] for a, b in zip(*keep, strict=True)]
                doc = ids[row + i].as_py()
                doc = None if doc == C.NULL_ID else doc
                if digest:
                    h = hashlib.sha256()
                    for x in kept:
                        h.update(x.data if x.flags.c_contiguous else x.tobytes())
                    out.append((doc, len(text), int((e - s).sum()), len(s), h.hexdigest()))
                else:
                    out.append((doc, len(text), [{"s": int(a), "e": int(b)} for a, b in zip(s, e, strict=True)], b"".join(x.tobytes() for x in kept)))
        cols = list(zip(*out, strict=True)) if out else [[]] * (5 if digest else 4)
        kinds = ([pa.int64()] * 4 + [pa.string()]) if digest else [pa.int64(), pa.int64(), pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])), pa.binary()]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] if digest else ["doc_id", "n_bytes", "spans", "kept"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def suffix_dedup(docs: DataFrame, n: int = 100, **columns) -> DataFrame:
    """Per document the removed byte spans and the bytes that stay (may cut a character in two, hence binary)."""
    return later_copies(docs, n, **columns).mapInArrow(lambda b: _cut(b, False), _CUT)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return later_copies(C.table(spark, sf_dir, "documents")).mapInArrow(lambda b: _cut(b, True), _DIGEST)
