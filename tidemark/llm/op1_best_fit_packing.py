"""Packing of tokenised documents into sequences of fixed length by minimum bin slack."""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import common as C

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: The splitter of the byte-level vocabulary (a fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of one length that are numbered together, and the most such groups of a whole table.
GROUP_ROWS, GROUPS = 256, 1_000_000


# ---------------------------------------------------------------- tokens

#: Characters whose Unicode class no two libraries see differently; and what a quadratic merge would choke on.
_PLAIN = re.compile(r"[\x00-\u024f\u2010-\u2027\u20ac]*")
_LONG = re.compile(r"\S{400}|\s{400}")


class Encoder:
    """Ids of a text, as ``tokenizers`` gives them for the vocabulary file ``path``.

    Where a twin file with the same vocabulary as ranks lies beside it, texts of Latin characters
    without very long words go through ``tiktoken``, which gives the same ids in a third of the time; all others
    go through ``tokenizers``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True          # their strings in a text are ordinary text
        twin, self.fast = path.removesuffix(".json") + ".tiktoken", None
        if os.path.exists(twin):
            import tiktoken
            with open(twin, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast and _PLAIN.fullmatch(text) and not _LONG.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype="<u4")


_ENCODERS: dict[str, Encoder] = {}


def tokenize(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int) -> Iterator[pa.RecordBatch]:
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")      # Spark has a task for every core
        _ENCODERS[path] = Encoder(path)
    enc = _ENCODERS[path]
    end = np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        rows: tuple[list, ...] = ([], [], [], [], [])
        ids, texts = batch.column("id"), batch.column("text")
        for i in range(batch.num_rows):
            doc = ids[i].as_py()
            doc = None if doc == C.NULL_ID else doc
            raw = enc.encode(texts[i].as_py()).tobytes() + end
            n = len(raw) // 4
            first = n - (n - 1) // capacity * capacity            # what is left over stands in front
            at = 0
            for k in range((n - 1) // capacity + 1):
                size = first if k == 0 else capacity
                for col, v in zip(rows, (doc, k, at, size, zlib.crc32(raw[4 * at: 4 * (at + size)])), strict=True):
                    col.append(v)
                at += size
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                                         names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents cut only where they exceed ``capacity``."""
    return C.keyed(docs, id_col, text_col).mapInArrow(lambda b: tokenize(b, tokenizer, capacity, end_id), _PIECES)


# ---------------------------------------------------------------- which lengths go together

def fullest(counts: np.ndarray, capacity: int) -> list[int]:
    """Lengths of one bin: the longest there is, and the subset of the others that fills the rest best.

    A bit set holds the reachable fills; lengths enter from long to short, each as often as it is there.
    """
    there = np.flatnonzero(counts)[::-1].tolist()
    top = there[0]
    room = capacity - top
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in there:
        if length > room:
            continue
        for _ in range(min(int(counts[length]) - (length == top), room // length)):
            new = (reach | reach << length) & mask
            if new == reach:
                break
            steps.append((length, reach))
            reach = new
        if reach >> room & 1:
            break
    fill, chosen = reach.bit_length() - 1, [top]
    for length, before in reversed(steps):
        if not before >> fill & 1:
            chosen.append(length)
            fill -= length
    return chosen


def plan_bins(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins) until every piece has a place; ``counts[l]`` pieces have length l.

    A combination is used as often as its lengths last, so the work depends on the number of distinct
    lengths, at most ``capacity``, and hardly on the number of pieces.
    """
    left, out = counts.copy(), []
    while left.any():
        combo = fullest(left, capacity)
        lengths, times = np.unique(combo, return_counts=True)
        bins = int((left[lengths] // times).min())
        left[lengths] -= bins * times
        out.append((combo, bins))
    return out


def layout(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """One row per (kind of bin, length): pieces of that length numbered from ``rank`` on go there."""
    rows, used, sequence = [], {}, 0
    for combo, bins in plan:
        offset = 0
        for length in sorted(set(combo), reverse=True):
            times = combo.count(length)
            rows.append((length, used.get(length, 0), times, sequence, offset))
            used[length] = used.get(length, 0) + times * bins
            offset += times * length
        sequence += bins
    rows.sort()
    return dict(zip(("length", "rank", "times", "sequence", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 5).T, strict=True))


def _place(frames: Iterator[pd.DataFrame], plan: dict[str, np.ndarray]) -> Iterator[pd.DataFrame]:
    key = plan["length"] * (1 << 50) + plan["rank"]
    for pdf in frames:
        length = pdf["length"].to_numpy()
        row = np.searchsorted(key, length * (1 << 50) + pdf["rank"].to_numpy(), side="right") - 1
        k, times = pdf["rank"].to_numpy() - plan["rank"][row], plan["times"][row]
        yield pdf.drop(columns=["rank"]).assign(sequence_id=plan["sequence"][row] + k // times, offset=plan["offset"][row] + k % times * length)


def pack(rows: DataFrame, capacity: int = 1024) -> DataFrame:
    """``rows`` (doc_id, piece, start, length, ids_crc32) with ``sequence_id`` and ``offset``.

    The histogram of lengths, at most ``capacity`` rows, decides the bins on the driver. Pieces are then
    numbered within their length, in groups of a few hundred rows (hashed from document and piece) whose sizes are summed
    first, so a length that a third of all pieces have is spread over as many tasks as any other.
    """
    rows = C.stored(rows, "op1-pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for r in rows.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    if not counts.any():
        return rows.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    plan = layout(plan_bins(counts, capacity))
    size = max(GROUP_ROWS, int(counts.sum()) // GROUPS)
    groups = F.create_map(*[F.lit(int(x)) for length in np.flatnonzero(counts > size) for x in (length, counts[length] // size + 1)]) if (counts > size).any() else None
    n_groups = F.coalesce(groups[F.col("length").cast("int")], F.lit(1)) if groups is not None else F.lit(1)
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), n_groups.cast("long")))
    sizes = rows.groupBy("length", "grp").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "grp", (F.sum("n").over(Window.partitionBy("length").orderBy("grp")) - F.col("n")).alias("before"))
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("length", "grp").orderBy("doc_id", "piece")))
    ranked = ranked.join(before, ["length", "grp"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInPandas(lambda it: _place(it, plan), _PIECES + ", sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, **columns) -> DataFrame:
    """Every token of every document in exactly one sequence of at most ``capacity`` tokens.

    Null texts count as empty and give one piece with the end id alone; null ids stay null; repeated rows are
    packed each; an empty table gives an empty result. Other columns are not read.
    """
    return pack(pieces(docs, tokenizer, capacity, end_id, **columns), capacity)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return best_fit_packing(C.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
