"""Stretches of words that repeat themselves: a dictionary of basic factors proposes periods, level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Shortest run in words, and how many periods it has at least.
SHORTEST, PERIODS = 24, 3

_FOUND = "id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def word_numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Equal words have equal numbers: a dictionary of the words' bytes, not of hashes."""
    edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    body = data[~C.BLANK[data]]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(body)])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _repeated(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, names, distance to the next equal one or 0) of the keys that occur twice or more, sorted by name and place."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    same = k[1:] == k[:-1]
    twin = np.zeros(len(k), bool)
    twin[1:] |= same
    twin[:-1] |= same
    step = np.zeros(len(k), np.int64)
    step[:-1][same] = (at[order[1:]] - at[order[:-1]])[same]
    name = np.cumsum(np.concatenate([[True], ~same])[twin]) - 1 if len(k) else np.zeros(0, np.int64)
    return at[order[twin]], name, step[twin]


def _stretches(at: np.ndarray, step: np.ndarray, length: int, shortest: int, periods: int) -> np.ndarray:
    """(start, length, period) of progressions at one level: neighbouring factors of ``length`` words with one distance to their successor."""
    fits = (2 * step > length) & (step <= length)
    order = np.argsort(at[fits])
    at, step = at[fits][order], step[fits][order]
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (step[1:] != step[:-1])])) if len(at) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(at)))
    out = np.stack([at[first], size - 1 + length + step[first], step[first]], axis=1)
    return out[out[:, 1] >= np.maximum(shortest, periods * out[:, 2])]


def runs_of(word: np.ndarray, text: np.ndarray, end: np.ndarray, shortest: int = SHORTEST, periods: int = PERIODS) -> np.ndarray:
    """(start, length, period) of every run in many texts laid end to end, by start and period; ``text`` and ``end`` are of each word.

    Level by level a factor of 2**k words is named by the pair of its halves' names; factors that occur once have no name, since no longer
    one that holds them occurs twice. A run of period q and at least 3q words shows on the level L with L/2 < q <= L: each of its factors of L
    words comes again after exactly q words (sooner would give the run a shorter period), so they form one progression with step q.
    Conversely such a progression of 3q words has no shorter period and no neighbour continues it, so it is a whole run, found once.
    """
    n, length, found = len(word), 1, [np.zeros((0, 3), np.int64)]
    at, name, step = _repeated(np.arange(n), text * (int(word.max(initial=0)) + 1) + word)
    while len(at):
        found.append(_stretches(at, step, length, shortest, periods))
        named = np.full(n, -1, np.int64)
        named[at] = name
        inside = at[at + 2 * length <= end[at]]
        inside = np.sort(inside[named[inside + length] >= 0])
        at, name, step = _repeated(inside, named[inside] * (len(at) + 1) + named[inside + length])
        length *= 2
    out = np.concatenate(found)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _find(batches: Iterator[pa.RecordBatch], shortest: int, periods: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, stop, data, offsets in C.slices(batch):
            starts, ends, first = C.word_bounds(data, offsets)
            n = np.diff(first)
            text = np.repeat(np.arange(stop - row), n)
            runs = runs_of(word_numbers(data, starts, ends), text, first[1:][text], shortest, periods)
            again = np.zeros(len(starts) + 1, np.int64)
            np.add.at(again, runs[:, 0] + runs[:, 2], 1)
            np.add.at(again, runs[:, 0] + runs[:, 1], -1)
            kept = np.flatnonzero(np.cumsum(again[:-1]) == 0)
            # kept words with one space after each but a text's last
            last = np.ones(len(kept), bool)
            last[:-1] = text[kept][1:] != text[kept][:-1]
            size = ends[kept] - starts[kept] + ~last
            to = np.concatenate([[0], np.cumsum(size)])
            source = np.repeat(starts[kept] - to[:-1], size) + np.arange(to[-1])
            body = data[np.minimum(source, max(len(data) - 1, 0))]
            body[to[1:][~last] - 1] = 0x20
            bounds = to[np.searchsorted(kept, first)].astype(np.int32)
            collapsed = pa.StringArray.from_buffers(stop - row, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(body)))
            of = text[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
            struct = pa.StructArray.from_arrays([pa.array(runs[:, 0] - first[of]), pa.array(runs[:, 1].copy()), pa.array(runs[:, 2].copy())], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(stop - row + 1)).astype(np.int32)), struct)
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, stop - row), pa.array(n.astype(np.int64)), lists, collapsed], names=["id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST, periods: int = PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row: all runs by start and period, and the words left, one space between.

    Words are what stands between blanks. A run is a stretch of at least ``shortest`` words and ``periods`` (three or more) of its smallest period
    that no neighbouring word extends keeping that period. Of each run only its first period stays in ``collapsed``.

    Null and empty texts have no words, no runs and the empty string; null ids stay null; repeated rows, also of one id, are each judged by
    themselves; an empty table gives no rows. Other columns are not read. A text is one row: a task holds one text, or several short ones, and a dozen numbers
    for each of its words.
    """
    if periods < 3:
        raise ValueError("progressions prove runs of three or more periods only")
    found = C.keyed(docs, id_col, text_col).mapInArrow(lambda b: _find(b, shortest, periods), _FOUND)
    return found.select(C.unkeyed().alias("doc_id"), "n_words", "runs", "collapsed")


def planted(doc_id: Column, text: Column) -> Column:
    """The text, in a tenth of all documents with a stretch at its end that repeats itself; which, and where, the id's checksum tells."""
    h = F.crc32(doc_id.cast("string"))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, g = F.greatest(F.size(words), F.lit(1)).cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    whole = F.flatten(F.array_repeat(F.slice(words, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    again = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(whole, F.lit(1), (n - a).cast("int")))
    return F.when((h % 10 == 0) & (F.size(words) > 0), F.concat_ws(" ", again)).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of null id are not rewritten."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    kind = "struct<start:bigint,length:bigint,period:bigint>"
    # exact comparison of length / period; runs come by start and period, so the first of equals stays
    best = F.aggregate("runs", F.lit(None).cast(kind), lambda s, r: F.when(s.isNull() | (r["length"] * s["period"] > s["length"] * r["period"]), r).otherwise(s))
    line = F.transform("runs", lambda r: F.concat_ws("", F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = periodic_runs(docs).withColumn("best", best)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.concat_ws("", line), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
  xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END))) AS h FROM documents),
g AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM d),
p AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
t AS MATERIALIZED (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
  THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM p),
-- equal words q apart on at least 16 places running, so equal grams of 16 words q apart on at least one
x AS MATERIALIZED (SELECT doc_id, n, unnest(range(n - 15)) AS i, unnest(list_transform(range(n - 15), lambda i: array_to_string(w[i + 1:i + 16], ' '))) AS s FROM t WHERE n >= 24),
e AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM x a JOIN x b ON a.doc_id = b.doc_id AND a.s = b.s AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
f AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
r AS MATERIALIZED (SELECT doc_id, q, min(i) AS s, count(*) + 15 + q AS l FROM f GROUP BY doc_id, q, island HAVING count(*) + 15 + q >= greatest(24, 3 * q)),
run AS MATERIALIZED (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM r z WHERE z.doc_id = r.doc_id AND z.q < r.q AND r.q % z.q = 0 AND z.s <= r.s AND z.s + z.l >= r.s + r.l)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
cut AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
per AS (SELECT doc_id, count(*) AS n_runs, sha256(string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q)) AS runs FROM run GROUP BY doc_id),
best AS (SELECT doc_id, s, l, q FROM run z QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l / q DESC, s, q) = 1),
left_ AS (SELECT t.doc_id, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i - 1)) END AS w FROM t LEFT JOIN cut USING (doc_id))
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli,
  coalesce(runs, sha256('')) AS runs_sha256, sha256(array_to_string(left_.w, ' ')) AS collapsed_sha256
FROM t LEFT JOIN per USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN left_ USING (doc_id)
"""
