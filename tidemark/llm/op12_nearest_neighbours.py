"""Nearest neighbours of a stated query set: int8 products of blocks bound every distance, what survives is recomputed, heaps merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Bytes of the vectors of one block of queries; a task holds one block and a slice of the candidates that stream by.
QUERY_BYTES = 1 << 24
#: Candidates in one slice.
CANDIDATES = 1 << 14
#: Copies of a query's list of neighbours, among which the queries of equal vectors are dealt.
SALTS = 16
#: Rows and columns of a tile of products, and pairs recomputed at once.
TILE_QUERIES, TILE_CANDIDATES, PAIRS = 512, 4096, 1 << 15


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 codes, scale, length, length of the rounding error) of each row; scale * code is the row up to the error."""
    scale = np.abs(x).max(axis=1, initial=0) / 127
    with np.errstate(over="ignore", invalid="ignore"):
        code = np.clip(np.rint(x / np.where(scale > 0, scale, 1)[:, None]), -127, 127)
        rest = x - code * scale[:, None]
        return code.astype(np.int8), scale, np.sqrt((x * x).sum(axis=1)), np.sqrt((rest * rest).sum(axis=1))


def _bounds(q: tuple, c: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances between the rows of two quantised blocks.

    a·b differs from the product of the codes by at most |a|·err(b) + err(a)·(|b| + err(b)). Products of codes are whole numbers below
    2**24 for up to 1,040 components, so single precision holds them; longer vectors use double precision.
    """
    (qc, qs, qn, qe), (cc, cs, cn, ce) = q, c
    kind = np.float32 if qc.shape[1] <= 1040 else np.float64
    with np.errstate(over="ignore", invalid="ignore"):
        dot = (qc.astype(kind) @ cc.astype(kind).T).astype(np.float64) * qs[:, None] * cs
        size = (qn * qn)[:, None] + cn * cn
        slack = 2 * (qn[:, None] * ce + qe[:, None] * (cn + ce)) + 1e-9 * size
        mid = size - 2 * dot
        return mid - slack, mid + slack


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows; squares are summed component after component in double precision."""
    out = np.zeros(len(x))
    with np.errstate(over="ignore"):
        for j in range(x.shape[1]):
            d = x[:, j] - y[:, j]
            out += d * d
    return np.sqrt(out)


class Heaps:
    """The ``k`` nearest found so far of each query of a block: distance and id, ties to the smaller id. Free places are infinitely far."""

    def __init__(self, n: int, k: int):
        self.k, self.far = k, np.full((n, k), np.inf)
        self.who, self.taken = np.zeros((n, k), np.int64), np.zeros((n, k), bool)
        self.radius = np.full(n, np.inf)      # squared; no farther candidate is wanted

    def push(self, at: np.ndarray, far: np.ndarray, who: np.ndarray) -> None:
        mine = np.unique(at)
        rows = np.concatenate([np.repeat(mine, self.k), at])
        far = np.concatenate([self.far[mine].reshape(-1), far])
        who = np.concatenate([self.who[mine].reshape(-1), who])
        taken = np.concatenate([self.taken[mine].reshape(-1), np.ones(len(at), bool)])
        order = np.lexsort((who, far, ~taken, rows))
        take = order[np.searchsorted(rows[order], mine)[:, None] + np.arange(self.k)]
        self.far[mine], self.who[mine], self.taken[mine] = far[take], who[take], taken[take]
        last = self.far[mine, -1]
        with np.errstate(over="ignore"):
            self.radius[mine] = np.minimum(self.radius[mine], last * last * (1 + 1e-12))


def _meet(heaps: Heaps, q: tuple, x: np.ndarray, c: tuple, y: np.ndarray, ids: np.ndarray, first: np.ndarray) -> None:
    """Some candidates against the whole block of queries, tile by tile; candidate j has the ids ``ids[first[j]: first[j + 1]]``."""
    for a in range(0, len(x), TILE_QUERIES):
        rows = slice(a, a + TILE_QUERIES)
        low, high = _bounds(tuple(v[rows] for v in q), c)
        if high.shape[1] >= heaps.k:
            open_ = np.flatnonzero(np.isinf(heaps.radius[rows]))
            if len(open_):                  # the k-th least upper bound of any candidates is a radius
                kth = np.partition(high[open_], heaps.k - 1, axis=1)[:, heaps.k - 1]
                heaps.radius[a + open_] = np.where(np.isnan(kth), np.inf, kth)
        i, j = np.nonzero(~(low > heaps.radius[rows][:, None]))
        for p in range(0, len(i), PAIRS):
            at, of = a + i[p: p + PAIRS], j[p: p + PAIRS]
            far, n = _distances(x[at], y[of]), first[of + 1] - first[of]
            each = np.repeat(first[of] - np.cumsum(n) + n, n) + np.arange(n.sum())
            heaps.push(np.repeat(at, n), np.repeat(far, n), ids[each])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (tile, side): a tile's queries (side 0), then its candidates; out go each query's k nearest of the tile."""
    tile, keys, xs, q, heaps = None, [], [], None, None

    def done() -> Iterator[pa.RecordBatch]:
        if heaps is not None:
            at, of = np.nonzero(heaps.taken)
            yield pa.RecordBatch.from_arrays([pa.array(keys[at, 0]), pa.array(keys[at, 1]), pa.array(heaps.who[at, of]), pa.array(heaps.far[at, of])], names=["h1", "h2", "id", "score"])

    for batch in batches:
        tiles, side = batch.column("tile").to_numpy(), batch.column("side").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], (tiles[1:] != tiles[:-1]) | (side[1:] != side[:-1])]))
        for a, b in zip(edge, [*edge[1:], len(tiles)], strict=True):
            if tiles[a] != tile:
                yield from done()
                tile, keys, xs, q, heaps = tiles[a], [], [], None, None
            for p in range(a, b, TILE_CANDIDATES):
                part = batch.slice(p, min(TILE_CANDIDATES, b - p))
                y = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                if side[a] == 0:
                    keys.append(np.stack([part.column("h1").to_numpy(), part.column("h2").to_numpy()], axis=1))
                    xs.append(y)
                    continue
                if heaps is None:
                    if not len(xs):
                        break                # a slice whose block of queries is empty
                    keys, xs = np.concatenate(keys), np.concatenate(xs)
                    q, heaps = quantised(xs), Heaps(len(xs), k)
                mates = part.column("mates")
                first = np.concatenate([[0], np.cumsum(mates.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
                _meet(heaps, q, xs, quantised(y), y, mates.flatten().to_numpy(), first)
    yield from done()


def usable(vector_col: str) -> tuple[Column, Column]:
    """(the vector in double precision, whether it takes part)."""
    vec = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec, lambda v: v != 0)
    return vec, F.coalesce(fine, F.lit(False))


def nearest(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding",
            query_bytes: int = QUERY_BYTES, candidates: int = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` holds for the ``k`` nearest other rows by Euclidean distance.

    Nearest first, ties to the smaller id; all of them where there are fewer. The result is exact: a pair is passed over only when the lower
    bound of its distance exceeds a radius within which k candidates are known to be. Null or empty vectors, the zero vector, and vectors with a null
    or non-finite component take no part; vectors of different length are not compared. Rows of null id are no queries but are found, as the smallest
    id; rows that repeat another wholly are one; different vectors of one id are vectors of their own, so a query can find its own id.
    Distances beyond the range of a double are infinite. Other columns are not read.

    Equal vectors are one class in the search (equal by 128 bits of hashes). Of a class only its k + 1 smallest ids can be among anybody's k
    nearest, so a group of copies, however large, sends one vector with k + 1 ids. A tile is one block of queries and one slice of the
    candidates: blocks are dealt by hash to about ``query_bytes``, slices to about ``candidates`` classes. Every slice meets every block, which is the size of the
    stated search; a task keeps one block, its heaps and some thousand candidates in memory.
    """
    vec, fine = usable(vector_col)
    key = ["h1", "h2"]
    base = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(C.NULL_ID)).alias("id"), vec.alias("vec"), F.coalesce(is_query & F.col(id_col).isNotNull(), F.lit(False)).alias("asks"), fine.alias("fine"))
    base = C.stored(base.filter("fine").drop("fine").withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(1), "vec")}), "op12-rows")
    members = C.stored(base.groupBy("id", *key).agg(F.max("asks").alias("asks")), "op12-members")
    few = members.withColumn("turn", F.row_number().over(W.partitionBy(*key).orderBy("id"))).filter(F.col("turn") <= k + 1)
    mates = few.groupBy(*key).agg(F.sort_array(F.collect_list("id")).alias("mates")).join(members.groupBy(*key).agg(F.max("asks").alias("asks")), key)
    classes = C.stored(base.select(*key, "vec").dropDuplicates(key).join(mates, key).withColumn("dim", F.size("vec")), "op12-classes")
    # one row per length of vectors that are asked for
    sizes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asks").cast("long")).alias("q")).filter("q > 0").select(
        "dim", F.ceil(F.col("q") * F.col("dim") * 9 / query_bytes).cast("int").alias("blocks"), F.ceil(F.col("n") / candidates).cast("int").alias("slices"))
    dealt = classes.join(sizes, "dim")
    place = lambda n, salt: F.pmod(F.xxhash64(F.lit(salt), *key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = dealt.filter("asks").withColumn("block", place("blocks", 1)).withColumn("slice", every("slices")).withColumn("side", F.lit(0)).withColumn("mates", F.array().cast("array<long>"))
    found = dealt.withColumn("slice", place("slices", 2)).withColumn("block", every("blocks")).withColumn("side", F.lit(1))
    tiles = asking.unionByName(found).select(F.xxhash64("dim", "block", "slice").alias("tile"), "side", *key, "vec", "mates")
    tiles = tiles.repartition("tile").sortWithinPartitions("tile", "side")
    near = tiles.mapInArrow(lambda b: _search(b, k + 1), "h1 long, h2 long, id long, score double")
    best = near.withColumn("turn", F.row_number().over(W.partitionBy(*key).orderBy("score", "id"))).filter(F.col("turn") <= k + 1)
    lists = best.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("near"))
    lists = C.stored(lists, "op12-lists").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = members.filter("asks").withColumnRenamed("id", "query_id").withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int"))
    others = F.filter("near", lambda s: (s["id"] != F.col("query_id")) | (s["score"] > 0))
    out = asked.join(lists, [*key, "salt"]).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("rank", "s"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), C.unkeyed("s.id").alias("vec_id"), F.col("s.score").alias("score"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])))) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) <= 10
"""
