"""Lloyd's rounds over vectors that are cut by dimension: a task sees one block of components and that slice of the centroids."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Components of a shard.
WIDTH = 16
#: Integer components may not reach this; then no squared distance of 64 of them reaches 2**63.
LIMIT = 1 << 27
#: Rows that a task multiplies with the centroids at once.
ROWS = 4096


def _exact_squares(x: np.ndarray, slice_: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centroid over these components, exact in 64-bit integers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(slice_).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:        # every partial sum is a whole number that a double holds
        a, c = x.astype(np.float64), slice_.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    out = np.zeros((len(x), len(slice_)), np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None] - slice_[None, :, j]) ** 2
    return out


def _partial(batches: Iterator[pa.RecordBatch], slice_: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(row, d): the distances of a row to all centroids over the columns of one shard, as 64-bit integers in one binary."""
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            x = np.stack([batch.column(1 + j).to_numpy() for j in range(slice_.shape[1])], axis=1).astype(np.int64)
            d = np.ascontiguousarray(_exact_squares(x, slice_))
            ends = np.arange(len(d) + 1, dtype=np.int64) * d.shape[1] * 8
            col = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(d), [None, pa.py_buffer(ends), pa.py_buffer(d)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), col], names=["row", "d"])


def _nearest(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(row, cluster, distance) from rows sorted by ``row``: blocks of a row are added, the least sum wins, the smaller number on ties."""
    held, total = None, None
    for whole in batches:
        for at in range(0, whole.num_rows, ROWS):
            batch = whole.slice(at, ROWS)
            rows = batch.column("row").to_numpy()
            col = batch.column("d")
            d = np.frombuffer(col.buffers()[2], dtype=np.int64)[col.offset * k: (col.offset + len(col)) * k].reshape(-1, k)
            first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            keys, sums = rows[first], np.add.reduceat(d, first, axis=0)
            if held is not None and keys[0] == held:
                sums[0] += total
            elif held is not None:
                keys, sums = np.concatenate([[held], keys]), np.concatenate([total[None], sums])
            held, total = keys[-1], sums[-1].copy()
            if len(keys) > 1:
                yield _chosen(keys[:-1], sums[:-1])
    if held is not None:
        yield _chosen(np.array([held]), total[None])


def _chosen(keys: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
    best = sums.argmin(axis=1)
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(best.astype(np.int32)), pa.array(sums[np.arange(len(keys)), best])], names=["row", "cluster", "distance"])


def _shards(dims: int, width: int) -> list[range]:
    return [range(a, min(a + width, dims)) for a in range(0, dims, width)]


def _columns(shard: range) -> list[str]:
    return [f"x{j}" for j in shard]


def assign(vectors: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> DataFrame:
    """(row, cluster, distance): one scan per shard reads the shard's columns only; the blocks of a row meet in one shuffle."""
    parts = []
    for shard in _shards(centroids.shape[1], width):
        slice_ = np.ascontiguousarray(centroids[:, shard.start: shard.stop])
        parts.append(vectors.select("row", *_columns(shard)).mapInArrow(lambda b, s=slice_: _partial(b, s), "row long, d binary"))
    blocks = reduce(DataFrame.unionAll, parts).repartition("row").sortWithinPartitions("row")
    return blocks.mapInArrow(lambda b: _nearest(b, len(centroids)), "row long, cluster int, distance long")


def update(vectors: DataFrame, assigned: DataFrame, centroids: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Each shard sums its own components by cluster (partial sums before the shuffle); a cluster without vectors keeps its centroid."""
    out = centroids.copy()
    for shard in _shards(centroids.shape[1], width):
        sums = [F.sum(x).alias(x) for x in _columns(shard)]          # below 2**27 each, so 2**36 vectors of one cluster fit
        rows = vectors.select("row", *_columns(shard)).join(assigned.select("row", "cluster"), "row").groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums)
        for r in rows.collect():                         # at most one row per centroid
            out[r["cluster"], shard.start: shard.stop] = [r[x] // r["n"] for x in _columns(shard)]
    return out


def whole_components(dims: int, scale: int, vector_col: str) -> tuple[Column, list[Column]]:
    """(is it kept, integer components x0, x1, ...) of a vector column."""
    vec = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = (F.size(vec) == dims) & F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * scale) < LIMIT))
    return F.coalesce(fine, F.lit(False)), [F.floor(F.get(vec, F.lit(j)) * scale).cast("int").alias(f"x{j}") for j in range(dims)]


def lloyd(rows: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2, width: int = WIDTH,
          id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(clusters, centroids): ``clusters`` has (vec_id, cluster, distance) per kept vector, ``centroids`` one row of integers per number.

    A vector is kept when it has exactly ``dims`` components, none null or non-finite, and counts with the integers floor(scale * x). The
    first centroids are the ``k`` kept vectors with the least sha256 of ``seed:id`` (fewer where fewer are kept). In each of ``rounds`` rounds every vector
    goes to the nearest centroid, the smaller number on ties, and each non-empty centroid moves to the componentwise floor of the mean; then
    vectors are assigned once more. All sums are of whole numbers and exact. Components of 2**27 and more after scaling would
    leave 64-bit distances, so vectors that hold one are not kept.

    Vectors are stored once with one column per component; a shard is ``width`` of those columns. What reaches the driver are the centroids, k * dims
    numbers a round whatever the input. Null ids and repeated ids are vectors of their own; null ids come last among the first centroids, equal hashes go by
    components. An empty table, or one without kept vectors, gives no rows and no centroids. Other columns are not read.
    """
    kept, parts = whole_components(dims, scale, vector_col)
    xs = [f"x{j}" for j in range(dims)]
    vectors = C.stored(rows.filter(kept).select(F.col(id_col).cast("long").alias("id"), *parts).withColumn("row", F.monotonically_increasing_id()), "op11-vectors")
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = vectors.orderBy(draw.asc_nulls_last(), *xs).limit(k).select(*xs).collect()
    centroids = np.array([list(r) for r in first], dtype=np.int64).reshape(len(first), dims)
    if not len(first):
        return vectors.select(F.col("id").alias("vec_id"), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        assigned = C.stored(assign(vectors, centroids, width), "op11-assigned")
        centroids = update(vectors, assigned, centroids, width)
        C.forget(assigned)
    assigned = C.stored(assign(vectors, centroids, width), "op11-assigned")
    return assigned.join(vectors.select("row", "id"), "row").select(F.col("id").alias("vec_id"), "cluster", "distance"), centroids


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256); sums beyond 64 bits would be null."""
    found, centroids = lloyd(C.table(spark, sf_dir, "embeddings"))
    found = C.stored(found, "op11-clusters")
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).join(
        spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster").collect()      # one row per centroid
    total = sum(int(r["s"]) for r in per)
    fits = lambda n: n if n < 1 << 63 else None
    sums = spark.createDataFrame([(r["cluster"], fits(int(r["s"])), fits(total), r["centroid_sha256"]) for r in per], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(sums), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> str:
    near = """d{r} AS MATERIALIZED (SELECT v.vec_id, c.c, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{r} c USING (j) GROUP BY 1, 2),
a{r} AS MATERIALIZED (SELECT vec_id, min(d) AS d, arg_min(c, d * 1000 + c) AS c FROM d{r} GROUP BY 1)"""
    move = """c{n} AS MATERIALIZED (SELECT c.c, c.j, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN
  (SELECT a.c, v.j, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS x FROM a{r} a JOIN v USING (vec_id) GROUP BY 1, 2) m ON m.c = c.c AND m.j = c.j)"""
    steps = [near.format(r=0)]
    for r in range(rounds):
        steps += [move.format(r=r, n=r + 1), near.format(r=r + 1)]
    return f"""
WITH kept AS (SELECT vec_id, embedding AS e FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
v AS MATERIALIZED (SELECT vec_id, unnest(range({dims})) AS j, CAST(unnest(list_transform(e, lambda x: floor({scale} * CAST(x AS DOUBLE)))) AS BIGINT) AS x FROM kept),
first AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c FROM kept ORDER BY c LIMIT {k}),
c0 AS MATERIALIZED (SELECT c, j, x FROM first JOIN v USING (vec_id)),
{(',' + chr(10)).join(steps)},
s AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS h FROM c{rounds} GROUP BY 1)
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} a JOIN s ON s.c = a.c
"""


ORACLE = _oracle()
