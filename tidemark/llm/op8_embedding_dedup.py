"""Near-duplicate vectors: cells of the E8 lattice propose pairs, exact cosines confirm them."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Tables, and cells looked up in each (the own one and the nearest neighbours).
TABLES, CELLS = 6, 9
#: Squared distance at which a pair that just is a link lies apart after projection, on average; the lattice's points are sqrt(2) apart or more.
APART = 0.5
#: Rows of a component that are multiplied with one another at once.
BLOCK = 256

#: The 240 shortest vectors of E8.
SHORTEST = np.array([v for v in itertools.product((-1, 0, 1), repeat=8) if sum(map(abs, v)) == 2]
                    + [v for v in itertools.product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0])


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Integer points with an even sum: round, and move the worst coordinate the other way where the sum is odd."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2 != 0)
    worst = np.abs(x[odd] - r[odd]).argmax(axis=1)
    r[odd, worst] += np.where(x[odd, worst] >= r[odd, worst], 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The lattice is D8 together with D8 shifted by one half in every coordinate."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def scale(dim: int, least: float) -> float:
    """The length a unit vector gets, so that pairs of cosine ``least`` are equally far apart whatever the dimension: of the squared
    distance 2 - 2 * least, eight of ``dim`` directions keep 8 / dim."""
    return float(np.sqrt(APART * dim / (16 * max(1 - least, 1e-9))))


def projection(dim: int, table: int, least: float) -> np.ndarray:
    """Eight random orthogonal directions (fewer dimensions: a random map), the same on every machine."""
    g = np.random.Generator(np.random.PCG64([dim, table])).normal(size=(dim, max(dim, 8)))
    return (np.linalg.qr(g)[0][:, :8] if dim >= 8 else g[:, :8] / np.sqrt(dim)) * scale(dim, least)


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of equal length from an Arrow list column: (dimension of each row, flat values)."""
    return col.value_lengths().to_numpy(zero_copy_only=False), col.flatten().to_numpy(zero_copy_only=False)


def _cells(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(key, id, w): the cells each unit vector is looked up in; w = 1 for its own."""
    for batch in batches:
        dims, flat = _matrix(batch.column("unit"))
        ids, labels = batch.column("id").to_numpy(), batch.column("label").to_numpy().astype(np.int64)
        begin = np.cumsum(dims) - dims
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            x = flat[begin[rows][:, None] + np.arange(dim)]
            for t in range(TABLES):
                y = x @ projection(int(dim), t, least)
                home = nearest_e8(y)
                near = np.argpartition(-((y - home) @ SHORTEST.T), CELLS - 2, axis=1)[:, :CELLS - 1]
                cells = np.concatenate([home[:, None], home[:, None] + SHORTEST[near]], axis=1)
                key = np.full(cells.shape[:2], (int(dim) << 8) + t, dtype=np.uint64)
                key = C.mix(key + C.mix(labels[rows].astype(np.uint64))[:, None])
                for j in range(8):
                    key = C.mix(key + (2 * cells[:, :, j]).astype(np.int64).astype(np.uint64) + np.uint64(j))
                own = np.zeros(cells.shape[:2], dtype=np.int64)
                own[:, 0] = 1
                yield pa.RecordBatch.from_arrays([pa.array(C.signed(key.reshape(-1))), pa.array(np.repeat(ids[rows], CELLS)), pa.array(own.reshape(-1))],
                                                 names=["key", "id", "w"])


def _alike(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dims, x = _matrix(batch.column("x"))
        dims_y, y = _matrix(batch.column("y"))
        same = np.flatnonzero(dims == dims_y)
        begin, begin_y = np.cumsum(dims) - dims, np.cumsum(dims_y) - dims_y
        dot = np.zeros(batch.num_rows)
        for dim in np.unique(dims[same]):
            r = same[dims[same] == dim]
            at = np.arange(dim)
            dot[r] = np.einsum("ij,ij->i", x[begin[r][:, None] + at], y[begin_y[r][:, None] + at])
        keep = pa.array(dot >= least)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])


def _confirm(pairs: DataFrame, units: DataFrame, least: float) -> DataFrame:
    left, right = (units.select(F.col("id").alias(i), F.col("unit").alias(u)) for i, u in (("a", "x"), ("b", "y")))
    return pairs.join(right, "b").join(left, "a").mapInArrow(lambda it: _alike(it, least), "a long, b long")


def _count(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Weights of the linked vectors, for one block of a component against another, or for several whole components."""
    out = []
    for _, g in pdf.groupby("component", sort=False):
        left = g[g["side"] != 2]
        right = g[g["side"] != 1]
        x, y = np.stack(left["unit"].to_list()), np.stack(right["unit"].to_list())
        near = x @ y.T >= least
        near &= left["id"].to_numpy()[:, None] != right["id"].to_numpy()
        out.append(pd.DataFrame({"id": left["id"], "links": near @ right["c"].to_numpy()}))
        if (g["side"] != 0).any():
            out.append(pd.DataFrame({"id": right["id"], "links": left["c"].to_numpy() @ near}))
    return pd.concat(out)


def near_vectors(rows: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Two vectors are linked when their labels are equal and not null, they have the same length, and their cosine in
    double precision is at least ``least``. Null or empty vectors, the zero vector, and vectors with null or
    non-finite components link with nothing.

    The lattice is scaled to the dimension and to ``least``: tests find at least 0.999 of isolated pairs just above it at 8 to 768 dimensions.

    Equal vectors of one label are one class with a weight, so a group of copies costs one vector. All links of a
    vector lie in its component; they are counted block by block, without listing pairs. Null ids count as the
    smallest id; rows that repeat an id count as further vectors under that id. Other columns are not read.
    """
    vec = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    rows = rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(C.NULL_ID)).alias("id"), vec.alias("vec"), F.col(label_col).cast("long").alias("label"))
    big = F.array_max(F.transform("vec", F.abs))
    scaled = F.transform("vec", lambda v: v / F.col("big"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    good = F.col("label").isNotNull() & F.coalesce(F.size("vec") > 0, F.lit(False)) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & (F.col("big") > 0)
    rows = rows.withColumn("big", big).withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.withColumn("vec", F.when(F.col("good"), scaled)).withColumn("norm", norm)
    rows = rows.select("id", "label", F.when(F.col("good"), F.transform("vec", lambda v: v / F.col("norm"))).alias("unit"))
    rows = C.stored(rows.withColumns({"h1": F.xxhash64("unit"), "h2": F.xxhash64(F.lit(1), "unit")}), "op8-rows")
    same = ["label", "h1", "h2"]
    classes = C.stored(rows.filter("unit IS NOT NULL").groupBy(*same).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")), "op8-classes")
    units = C.stored(rows.join(classes, same).filter("id = rep").select("id", "label", "unit", "c"), "op8-units")
    cells = units.mapInArrow(lambda b: _cells(b, least), "key long, id long, w long")
    shared = cells.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max("w").alias("home")).filter("lo <> hi AND home = 1").select("key")
    members = C.stored(cells.join(C.stored(shared, "op8-shared"), "key"), "op8-members")
    near = C.linked_groups(members, lambda w, other: (w == 1) | (other == 1), lambda pairs: _confirm(pairs, units, least), "op8")
    sizes = near.groupBy("component").agg((F.floor(F.count(F.lit(1)) / BLOCK) + 1).alias("blocks"))
    inside = units.join(near, "id").join(sizes, "component").select("component", "id", "unit", "c", "blocks")
    one = inside.filter("blocks = 1").select("component", "id", "unit", "c", F.lit(0).alias("side"), F.pmod(F.xxhash64("component"), F.lit(1 << 40)).alias("big"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    n_small = max(1, one.count() // BLOCK)
    one = one.withColumn("big", F.pmod("big", F.lit(n_small)))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    many = inside.filter("blocks > 1").withColumn("blk", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)))
    many = many.select("component", "id", "unit", "c", F.when(F.col("blk") == F.col("other"), 0).when(F.col("blk") < F.col("other"), 1).otherwise(2).alias("side"),
                       (-F.col("component") - 1).alias("big"), F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"))
    counts = one.unionByName(many).groupBy("big", "i", "j").applyInPandas(lambda pdf: _count(pdf, least), "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))
    per_class = C.stored(classes.join(near.withColumnRenamed("id", "rep"), "rep", "left").join(counts.withColumnRenamed("id", "rep"), "rep", "left").select(
        *same, (F.coalesce("links", F.lit(0)) + F.col("c") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "op8-result")
    found = F.coalesce("component", "id")
    return rows.select("id", *same, F.col("unit").isNotNull().alias("good")).join(per_class, same, "left").select(
        C.unkeyed().alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(found != C.NULL_ID, found).alias("component_id"), (F.col("id") == found).alias("kept"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(C.table(spark, sf_dir, "embeddings"))
