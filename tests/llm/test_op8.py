import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import op8_embedding_dedup as op8


def brute(rows, least=0.98):
    good = {}
    for k, (d, v, label) in enumerate(rows):
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[k] = np.array(v, dtype=np.float64) / np.abs(v).max()
    links = {k: set() for k in range(len(rows))}
    for i in good:
        for j in good:
            if i != j and rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]):
                if good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= least:
                    links[i].add(j)
    key = lambda k: -1e30 if rows[k][0] is None else rows[k][0]
    out = []
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        low = rows[min(seen, key=key)][0]
        out.append((rows[k][0], len(links[k]), low, low == rows[k][0]))
    return sorted(out, key=str)


def test_nearest_e8_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8)) * 3
    c = op8.nearest_e8(x)
    assert ((np.abs(c * 2 - np.rint(c * 2)) < 1e-9).all()) and (np.rint(c.sum(axis=1)) % 2 == 0).all()
    near = ((x[:, None] - (c[:, None] + op8.SHORTEST)) ** 2).sum(axis=2).min(axis=1)
    assert (((x - c) ** 2).sum(axis=1) <= near + 1e-12).all()


def test_links_are_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for label in (0, 1, -3):
        base = rng.normal(size=16)
        for _ in range(300):                       # one large group of near copies, larger than a block
            rows.append((len(rows), (base + rng.normal(size=16) * 0.1).tolist(), label))
        for _ in range(60):
            v = rng.normal(size=16)
            rows += [(len(rows), v.tolist(), label), (len(rows) + 1, (v * 3).tolist(), label)]
    rows += [(9001, [1.0] * 16, 5), (9002, [1.0] * 16, 5), (9003, [1.0] * 16, None), (9004, None, 5), (9005, [], 5), (9006, [0.0] * 16, 5), (9007, [None, 1.0] * 8, 5),
             (9008, [float("nan")] * 16, 5), (9009, [float("inf")] * 16, 5), (9010, [1.0] * 15, 5), (None, [1.0] * 16, 5), (9011, [2.0, 1.0], 5), (9012, [2.0, 1.01], 5), (9013, [1e30] * 16, 5)]
    docs = spark.createDataFrame([(d, v, x, 3, "q") for d, v, x in rows], "vec_id long, embedding array<float>, label int, c int, unit string").repartition(5)
    f32 = [(d, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None, x) for d, v, x in rows]
    assert sorted((tuple(r) for r in op8.near_vectors(docs).collect()), key=str) == brute(f32)
    assert op8.near_vectors(docs.limit(0)).count() == 0


@pytest.mark.parametrize("least", [0.9, 0.98])
def test_isolated_pairs_are_found_at_every_dimension(spark, least):
    """Pairs just above the threshold, each under a label of its own, so nothing but its own cells can bring a pair together."""
    rng, rows, label = np.random.default_rng(12), [], 0
    dims, pairs = (5, 8, 12, 16, 32, 64, 768), 1500
    for dim in dims:
        n = pairs if dim < 768 else 400
        x, y = rng.normal(size=(2, n, dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
        y -= (x * y).sum(axis=1)[:, None] * x
        y /= np.linalg.norm(y, axis=1)[:, None]
        c = least + 1e-6
        z = c * x + np.sqrt(1 - c * c) * y
        for k in range(n):
            rows += [(len(rows), x[k].tolist(), label), (len(rows) + 1, z[k].tolist(), label)]
            label += 1
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(8)
    got = op8.near_vectors(docs, least).join(docs.select("vec_id", F.size("embedding").alias("dim")), "vec_id")
    share = {r.dim: r.share for r in got.groupBy("dim").agg(F.avg((F.col("n_links") == 1).cast("int")).alias("share")).collect()}
    assert set(share) == set(dims) and min(share.values()) >= 0.999, share
