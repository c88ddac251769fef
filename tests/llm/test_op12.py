import math

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import op12_nearest_neighbours as op12

SCHEMA = "vec_id long, embedding array<double>, h1 int, score string, side int, tile int"


def brute(rows, asks, k):
    good, seen = [], set()
    for d, v in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v) and (d, tuple(v)) not in seen:
            seen.add((d, tuple(v)))
            good.append((d, v))
    out = []
    for a, (d, v) in enumerate(good):
        if d is None or not asks(d):
            continue
        near = []
        for b, (e, w) in enumerate(good):
            if a != b and len(v) == len(w):
                s = 0.0
                for x, y in zip(v, w, strict=True):
                    s += (x - y) * (x - y)
                near.append((math.sqrt(s), e is not None, e or 0))
        out += [(d, r + 1, e if there else None, s) for r, (s, there, e) in enumerate(sorted(near)[:k])]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(d, v, 1, "s", 2, 3) for d, v in rows], SCHEMA).repartition(5)


def search(spark, rows, k=10, **options):
    return sorted((tuple(r) for r in op12.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0, k, **options).collect()), key=str)


def test_search_is_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 12))
    rows = [(i, (base[i % 6] + rng.normal(size=12) * (0.001 if i % 2 else 1)).tolist()) for i in range(500)]       # near copies within the bounds of int8
    rows += [(1000 + i, [0.5] * 12) for i in range(200)]                          # a large group of copies, queries among them
    rows += [(2000 + i, (rng.integers(-1, 2, 12) * 1.0).tolist()) for i in range(100)]   # ties of different vectors
    rows += [(3000, None), (3010, []), (3020, [0.0] * 12), (3030, [None] + [1.0] * 11), (3040, [float("nan")] * 12), (3050, [float("inf")] * 12), (3060, [1.0, 2.0]), (3061, [1.0, 2.5]),
             (3070, [1e-320] * 12), (None, rows[0][1]), (None, rows[1][1]), (0, rows[0][1]), (10, rows[3][1]), (-20, rows[7][1]), (3080, [3e-9] * 12), (3090, [1e150] * 12)]
    want = brute(rows, lambda d: d % 10 == 0, 10)
    assert search(spark, rows) == want
    assert search(spark, rows, query_bytes=12 * 9 * 20, candidates=37) == want     # many tiles, the same result
    assert search(spark, rows, k=3, candidates=50) == brute(rows, lambda d: d % 10 == 0, 3)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (10, [1.0])]
    assert search(spark, rows) == brute(rows, lambda d: d % 10 == 0, 10)
    assert search(spark, rows[1:2]) == []
    assert op12.nearest(frame(spark, rows).limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(60, 33)) * 10.0 ** rng.integers(-6, 6, (60, 1)), rng.normal(size=(70, 33))
    low, high = op12._bounds(op12.quantised(x), op12.quantised(y))
    true = ((x[:, None] - y) ** 2).sum(axis=2)
    assert (low <= true).all() and (true <= high).all()
