import hashlib
import math

import numpy as np

from tidemark.llm import op11_centroid_clustering as op11

SCHEMA = "vec_id long, embedding array<double>, label int, row string, x0 int, cluster string"


def brute(rows, k, rounds, dims, scale=256, seed=2):
    kept = [(d, [math.floor(scale * x) for x in v]) for d, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x * scale) < op11.LIMIT for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cents]
            out.append((d.index(min(d)), min(d)))
        return out
    for _ in range(rounds):
        got = assign()
        for c in range(len(cents)):
            mine = [v for (_, v), (at, _) in zip(kept, got, strict=True) if at == c]
            if mine:
                cents[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return sorted(((d, c, far) for (d, _), (c, far) in zip(kept, assign(), strict=True)), key=str), cents


def frame(spark, rows):
    return spark.createDataFrame([(d, v, 1, "r", 3, "c") for d, v in rows], SCHEMA).repartition(5)


def test_rounds_are_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=10) * (1 if i % 3 else 30)).round(3).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.25] * 10) for i in range(300)]                       # many copies of one vector, many ties
    rows += [(3, [1.0] * 10), (3, [-1.0] * 10), (None, [0.5] * 10), (None, [0.5] * 10), (5, rows[5][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 9), (2003, [None] + [1.0] * 9), (2004, [float("nan")] * 10), (2005, [float("inf")] + [0.0] * 9), (2006, [1e300] * 10), (2007, [4e5] * 10)]
    for k, width in ((7, 4), (1, 10), (40, 16)):
        want, cents = brute(rows, k, 3, 10)
        found, got = op11.lloyd(frame(spark, rows), k=k, rounds=3, dims=10, width=width)
        assert got.tolist() == cents
        assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, [0.0, -0.001])]
    want, cents = brute(rows, 40, 5, 2)
    found, got = op11.lloyd(frame(spark, rows), dims=2)
    assert got.tolist() == cents and sorted((tuple(r) for r in found.collect()), key=str) == want
    found, got = op11.lloyd(frame(spark, rows).limit(0), dims=2)
    assert found.count() == 0 and len(got) == 0
    assert found.columns == ["vec_id", "cluster", "distance"]


def test_squares_are_exact_beyond_doubles():
    x = np.array([[op11.LIMIT - 1, -op11.LIMIT + 1, 12345]])
    c = np.array([[-op11.LIMIT + 1, op11.LIMIT - 2, -7], [5, 6, 7]])
    assert op11._exact_squares(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x[0], r, strict=True)) for r in c]]
