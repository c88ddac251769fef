import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import op13_periodic_runs as op13

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text, shortest=24, periods=3):
    w = WORD.findall(text or "")
    n, runs = len(w), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if size >= max(shortest, periods * q) and not any(all(w[x] == w[x + r] for x in range(i, i + size - r)) for r in range(1, q)):
                runs.append((i, size, q))
            i = j
    gone = {x for s, m, q in runs for x in range(s + q, s + m)}
    return n, sorted(runs, key=lambda r: (r[0], r[2])), " ".join(x for i, x in enumerate(w) if i not in gone)


def texts():
    rng = random.Random(4)
    out = [None, "", " \t\n", "a", "a " * 23, "a " * 24, "ab " * 23 + "c", "x y " * 12, "x y " * 11 + "x z", "é è " * 20 + "  é"]
    for _ in range(60):
        words = []
        for _ in range(rng.randint(1, 5)):
            p = rng.randint(1, 14)
            unit = [rng.choice("abc") * rng.randint(1, 2) for _ in range(p)]
            words += (unit * 12)[:rng.randint(1, 5 * p)] if rng.random() < 0.8 else [str(rng.randint(0, 50)) for _ in range(30)]
        out.append(rng.choice([" ", "  ", "\n"]).join(words))
    fib = ["a", "b"]
    while len(fib[-1]) < 500:
        fib.append(fib[-1] + fib[-2])
    return out + [" ".join(fib[-1]), " ".join(rng.choice("ab") for _ in range(700)), " ".join("ab" * 100 + "c" + "ba" * 90)]


def test_runs_are_brute_force(spark):
    docs = [(i if i % 7 else None, t) for i, t in enumerate(texts())]
    docs += docs[5:9]
    rows = spark.createDataFrame([(d, t, 1, "r", 2) for d, t in docs], "doc_id long, text string, runs int, id string, n_words int").repartition(4)
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in op13.periodic_runs(rows).collect()), key=str)
    assert got == sorted(((d, *brute(t)) for d, t in docs), key=str)
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs]) for r in op13.periodic_runs(rows, 6, 4).collect()), key=str)
    assert got == sorted(((d, brute(t, 6, 4)[1]) for d, t in docs), key=str)
    assert op13.periodic_runs(rows.limit(0)).count() == 0
    with pytest.raises(ValueError):
        op13.periodic_runs(rows, periods=2)


def test_planted_text(spark):
    docs = [(i, " ".join(f"w{k}" for k in range(n))) for i, n in enumerate([0, 1, 2, 5, 30, 333] * 40)] + [(None, "a b"), (7, None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").select("doc_id", "text", op13.planted(F.col("doc_id"), F.col("text")).alias("new"))
    changed = 0
    for d, text, new in rows.collect():
        w = WORD.findall(text or "")
        h = zlib.crc32(str(d).encode())
        if d is not None and h % 10 == 0 and w:
            n, g = len(w), h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            changed += 1
            assert new == " ".join(w)
        else:
            assert new == text
    assert changed > 10


def test_long_texts_take_time_in_proportion():
    took = []
    for n in (100_000, 400_000):
        word = np.random.default_rng(1).integers(0, 3, n)
        word[n // 2:] = word[n // 2: n // 2 + 1000][np.arange(n - n // 2) % 1000]
        begin = time.perf_counter()
        runs = op13.runs_of(word, np.zeros(n, np.int64), np.full(n, n))
        took.append(time.perf_counter() - begin)
        best = max(runs.tolist(), key=lambda r: Fraction(r[1], r[2]) if r[2] == 1000 else 0)
        assert best[2] == 1000 and best[0] + best[1] == n
    assert took[1] < 10 * took[0] + 1
