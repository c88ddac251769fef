import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from tidemark.llm import op4_decontamination as op4

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - 12)) if w else ():
            wins.setdefault(tuple(w[s:s + 13]), set()).add(str(i) if i is not None else "")
    out = []
    for d, t in docs:
        w, hit, named = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in wins:
                    hit |= set(range(s, s + n))
                    named |= wins[tuple(w[s:s + n])]
        out.append((d, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def test_hits_are_brute_force(spark):
    rng = random.Random(5)
    word = lambda n=30: f"w{rng.randint(0, n)}"
    items = [(i, " ".join(word(400) for _ in range(rng.choice([13, 14, 30, 60])))) for i in range(12)]
    items += [(20, "The Quick-brown fox"), (21, "x"), (22, None), (23, ""), (None, "alpha beta gamma delta"), (24, "a a a a a a a a a a a a a a a"), (25, items[0][1])]
    docs = [(None, items[0][1]), (-1, None), (-2, ""), (-3, "?!"), (-4, "the quick BROWN\nFOX ran"), (-5, "a " * 60), (-6, "é X ü"), (-7, "ÉX x"), (-8, "alpha beta gamma delta"), (-9, "alpha beta gamma")]
    for d in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            w = rng.choice(items)[1] or ""
            w = w.split(" ")
            a = rng.randint(0, max(0, len(w) - 13))
            parts += w[a:a + rng.choice([12, 13, 20])] if rng.random() < 0.5 else [word(400) for _ in range(rng.randint(1, 80))]
        docs.append((d, " ".join(parts)))
    docs += docs[5:8]
    left = spark.createDataFrame([(d, t, 1, "q") for d, t in docs], "doc_id long, text string, n int, item string").repartition(5)
    right = spark.createDataFrame([(d, t, 1) for d, t in items], "item_id long, text string, length int")
    out = op4.contamination(left, right)
    got = out.select("doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.concat_ws(",", "items"), 256), "contaminated")
    want = brute(docs, items)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    bad = {r[0] for r in want if r[-1]}
    kept = op4.decontaminate(left, right)
    assert kept.columns == left.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)
    assert op4.contamination(left.limit(0), right).count() == 0
    assert op4.contamination(left, right.limit(0)).filter("n_hit > 0").count() == 0


def test_a_very_long_text_with_a_frequent_short_item(spark):
    n = 200_000
    docs = spark.createDataFrame([(1, "w x " * (n // 2)), (2, " ".join(f"v{i}" for i in range(n))), (3, "y")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "x"), (2, "x w x"), (3, " ".join(f"v{i}" for i in range(500, 520)))], "item_id long, text string")
    begin = time.perf_counter()
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in op4.contamination(docs, items).collect()}
    assert got == {1: (n, n - 1, ["1", "2"], True), 2: (n, 20, ["3"], False), 3: (1, 0, [], False)}
    assert time.perf_counter() - begin < 120
