import random
from collections import defaultdict

import pytest

from tidemark.llm import op2_minhash_dedup as op2
from tidemark.llm.common import components

BREAKS = dict.fromkeys([0x20, *range(9, 14)], " ")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in low.translate(BREAKS).split(" ") if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    key = lambda x: -1e30 if x is None else x
    ids = sorted(sets, key=key)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)), key=key)
                up[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda: f"W{rng.randint(0, 500)}"
    shared = [word() for _ in range(40)]
    rows = [(None, "a b"), (-3, "A\tB"), (-4, None), (-5, ""), (-6, " \n"), (-7, "one two three four five"), (-8, "One two three four FIVE ")]
    base = [word() for _ in range(120)]
    for d in range(150):                                  # a chain of edits: links between neighbours, not between ends
        base[rng.randrange(120)] = word()
        rows.append((d, " ".join(base)))
    for d in range(150, 230):
        rows.append((d, " ".join(shared + [word() for _ in range(rng.randint(5, 60))])))
    for d in range(230, 300):                             # all near one base
        w = list(shared)
        w[rng.randrange(40)] = word()
        rows.append((d, " ".join(w)))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, n int, id int, a string").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in op2.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_empty_table_and_repeated_rows(spark):
    docs = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e f")], "doc_id long, text string")
    assert op2.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(tuple(r) for r in op2.near_duplicates(docs).collect()) == [(4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False)]


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 5), (5, 9)], "a long, b long")
    got = defaultdict(set)
    for r in components(links, "t").collect():
        got[r.component].add(r.id)
    assert got == {100: set(range(100, 161)), 5: {5, 7, 9}}
