import hashlib
import random
from collections import defaultdict

import pytest

from tidemark.llm import op3_suffix_dedup as op3
from tidemark.llm import op5_substring_dedup as op5

WORD_BREAKS = {0x20, *range(9, 14)}


def words(text):
    out, cur = [], []
    for ch in text:
        if ord(ch) in WORD_BREAKS:
            out.append("".join(cur))
            cur = []
        else:
            cur.append(ch)
    return [w for w in [*out, "".join(cur)] if w]


def brute3(rows, n):
    first = {}
    for d, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        b = (t or "").encode()
        for i in range(len(b) - n + 1):
            first.setdefault(b[i:i + n], (d, i))
    out = {}
    for d, t in rows:
        b = (t or "").encode()
        cov = [False] * len(b)
        for i in range(len(b) - n + 1):
            if first[b[i:i + n]] != (d, i):
                cov[i:i + n] = [True] * n
        spans = sum(1 for i in range(len(b)) if cov[i] and (i == 0 or not cov[i - 1]))
        out[d] = (len(b), sum(cov), spans, hashlib.sha256(bytes(x for x, c in zip(b, cov) if not c)).hexdigest())
    return out


def brute5(rows, n):
    seen = defaultdict(set)
    for d, t in rows:
        w = words(t or "")
        for i in range(len(w) - n + 1):
            seen[tuple(w[i:i + n])].add((d, i))
    out = {}
    for d, t in rows:
        w = words(t or "")
        cov = [False] * len(w)
        for i in range(len(w) - n + 1):
            if len(seen[tuple(w[i:i + n])]) > 1:
                cov[i:i + n] = [True] * n
        out[d] = (len(w), sum(cov), hashlib.sha256(" ".join(x for x, c in zip(w, cov) if not c).encode()).hexdigest())
    return out


def corpus(seed, vocabulary, n_docs=60):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 60))) for _ in range(6)]
    rows = [(None, passages[0]), (7_000_000_000, None), (-5, ""), (-6, " \t\n"), (-7, "é" * 300), (-8, "ab" * 200), (-9, "ab" * 150 + "!"), (-10, "x " * 400)]
    for d in range(n_docs):
        kind = rng.random()
        if kind < 0.2 and d:
            rows.append((d, rows[-1][1]))
            continue
        parts = []
        for _ in range(rng.randint(0, 6)):
            parts.append(rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))))
        rows.append((d, rng.choice([" ", "\n", "  "]).join(parts)))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", None, 3) for d, t in rows], "doc_id long, text string, id string, spans string, p int").repartition(5)


@pytest.mark.parametrize("seed,n,q,vocabulary", [(1, 20, 6, "a b".split()), (2, 40, 8, [f"w{i}" for i in range(300)]), (3, 100, 24, [f"wörd{i}" for i in range(40)])])
def test_suffix_dedup_is_brute_force(spark, seed, n, q, vocabulary):
    rows = corpus(seed, vocabulary)
    got = op3.later_copies(frame(spark, rows), n, q).mapInArrow(lambda b: op3._cut(b, True), op3._DIGEST).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute3(rows, n) and len(got) == len(rows)


@pytest.mark.parametrize("seed,n,q,vocabulary", [(1, 6, 3, "a b".split()), (2, 12, 4, [f"w{i}" for i in range(30)]), (3, 35, 10, [f"wörd{i}" for i in range(400)])])
def test_substring_dedup_is_brute_force(spark, seed, n, q, vocabulary):
    rows = corpus(seed, vocabulary)
    got = op5.repeated_spans(frame(spark, rows), n, q).mapInArrow(lambda b: op5._cut(b, True), op5._DIGEST).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute5(rows, n) and len(got) == len(rows)


def test_empty_tables_and_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert op3.suffix_dedup(none).count() == 0 and op5.substring_dedup(none).count() == 0
    text = " ".join(f"word{i}" for i in range(50))
    twice = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [(len(r.spans), bytes(r.kept).decode()) for r in op3.suffix_dedup(twice).collect()] == [(0, text)] * 2
    assert [(len(r.spans), r.kept) for r in op5.substring_dedup(twice).collect()] == [(0, text)] * 2
    copies = spark.createDataFrame([(1, text), (2, text + " tail")], "doc_id long, text string")
    assert {r.doc_id: (len(r.spans), r.kept) for r in op5.substring_dedup(copies).collect()} == {1: (1, ""), 2: (1, "tail")}
    assert {r.doc_id: bytes(r.kept) for r in op3.suffix_dedup(copies).collect()} == {1: text.encode(), 2: b" tail"}


def brute_paths(edges):
    """Each edge's maximal nonbranching path: (the edges in order, whether it is a cycle)."""
    leaves, enters = defaultdict(list), defaultdict(list)
    for e, (t, h) in edges.items():
        leaves[t].append(e)
        enters[h].append(e)
    after = {enters[v][0]: leaves[v][0] for v in edges_nodes(edges) if len(enters[v]) == len(leaves[v]) == 1}
    before = {b: a for a, b in after.items()}
    out = {}
    for e in edges:
        start, cycle = e, False
        while start in before:
            start = before[start]
            if start == e:
                cycle = True
                break
        path = [start]
        while path[-1] in after and after[path[-1]] != start:
            path.append(after[path[-1]])
        out[e] = (path, cycle)
    return out


def edges_nodes(edges):
    return {v for pair in edges.values() for v in pair}


def test_unitigs_are_the_nonbranching_paths(spark):
    rng = random.Random(11)
    edges, node, edge = {}, 0, 100
    for size in (1, 2, 3, 17, 40):                                            # cycles
        for i in range(size):
            edges[edge] = (node + i, node + (i + 1) % size)
            edge += 1
        node += size
    for size in (1, 5, 33, 64):                                               # paths
        for i in range(size):
            edges[edge] = (node + i, node + i + 1)
            edge += 1
        node += size + 1
    for _ in range(60):                                                       # branches
        edges[edge] = (node + rng.randrange(50), node + rng.randrange(50))
        edge += 1
    names = list(edges)
    rng.shuffle(names)                                                        # only some neighbours follow each other in a text
    rows = [(e, *edges[e], 1 + i // 7, i % 7) for i, e in enumerate(sorted(names[:100]) + names[100:])]
    df = spark.createDataFrame(rows, "edge long, tail long, head long, id long, p int").repartition(4)
    got = {r.edge: (r.unitig, r.at) for r in op5.compact(df, "test").collect()}
    assert set(got) == set(edges)
    for e, (path, cycle) in brute_paths(edges).items():
        assert len({got[x][0] for x in path}) == 1, path
        at = [got[x][1] for x in path]
        if cycle:                                                             # cut somewhere
            k = at.index(0)
            at = at[k:] + at[:k]
        assert at == list(range(len(path)))
    assert len({u for u, _ in got.values()}) == len({tuple(sorted(p)) for p, _ in brute_paths(edges).values()})


def test_pieces_with_other_words_are_not_cut(spark):
    import pyarrow as pa
    text = " ".join(f"w{i}" for i in range(20))
    spans = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("doc", pa.int64()), ("spans", spans)])
    piece = pa.list_(pa.struct([("p", pa.int32()), ("k", pa.int64()), ("proof", pa.int64())]))

    def cut(proof):
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text]), pa.array([1]), pa.array([[{"p": 3, "k": 2, "proof": proof}]], piece)],
                                           names=["id", "text", "doc", "pieces"])
        return next(op5.verified(iter([batch]), 5, schema)).column("spans").to_pylist()[0]
    data = op5.np.frombuffer(text.encode(), op5.np.uint8)
    every = op5.second_fingerprint(data, op5.np.array([0, len(data)]))[0].every(5)
    right = int((every[3] ^ every[4]).view(op5.np.int64))
    assert cut(right) == [{"s": 3, "e": 9}] and cut(right ^ 1) == []
