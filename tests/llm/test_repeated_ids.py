"""Null and repeated ids with different texts: each text is a document of its own."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import op3_suffix_dedup as op3
from tidemark.llm import op5_substring_dedup as op5
from tidemark.llm import op9_quality as op9

from test_op3_op5 import brute3, brute5, frame


def mixed():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(200)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [some(40) for _ in range(3)]
    rows = [(None, passages[0] + " tail"), (None, passages[0] + " other end")]
    for i in range(40):
        parts = [some(rng.randint(0, 80)) if rng.random() < 0.5 else rng.choice(passages) for _ in range(rng.randint(1, 4))]
        rows.append((rng.choice([None, 1, 2, 3]), " ".join(parts)))
    return [*rows, rows[0], rows[5]]


def test_spans_are_brute_force(spark):
    rows = mixed()
    place = {r.t: r.k for r in spark.createDataFrame([(t,) for t in {t for _, t in rows}], "t string").select("t", F.xxhash64("t").alias("k")).collect()}
    names = {x: i for i, x in enumerate(sorted(set(rows), key=lambda r: (-1 if r[0] is None else r[0], place[r[1]])))}
    alone = [(i, t) for (_, t), i in names.items()]
    for op, run, brute in ((op3, op3.later_copies, brute3), (op5, op5.repeated_spans, brute5)):
        n, q = (60, 20) if op is op3 else (12, 4)
        want = brute(alone, n)
        got = run(frame(spark, rows), n, q).mapInArrow(lambda b, op=op: op._cut(b, True), op._DIGEST).collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(((r[0], *want[names[r]]) for r in rows), key=str)


def test_one_text_of_an_id_takes_no_other_along(spark):
    text = " ".join(f"word{i}" for i in range(50))
    rows = [(None, text), (None, text + " tail"), (None, "something wholly different from the rest of it"), (5, text), (5, "five of another kind in every way"), (5, None)]
    left = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    got = [tuple(r) for r in left.select("doc_id", "text").collect()]
    assert set(rows[4:]) | {rows[2]} <= set(got) and len(got) == 4 and len([r for r in got if r in rows[:2]]) == 1
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    more = docs.unionByName(docs.filter("doc_id % 3 = 0").select(F.lit(None).cast("long").alias("doc_id"), "text"))
    scored = op9.resample(more, labels)
    left = op9.keep_good(more, labels).filter("doc_id IS NULL").count()
    assert left == scored.filter(f"id = {-(2**63)} AND kept AND NOT toxic").count() > 100


def test_columns_of_any_name_stay(spark):
    """Names that look like an operator's own, with rows of every kind."""
    from tidemark.llm.op4_decontamination import decontaminate
    from tidemark.llm.op6_pii import sanitize
    from tidemark.llm.op9_quality import keep_good
    names = ["_bad", "_th", "_told", "_id", "_clean", "_gone", "id", "th", "kept", "toxic", "words", "n_words"]
    rows = [(1, "write to a@b.org now", *names), (None, None, *names), (2, "", *names), (2, "", *names), (3, "one two three", *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1)], "doc_id long, quality int, toxic int")
    for out, n in ((decontaminate(docs, items), 4), (sanitize(docs), 5), (keep_good(docs, labels), 4)):
        assert out.columns == docs.columns and out.count() == n
        assert out.select(*names).distinct().count() == 1
    assert {r.text for r in sanitize(docs).filter("doc_id = 1").collect()} == {"write to [EMAIL] now"}
