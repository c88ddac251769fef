import hashlib
import itertools
import math
import time

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import op7_chat_format as op7
from tidemark.llm import op9_quality as op9


def test_chats_read_back_as_they_were(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "### user: \\0\\1\\2 </turn>\n\\"), (1, 2, "assistant", "again"), (1, 2, "assistant", "again"), (1, 3, "a: b#<\\", ": x"),
            (2, None, None, None), (2, 5, "assistant", None), (None, 0, "assistant", "\U0001f600 ok"), (3, 0, "assistant", "\\### Assistant: </turn> ok")]
    frame = spark.createDataFrame([(*r, "extra", 1) for r in rows], "conv_id long, turn long, role string, text string, turns string, head int").repartition(3)
    out = op7.format_chats(frame).select("*", op7.read_turns(F.col("formatted")).alias("turns"), op7.read_loss(F.col("formatted"), F.col("mask")).alias("loss")).collect()
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss) for r in out}
    want = {}
    for c in (1, 2, 3, None):
        own = sorted(((-1 if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c))
        want[c] = ([(r, x) for _, r, x in own], "".join(x for _, r, x in own if r == "assistant"))
    assert got == want
    for r in out:
        assert sum(m.length for m in r["mask"]) == len(r.formatted)
    assert next(r.formatted for r in out if r.conv_id == 1).count("### ") == 3
    assert op7.format_chats(frame.limit(0)).count() == 0


def test_a_long_conversation_takes_time_in_proportion(spark):
    took = []
    for n in (5_000, 50_000):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"),
                                     F.concat(F.lit("# </turn> "), F.col("id").cast("string")).alias("text"))
        begin = time.perf_counter()
        out = op7.format_chats(rows).select(op7.read_turns(F.col("formatted")).alias("turns"), op7.read_loss(F.col("formatted"), F.col("mask")).alias("loss")).first()
        took.append(time.perf_counter() - begin)
        assert [(t.role, t.text) for t in out.turns] == [("user" if i % 3 == 0 else "assistant", f"# </turn> {i}") for i in range(n)]
        assert out.loss == "".join(f"# </turn> {i}" for i in range(n) if i % 3)
    assert took[1] < 20 * took[0], took


def test_query_against_rows(spark):
    out = {r.conv_id: r for r in op7.op7_chat_format(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    for c in {r.conv_id for r in rows}:
        own = sorted((r for r in rows if r.conv_id == c), key=lambda r: r.turn)
        assert out[c].n_turns == len(own)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r.role}\n{r.text or ''}\n" for r in own).encode()).hexdigest()
        said = "".join(r.text or "" for r in own if r.role == "assistant")
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert out[-7].n_turns == 2 and len(out) == len({r.conv_id for r in rows}) + 1


def test_classifier_on_held_out_labels(spark):
    out = op9.op9_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    r = out.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    share = {x.quality: x.kept for x in r}
    assert share[1] > 0.97 and share[0] < 0.05
    assert out.count() == 1000


def test_toxic_documents_go_and_clean_ones_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    left = op9.keep_good(docs, labels).select("doc_id", F.lit(1).alias("left"))
    r = labels.filter("quality = 1").join(left, "doc_id", "left").groupBy("toxic").agg(F.avg(F.coalesce("left", F.lit(0))).alias("kept")).collect()
    share = {x.toxic: x.kept for x in r}
    assert share[1] == 0 and share[0] > 0.95
    some = labels.filter("doc_id % 2 = 0")                    # documents whose labels it never saw
    left = op9.keep_good(docs, some).select("doc_id", F.lit(1).alias("left"))
    r = labels.filter("quality = 1 AND doc_id % 2 = 1").join(left, "doc_id", "left").groupBy("toxic").agg(F.avg(F.coalesce("left", F.lit(0))).alias("kept")).collect()
    share = {x.toxic: x.kept for x in r}
    assert share[1] < 0.5 and share[0] > 0.9                  # other toxic labels lie on texts without such words
    insults = docs.filter("doc_id % 2 = 1 AND lower(text) RLIKE '\\\\b(idiot|moron|scum|trash)\\\\b'")
    assert insults.count() >= 20 and insults.join(left, "doc_id", "left_semi").count() <= 0.05 * insults.count()


def test_whole_rows_are_joined_once_for_both_verdicts(spark):
    least = -(2**63)
    rows = [(1, "plain words"), (1, "other words of the same id"), (2, "plain words"), (None, "plain words"), (None, None), (least, "plain words"), (least, "more"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 1), (None, 1, 1), (least, 1, 1), (9, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = op9.keep_good(docs, labels)
        assert left._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1
        # a toxic label takes every text of its id; those of null ids, and of the id that stands for null, take no row of a null id
        assert sorted((tuple(r) for r in left.collect()), key=repr) == sorted([rows[2], rows[3], rows[4], rows[7], rows[8]], key=repr)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_edges_of_the_sample(spark):
    docs = spark.createDataFrame([(None, None, "z"), (1, "", "z"), (2, "plain words here", "z"), (2, "plain words here", "z"), (3, "x" * 200_000, "z")], "doc_id long, text string, good string")
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    assert op9.resample(docs, labels).filter("kept").count() == 5
    assert op9.keep_good(docs, labels).columns == docs.columns
    assert op9.resample(docs.limit(0), labels).count() == 0 and op9.resample(docs, labels.limit(0)).filter("kept").count() == 5
    kept = op9.resample(docs.filter("doc_id <> 2"), labels, k=1)
    assert kept.filter("sampled").count() == 1 and kept.orderBy(F.desc("q")).first().sampled
    assert op9.resample(docs.filter("doc_id <> 2"), labels, rate=0.5).filter("sampled").count() == 1


def test_shares_of_the_sample_are_the_exact_law(spark):
    """Over many seeds every item is drawn as often as successive draws in proportion to the weights say."""
    weights, k, seeds = [2.0, 1.0, 0.5, 0.0, -1.0, -2.5], 3, 20_000
    law = [0.0] * len(weights)
    for order in itertools.permutations(range(len(weights)), k):
        p, left = 1.0, sum(math.exp(w) for w in weights)
        for i in order:
            p *= math.exp(weights[i]) / left
            left -= math.exp(weights[i])
        for i in order:
            law[i] += p
    rows = spark.createDataFrame(list(enumerate(weights)), "id long, log_weight double").crossJoin(spark.range(seeds).select(F.col("id").alias("seed")))
    rows = rows.withColumn("q", op9._key(F.col("log_weight"), F.col("seed"), F.lit(7)))
    got = rows.withColumn("r", F.row_number().over(W.partitionBy("seed").orderBy(F.desc("q")))).groupBy("id").agg(F.avg((F.col("r") <= k).cast("int")).alias("share")).collect()
    for r in got:
        assert abs(r.share - law[r.id]) < 4.5 * math.sqrt(law[r.id] * (1 - law[r.id]) / seeds), (r, law)
    one = op9.gumbel_top_k(spark.createDataFrame([(i, 0, w) for i, w in enumerate(weights)], "id long, th long, log_weight double"), k)
    assert one.filter("sampled").count() == k and op9.gumbel_top_k(one.drop("q", "sampled"), 0).filter("sampled").count() == 0


def test_chance_has_its_part_in_the_sample(spark):
    """Another seed draws other documents of about the same weight; the filter is another decision and does not move."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    a = op9.resample(docs, labels)
    r = a.agg(F.count_if(F.expr("kept <> sampled")).alias("apart"), F.count_if(F.col("sampled")).alias("n"), F.count_if(F.col("kept")).alias("k")).first()
    assert r.apart > 0 and r.n == r.k
    scored, redrawn = a.drop("q", "sampled"), 0
    for k in (50, 200, 400, 600, 750):
        one, two = (op9.gumbel_top_k(scored, k, seed).filter("sampled").select("id") for seed in (1, 2))
        assert one.count() == k
        redrawn += one.exceptAll(two).count()
    assert redrawn > 0


def test_kth_is_exact(spark):
    keys = spark.range(5000).select((F.xxhash64("id").bitwiseAND(F.lit((1 << 47) - 1))).alias("q"))
    want = sorted((r.q for r in keys.collect()), reverse=True)
    for k in (1, 17, 2500, 5000):
        assert op9._kth(keys, k) == want[k - 1]
