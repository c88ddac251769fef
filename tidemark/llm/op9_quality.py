"""Quality classifier by importance resampling: hashed n-gram models of good and of all text, Gumbel top-k.

Two decisions come from the same weights: ``sampled``, an importance sample in which chance has the part the weights leave it, and
``kept``, a filter with a cut set on held-out labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Most labelled rows that are used, those with the least hash of their id.
LABELLED = 50_000
#: Buckets of the hashed n-grams: words and pairs of words; shapes of up to three tokens.
WORD_BUCKETS, SHAPE_BUCKETS = 1 << 16, 1 << 14
BUCKETS = 2 * WORD_BUCKETS + SHAPE_BUCKETS
SEED = 17
#: Buckets of words and pairs of words for toxicity, so many that a long clean text hardly meets a toxic one's; a bucket's share of toxic
#: labelled documents starts from so many documents of the usual share.
TOXIC_BUCKETS, TOXIC_PRIOR = 1 << 21, 5.0

# what a byte is: 0 blank, 1 small letter or non-ASCII, 2 capital, 3 digit, 4 other
_KIND = np.full(256, 4, dtype=np.uint8)
_KIND[C.BLANK] = 0
_KIND[97:123] = 1
_KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_RUN = np.array([0, 1, 1, 2, 3], dtype=np.uint8)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(kind of each byte, run of each byte, starts, ends, text, hash) of tokens: runs of letters, of digits and of other signs."""
    kind = _KIND[data]
    run = _RUN[kind]
    cut = np.ones(len(data) + 1, dtype=bool)
    cut[1:-1] = run[1:] != run[:-1]
    cut[offsets] = True
    edge = np.flatnonzero(cut)
    s, e = edge[:-1], edge[1:]
    full = run[s] > 0
    s, e = s[full], e[full]
    text = np.searchsorted(offsets, s, side="right") - 1
    return kind, run, s, e, text, C.Running(C.byte_symbols(C.LOWER[data]), "byte").of(s, e)


def pairs(word: np.ndarray) -> np.ndarray:
    return C.mix(word[:-1] * np.uint64(3) + word[1:])


def features(data: np.ndarray, offsets: np.ndarray, found: tuple[np.ndarray, ...] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every hashed n-gram of the tokens."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind, run, s, e, text, word = found or tokens(data, offsets)
    caps = np.concatenate([[0], np.cumsum(kind == 2)])
    n_caps, size = caps[e] - caps[s], e - s
    shape = np.where(n_caps == 0, 1, np.where(n_caps == size, 3, np.where((n_caps == 1) & (kind[s] == 2), 2, 4)))
    shape = np.where(run[s] == 2, 5, np.where(run[s] == 3, 16 + 2 * data[s].astype(np.int64) + (size > 1), shape))
    joined = np.zeros(len(s), dtype=np.int64)
    joined[1:] = s[1:] == e[:-1]
    sym = C.mix((shape * 2 + joined).astype(np.uint64) + np.uint64(77))
    texts, buckets = [text], [(word % np.uint64(WORD_BUCKETS)).astype(np.int64)]
    pair = text[1:] == text[:-1]
    two = pairs(word)
    texts.append(text[1:][pair])
    buckets.append(WORD_BUCKETS + (two[pair] % np.uint64(WORD_BUCKETS)).astype(np.int64))
    gram, same = sym, np.ones(len(sym), dtype=bool)
    for n in range(3):
        if n:
            gram = C.mix(gram[:-1] * np.uint64(5) + sym[n:])
            same = text[n:] == text[:-n]
        texts.append(text[n:][same])
        buckets.append(2 * WORD_BUCKETS + (gram[same] % np.uint64(SHAPE_BUCKETS)).astype(np.int64))
    return np.concatenate(texts), np.concatenate(buckets)


def toxic_buckets(text: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word and pair of words."""
    pair = text[1:] == text[:-1]
    at = np.concatenate([word, C.mix(pairs(word)[pair] + np.uint64(1))]) % np.uint64(TOXIC_BUCKETS)
    return np.concatenate([text, text[1:][pair]]), at.astype(np.int64)


def _count_toxic(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket and task: how many toxic and how many other documents hold it."""
    total = np.zeros((2, TOXIC_BUCKETS), dtype=np.int32)
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        for row, _, data, offsets in C.slices(batch):
            if not len(data):
                continue
            *_, text, word = tokens(data, offsets)
            text, bucket = toxic_buckets(text, word)
            text, bucket = np.divmod(np.unique(text * TOXIC_BUCKETS + bucket), TOXIC_BUCKETS)
            bad = toxic[row + text]
            total[0] += np.bincount(bucket[bad], minlength=TOXIC_BUCKETS).astype(np.int32)
            total[1] += np.bincount(bucket[~bad], minlength=TOXIC_BUCKETS).astype(np.int32)
    there = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[0, there].astype(np.int64)), pa.array(total[1, there].astype(np.int64))], names=["bucket", "toxic", "clean"])


def fit_toxic(docs: DataFrame, sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, log ratio) of the buckets that are more frequent in toxic labelled documents than in all labelled ones.

    ``sample`` has id and toxic, each id once. What reaches the driver is one row per bucket of a toxic document of the bounded labels.
    """
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not n.get(True) or not n.get(False):
        return np.zeros(0, np.int64), np.zeros(0)
    counted = docs.join(F.broadcast(sample), "id").select("text", "toxic").mapInArrow(_count_toxic, "bucket long, toxic long, clean long")
    got = counted.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter("toxic > 0").toArrow()
    share = n[True] / (n[True] + n[False])
    toxic, clean = got["toxic"].to_numpy(), got["clean"].to_numpy()
    ratio = np.log((toxic + TOXIC_PRIOR * share) / (toxic + clean + TOXIC_PRIOR) / share)
    return got["bucket"].to_numpy()[ratio > 0], ratio[ratio > 0]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per bucket and task: how often it occurs in all texts and in the good ones."""
    total = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
        for row, _, data, offsets in C.slices(batch):
            text, bucket = features(data, offsets)
            total[0] += np.bincount(bucket, minlength=BUCKETS)
            total[1] += np.bincount(bucket[good[row + text]], minlength=BUCKETS)
    there = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[0, there]), pa.array(total[1, there])], names=["bucket", "raw", "target"])


def _scores(batches: Iterator[pa.RecordBatch], ratio: np.ndarray, buckets: np.ndarray, told: np.ndarray) -> Iterator[pa.RecordBatch]:
    toxic = np.zeros(TOXIC_BUCKETS)
    toxic[buckets] = told
    for batch in batches:
        weight, worst, grams = np.zeros(batch.num_rows), np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
        for row, end, data, offsets in C.slices(batch):
            if not len(data):
                continue
            found = tokens(data, offsets)
            text, bucket = features(data, offsets, found)
            grams[row:end] = np.bincount(text, minlength=end - row)
            weight[row:end] = np.bincount(text, weights=ratio[bucket], minlength=end - row)
            text, bucket = toxic_buckets(*found[4:])
            value = toxic[bucket]
            hit = value > 0
            np.maximum.at(worst, row + text[hit], value[hit])
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(weight), pa.array(weight / np.maximum(grams, 1)), pa.array(worst)],
                                         names=["id", "th", "log_weight", "mean_ratio", "toxicity"])


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[np.ndarray, DataFrame]:
    """(log ratio per bucket, labels): the target model is counted over half of the good labelled documents, the raw one over all.

    ``docs`` has id and text, ``labels`` id, good and toxic; toxic documents are no target. Counts are summed in Spark; what reaches the driver
    is one row per bucket. The labels come back with ``half``, which says that they served the models.
    """
    sample = C.stored(labels.orderBy(F.xxhash64("id"), "id").limit(labelled), "op9-labels")       # bounded, so it may be broadcast
    sample = sample.withColumn("half", F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(2)) == 0)
    good = sample.filter("half AND good AND NOT coalesce(toxic, false)").select("id", F.lit(True).alias("good")).dropDuplicates(["id"])
    seen = docs.join(F.broadcast(good), "id", "left").select("id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    counted = seen.mapInArrow(_count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counted.collect():
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    ratio = np.zeros(BUCKETS)
    for a, b in ((0, WORD_BUCKETS), (WORD_BUCKETS, 2 * WORD_BUCKETS), (2 * WORD_BUCKETS, BUCKETS)):
        # smoothed towards the raw model, so an unseen bucket of a small target sample says little
        p = raw[a:b] / max(raw[a:b].sum(), 1)
        q = (target[a:b] + 2000 * p) / (target[a:b].sum() + 2000)
        ratio[a:b] = np.where(p > 0, np.log(np.where(p > 0, q, 1)) - np.log(np.where(p > 0, p, 1)), 0)
    return ratio, sample


def _best_cut(weight: np.ndarray, good: np.ndarray) -> float:
    """The cut with the best sum of the shares of good ones kept and bad ones dropped; the middle of the widest gap among equals."""
    if not len(weight) or good.all() or not good.any():
        return -np.inf
    order = np.argsort(weight)
    w, g = weight[order], good[order]
    dropped_bad = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    dropped_good = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    gain = dropped_bad - dropped_good
    edge = np.concatenate([[w[0] - 1], w, [w[-1] + 1]])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    k = best[np.argmax(edge[best + 1] - edge[best])]
    return float((edge[k] + edge[k + 1]) / 2)


def _kth(keys: DataFrame, k: int) -> int:
    """The k-th largest value of ``q``, by counting 16 bits at a time; at most 65,536 counts reach the driver."""
    prefix, left = 0, k
    for shift in (48, 32, 16, 0):
        part = F.shiftrightunsigned("q", shift)
        rows = keys.filter(F.shiftrightunsigned("q", shift + 16) == prefix) if shift < 48 else keys
        for r in sorted(rows.groupBy(part.alias("p")).count().collect(), key=lambda r: -r["p"]):
            if left <= r["count"]:
                prefix = r["p"]
                break
            left -= r["count"]
    return prefix


def _key(weight: Column, seed: Column | int = SEED + 1, tie: Column | None = None) -> Column:
    """Weight plus Gumbel noise from the id's hash, as a whole number of 2**-32 above -2**20; ``tie`` tells rows of one id apart."""
    at = F.lit(seed) if isinstance(seed, int) else seed
    u = (F.shiftrightunsigned(F.xxhash64("id", at) if tie is None else F.xxhash64("id", tie, at), 11) + 0.5) / F.lit(2.0**53)
    return F.floor((F.greatest(F.least(weight - F.log(-F.log(u)), F.lit(2.0**20)), F.lit(-(2.0**20))) + 2.0**20) * 2.0**32).cast("long")


def gumbel_top_k(scored: DataFrame, k: int, seed: int = SEED + 1) -> DataFrame:
    """``scored`` (id, th, log_weight, ...) with ``q`` and ``sampled``: k rows drawn without replacement, each next one with a chance in proportion to
    exp(log_weight) among those left. Wholly repeated rows draw the same number and are drawn together, and rows that tie with the last one are drawn too."""
    scored = scored.withColumn("q", _key(F.col("log_weight"), seed, F.col("th")))
    if k <= 0:
        return scored.withColumn("sampled", F.lit(False))
    return scored.withColumn("sampled", F.col("q") >= (_kth(scored, k) if k < scored.count() else 0))


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: int = LABELLED, k: int | None = None, rate: float | None = None,
             seed: int = SEED + 1) -> DataFrame:
    """(id, th, log_weight, mean_ratio, toxicity, toxic, kept, q, sampled) for every row of ``docs``; ``th`` is the text's hash.

    ``labels`` has the id column, ``quality``, 1 for good, and, if known, ``toxic``, 1 for toxic. A document's log weight is the sum of the log ratios of its
    n-grams under the two models, its importance; ``sampled`` are the ``k`` documents (or ``rate`` of all) with the largest log weight plus Gumbel noise, which is an
    importance sample without replacement. ``mean_ratio`` is the weight per n-gram, and ``kept`` that it reaches the cut that separates the held-out labels
    best: a filter, in which chance has no part. Without ``k`` and ``rate`` the sample is as large as what is kept.

    ``toxicity`` is the largest log ratio, toxic against all labelled documents, of a text's words and pairs of words, ``toxic`` that it reaches
    the cut that separates the held-out labels best; without both kinds of labels in either half nothing is toxic.

    Null texts and texts without tokens weigh 0; null ids count as the smallest id; null labels and those of null ids are not used; repeated rows are
    weighed alike; without usable labels everything stays. Other columns are not read.
    """
    rows = C.keyed(docs, id_col, text_col)
    toxic = F.col("toxic") == 1 if "toxic" in labels.columns else F.lit(None).cast("boolean")
    marks = labels.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), (F.col("quality") == 1).alias("good"), toxic.alias("toxic"))
    ratio, sample = fit(rows, marks.filter("good IS NOT NULL OR toxic IS NOT NULL"), labelled)
    buckets, told = fit_toxic(rows, sample.filter("half AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic")))
    scored = C.stored(rows.withColumn("th", F.xxhash64("text")).mapInArrow(lambda b: _scores(b, ratio, buckets, told), "id long, th long, log_weight double, mean_ratio double, toxicity double"), "op9-scores")
    held = sample.filter("NOT half").select("id", "good", F.col("toxic").alias("is_toxic"))
    # one row per label of the bounded sample: several texts of an id count with their mean
    seen = scored.join(F.broadcast(held.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.avg("mean_ratio").alias("mean_ratio"), F.avg("toxicity").alias("toxicity"))
    marked = C.stored(held.join(seen, "id").select("mean_ratio", "good", "toxicity", "is_toxic"), "op9-held").toArrow()
    pairs = marked.filter(pc.is_valid(marked["is_toxic"]))
    worst, is_toxic = pairs["toxicity"].to_numpy(), pairs["is_toxic"].to_numpy().astype(bool)
    least = _best_cut(worst, is_toxic) if len(buckets) and is_toxic.any() and not is_toxic.all() else np.inf
    pairs = marked.filter(pc.is_valid(marked["good"]))
    cut = _best_cut(pairs["mean_ratio"].to_numpy(), pairs["good"].to_numpy().astype(bool))
    scored = scored.withColumn("toxic", (F.col("toxicity") >= F.lit(float(least))) & (F.col("toxicity") > 0)).withColumn("kept", F.col("mean_ratio") >= F.lit(float(cut)))
    if k is None:
        k = round(rate * scored.count()) if rate is not None else scored.filter("kept").count()
    return gumbel_top_k(scored, k, seed)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the filter keeps and that are toxic neither by their label nor by their words, as they came.

    Of several texts of one id each stays or goes by itself; a label is one of all texts of its id, and a null id's says nothing of a row.
    """
    i, th, told_id, own = C.fresh("id", "th", "told", "own")
    # verdicts meet on ids and hashes first, so that whole rows are joined, and their texts shuffled, only once
    bad = resample(docs, labels, id_col, text_col, **options).select(F.col("id").alias(i), F.col("th").alias(th), (~F.col("kept") | F.col("toxic")).alias(own))
    if "toxic" in labels.columns:
        told = labels.filter("toxic = 1").select(F.col(id_col).cast("long").alias(told_id)).distinct()
        bad = bad.join(told, F.col(i) == F.col(told_id), "left").filter(F.col(own) | F.col(told_id).isNotNull()).drop(told_id)
    else:
        bad = bad.filter(F.col(own))
    gone = C.same_text(docs, id_col, text_col, i, th) & (F.col(own) | docs[id_col].cast("long").isNotNull())
    return docs.join(C.stored(bad.distinct(), "op9-bad"), gone, "left_anti")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))
    return out.select(C.unkeyed().alias("doc_id"), "log_weight", "mean_ratio", "kept", "sampled", "toxicity", "toxic")
