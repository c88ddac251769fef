"""Benchmark decontamination by winnowing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Words of a window, and of the grams whose hashes are winnowed: each window of SPAN words holds SPAN - GRAM + 1 grams.
SPAN, GRAM = 13, 4
#: Everything below 0x80 that is neither a digit nor a small letter.
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _BREAK), "")


def fingerprints(rows: DataFrame, span: int, gram: int) -> DataFrame:
    """``rows`` (with ``words``) plus ``prints``: {fp, i, end}, one for each run of windows i .. end - 1 with one least gram hash.

    A window is known by the least hash of its grams, so any two texts with ``span`` words in common have a
    fingerprint in common. Columns are built one upon the other; each is named and used more than once, so that none
    is evaluated inside the loop of the next. (For the same reason computed arrays are exploded by the outer form:
    for the plain one, the optimizer would add a filter that evaluates all of them again.)
    """
    rows = rows.withColumn("n", F.size("words")).withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("g", F.transform("h", lambda x, i: F.xxhash64(x, *(F.get("h", i + k) for k in range(1, gram)))))
    width = span - gram + 1
    rows = rows.withColumn("m", F.transform(F.slice("g", F.lit(1), F.greatest(F.col("n") - (span - 1), F.lit(0))),
                                            lambda x, i: F.least(x, *(F.get("g", i + k) for k in range(1, width)))))
    rows = rows.withColumn("runs", F.filter(F.transform("m", lambda x, i: F.struct(x.alias("fp"), i.alias("i"))),
                                            lambda s, i: (i == 0) | (s["fp"] != F.get("m", i - 1))))
    return rows.withColumn("prints", F.transform("runs", lambda s, k: F.struct(
        s["fp"].alias("fp"), s["i"].alias("i"), F.coalesce(F.get("runs", k + 1)["i"], F.size("m")).alias("end")))).drop("h", "g", "m", "runs")


def gram_at(words_col: str, start: Column, length: Column, most: int) -> Column:
    """The words from ``start`` on, one space between."""
    return F.concat_ws(" ", *(F.when(F.lit(k) < length, F.get(words_col, start + k)) for k in range(most)))


def occurrences(docs: DataFrame, items: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                item_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, hits): ``documents`` has (id, th, n_words) per row, ``hits`` (id, th, s, length, item).

    A hit says that ``length`` words from word ``s`` on are a window of the item: ``span`` consecutive words of it,
    or all of them where it has fewer. Fingerprints only propose windows; equality of the words decides.
    ``th`` is a hash of the text, so that two texts under one id stay apart and repeated rows are one.
    """
    keyed = C.keyed(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    items = C.stored(items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), words(F.coalesce(F.col(item_text_col).cast("string"), F.lit(""))).alias("words")), "op4-items")
    long_items = fingerprints(items.filter(F.size("words") >= span), span, gram)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - span, F.lit(0)))
    windows = C.stored(items.filter(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(span))).withColumn("starts", starts).select(
        "item", "length", F.explode_outer(F.transform("starts", lambda s: gram_at("words", s, F.col("length"), span))).alias("window")).distinct(), "op4-windows")
    item_prints = C.stored(long_items.select(F.explode_outer("prints.fp").alias("fp")).distinct(), "op4-item-prints")
    marked = C.stored(fingerprints(keyed.select("id", "th", words(F.col("text")).alias("words")), span, gram).select("id", "th", F.col("n").alias("n_words"), "prints"), "op4-prints")
    found = (marked.select("id", "th", F.explode("prints").alias("p")).select("id", "th", "p.*").join(item_prints, "fp", "left_semi")
             .select("id", "th", "i", "end", F.lit(span).alias("length")))
    short = items.filter((F.size("words") > 0) & (F.size("words") < span))
    if short.limit(1).count():
        # fewer words than a window: looked up by the longest word
        longest = F.array_max(F.transform("words", lambda w: F.length(w)))
        short = short.withColumn("at", F.array_position(F.transform("words", lambda w: F.length(w)), longest).cast("int") - 1)
        short = C.stored(short.select(F.get("words", F.col("at")).alias("word"), "at", F.size("words").alias("length")).distinct(), "op4-short")
        placed = keyed.select("id", "th", F.posexplode_outer(words(F.col("text"))).alias("pos", "word")).join(short, "word")
        found = found.unionByName(placed.select("id", "th", (F.col("pos") - F.col("at")).alias("i"), (F.col("pos") - F.col("at") + 1).alias("end"), "length").filter("i >= 0"))
    wanted = C.stored(found.groupBy("id", "th").agg(F.collect_set(F.struct("i", "end", "length")).alias("found")), "op4-found")
    texts = keyed.join(wanted, ["id", "th"]).select("id", "th", "found", words(F.col("text")).alias("words"))
    # a place and a length in one whole number: structs would be compared each with each
    spread = F.array_distinct(F.flatten(F.transform("found", lambda f: F.transform(
        F.sequence(f["i"], f["end"] - 1), lambda s: s.cast("long") * (span + 1) + f["length"]))))
    texts = texts.withColumn("places", F.filter(F.transform(spread, lambda p: F.struct(
        F.floor(p / (span + 1)).cast("int").alias("s"), F.pmod(p, F.lit(span + 1)).cast("int").alias("length"))), lambda p: p["s"] + p["length"] <= F.size("words")))
    grams = texts.select("id", "th", F.explode_outer(F.transform("places", lambda p: F.struct(
        p["s"].alias("s"), p["length"].alias("length"), gram_at("words", p["s"], p["length"], span).alias("window")))).alias("p")).select("id", "th", "p.*")
    hits = C.stored(grams.join(windows.select("item", "window"), "window").select("id", "th", "s", "length", "item").distinct(), "op4-hits")
    C.forget(wanted, windows, item_prints, items)
    return marked.select("id", "th", "n_words"), hits


def contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (sorted as strings), contaminated.

    ``n_hit`` counts the words inside any window of an item; a document is contaminated when they are at least
    a twentieth of its words. Null texts have no words; null ids count as the smallest id and stay null; rows
    that repeat another row wholly are judged alike; an empty benchmark hits nothing. Null item ids are the empty
    string. Other columns are not read.
    """
    rows, hits = occurrences(docs, items, **options)
    place = F.explode(F.sequence("s", F.col("s") + F.col("length") - 1))
    covered = hits.select("id", "th", place.alias("w")).distinct().groupBy("id", "th").agg(F.count(F.lit(1)).alias("n_hit"))
    named = hits.select("id", "th", "item").distinct().groupBy("id", "th").agg(F.sort_array(F.collect_list("item")).alias("items"))
    per_text = C.stored(covered.join(named, ["id", "th"]), "op4-result")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.join(per_text, ["id", "th"], "left").select(
        C.unkeyed().alias("doc_id"), "id", "th", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, as they came."""
    i, th = C.fresh("id", "th")
    bad = contamination(docs, items, id_col=id_col, text_col=text_col, **options).filter("contaminated").select(F.col("id").alias(i), F.col("th").alias(th)).distinct()
    return docs.join(C.stored(bad, "op4-bad"), C.same_text(docs, id_col, text_col, i, th), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


ORACLE = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS l, unnest(list_transform(range(0, greatest(len(w) - 13, 0) + 1), lambda i: array_to_string(w[i + 1:i + least(len(w), 13)], ' '))) AS win FROM b WHERE len(w) > 0),
ls AS (SELECT DISTINCT l FROM win),
dw AS (SELECT doc_id, l, unnest(range(0, len(w) - l + 1)) AS s, unnest(list_transform(range(0, len(w) - l + 1), lambda i: array_to_string(w[i + 1:i + l], ' '))) AS win FROM d, ls WHERE len(w) >= l),
hit AS (SELECT doc_id, s, dw.l, item FROM dw JOIN win USING (win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS sha FROM hit GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""
