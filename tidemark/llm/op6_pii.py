"""Personal data: patterns find protected entities, corpus co-occurrence finds the terms that give them away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import spans as S

BASE = ["email", "ip", "card", "phone"]
#: The base patterns (fixed values), with possessive repeats and, where a match can only begin at the start of a run or
#: right after a match, a test for that; so a search takes time in proportion to the text.
_NAME = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_NAME})|\G){_NAME}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: A term gives an entity away when it tells this share of the entity's information. Each estimate starts from so many texts with the term in
#: which the entity is as frequent as in all texts.
DISCLOSED, PRIOR = 0.9, 0.5
#: A term is such a run with a letter in it.
_WORD = r"[\p{L}\p{M}\p{N}]++"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """From the right, every second digit counts double, less 9 beyond 9; the sum is a multiple of 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0


def entities(rows: DataFrame) -> DataFrame:
    """Base spans of ``rows`` (id, th, text); matches that fail their kind's test are dropped, and nothing is tried in their place."""
    found = S.find(rows, [(k, PATTERNS[k], None) for k in BASE])
    digits = _digits(F.col("match"))
    card = F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    good = (F.when(F.col("kind") == "ip", F.col("match").rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")).when(F.col("kind") == "card", card)
            .when(F.col("kind") == "phone", F.length(digits).between(10, 15)).otherwise(True))
    return found.filter(good)


def disclosing_terms(rows: DataFrame, spans: DataFrame, disclosed: float = DISCLOSED, prior: float = PRIOR) -> DataFrame:
    """Spans (id, th, kind 'term', start, end) of the words that give away an entity of their document.

    Everything is counted over different texts; copies of a text are no further evidence. The entity is the matched string in lower case, of
    cards and phones the digits; its information is the negative logarithm of its share ``p`` of all texts. A term is a word of any length
    outside the entities, anywhere in a text that holds the entity. Held by ``t`` texts, ``b`` of them with the
    entity, it tells log((b + prior * p) / (t + prior) / p). Where that reaches the share ``disclosed`` of the entity's information, every
    place of the term in every document that holds the entity is a span.

    Entities held by the same texts have the same numbers and count as one context; a pair is only formed where ``t`` leaves it
    a chance with the largest ``b`` possible.
    """
    texts = rows.select("th", "text").dropDuplicates(["th"])
    total = float(max(1, texts.count()))
    entity = F.concat_ws(":", "kind", F.when(F.col("kind").isin("card", "phone"), _digits(F.col("match"))).otherwise(F.lower("match")))
    holds = C.stored(spans.select("th", entity.alias("entity")).distinct(), "op6-holds")
    held = holds.groupBy("entity").agg(*(F.bit_xor(F.xxhash64("th", F.lit(k))).alias(f"x{k}") for k in (1, 2)), F.count(F.lit(1)).alias("n_context"))
    contexts = C.stored(holds.join(held, "entity").select("th", "x1", "x2", "n_context").distinct(), "op6-contexts")
    # entities become blanks, so that their own parts are no terms and places stay
    blank = S.redacted(texts.join(holds.select("th").distinct(), "th", "left_semi").withColumn("id", F.lit(0)), spans.select(F.lit(0).alias("id"), "th", "kind", "start", "end").distinct(),
                       lambda _, n: F.repeat(F.lit(" "), n))
    blank = C.stored(blank.select("id", "th", F.col("clean").alias("text")), "op6-blank")
    words = lambda df: df.select("th", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0)), F.lower))).alias("term")).filter(F.col("term").rlike(r"\p{L}"))
    inside = C.stored(words(blank), "op6-inside")
    asked = inside.select("term").distinct()
    outside = words(texts.join(holds.select("th").distinct(), "th", "left_anti")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    n_term = inside.groupBy("term").agg(F.count(F.lit(1)).alias("n")).unionByName(outside.join(asked, "term", "left_semi")).groupBy("term").agg(F.sum("n").alias("n_term"))
    p = F.col("n_context") / total
    least = F.pow(p, F.lit(1 - disclosed)) * (F.col("n_term") + prior) - prior * p       # texts with both that it takes
    widest = max(1, contexts.agg(F.max("n_context")).first()[0] or 1)
    # b is at most the smaller of both counts: terms that no context can reach go before they meet one
    reach = (widest + prior) / (1 / total) ** (1 - disclosed)
    rare = C.stored(n_term.filter(F.col("n_term") <= reach), "op6-rare")
    pairs = inside.join(rare, "term").join(contexts, "th").filter((F.col("n_context") < total) & (F.least("n_term", "n_context") >= least))
    pairs = pairs.groupBy("term", "x1", "x2", "n_context", "n_term").agg(F.count(F.lit(1)).alias("n_both"))
    guilty = C.stored(pairs.filter(F.col("n_both") >= least).select("term", "x1", "x2"), "op6-guilty")
    marked = C.stored(contexts.join(guilty, ["x1", "x2"]).select("th", "term").join(inside, ["th", "term"], "left_semi").distinct(), "op6-marked")
    found = S.find(blank.join(marked.select("th").distinct(), "th", "left_semi"), [("term", _WORD, None)])
    places = found.withColumn("term", F.lower("match")).join(marked, ["th", "term"], "left_semi").select("th", "kind", "start", "end")
    return rows.select("id", "th").distinct().join(places, "th").select("id", "th", "kind", "start", "end")


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosed: float = DISCLOSED, prior: float = PRIOR) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): ``rows`` (id, th, text) of every document, ``spans`` (id, th, kind, start, end) of base kinds and 'term'.

    Null texts count as empty, null ids as the smallest id; rows that repeat another wholly share its spans; an empty table
    has none. Other columns are not read.
    """
    rows = C.keyed(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    base = C.stored(entities(rows), "op6-base")
    terms = disclosing_terms(rows, base, disclosed, prior)
    return rows, C.stored(base.select("id", "th", "kind", "start", "end").unionByName(terms), "op6-spans")


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every covered stretch of the text generalised to its kind, such as ``[EMAIL]``; the other columns as they came."""
    rows, spans = pii_spans(docs, id_col, text_col, **options)
    i, th, new = C.fresh("id", "th", "clean")
    clean = C.stored(S.redacted(rows.dropDuplicates(["id", "th"]), spans, lambda kind, _: F.concat(F.lit("["), F.upper(kind), F.lit("]"))), "op6-clean").select(
        F.col("id").alias(i), F.col("th").alias(th), F.col("clean").alias(new))
    out = docs.join(clean, C.same_text(docs, id_col, text_col, i, th), "left")
    return out.select(*(F.coalesce(F.col(new), docs[c]).alias(c) if c == text_col else docs[c] for c in docs.columns))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spans = pii_spans(C.table(spark, sf_dir, "documents"))
    found = C.stored(S.listed(spans, BASE, [*BASE, "term"]), "op6-listed")
    return rows.select("id", "th").join(found, ["id", "th"], "left").select(
        C.unkeyed().alias("doc_id"), *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
