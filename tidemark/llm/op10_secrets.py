"""Secret scan: a trigram index proposes documents for each rule, the rule's expression verifies them."""

from __future__ import annotations

import re._constants as K
import re._parser as parser
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C
from tidemark.llm import spans as S

BASE = ["assign", "access", "hex"]
_ANY_CASE = r"(?i:password|passwd|secret|token|api_?key)"
#: Base rules (fixed values; the least lengths are part of the pattern where nothing but the length is tested), then further ones.
RULES = {
    "assign": _ANY_CASE + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
    "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    "github": r"gh[pousr]_[A-Za-z0-9]{36}",
    "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe": r"[sr]k_live_[A-Za-z0-9]{16,}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "bearer": r"[Bb]earer [A-Za-z0-9._~+/-]{24,}",
}
_VALUE = r"""^.*?[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""


def alternatives(tree) -> list[list[str]]:
    """Ways to match a parsed expression, each as strings that must occur; between two of them anything may stand.

    Small classes and optional characters are multiplied out, all else is open.
    """
    ways: list[list[str]] = [[""]]

    def then(more: list[list[str]]) -> None:
        nonlocal ways
        ways = [[*w[:-1], w[-1] + m[0], *m[1:]] for w, m in product(ways, more)]

    for op, arg in tree:
        if op is K.LITERAL:
            then([[chr(arg)]])
        elif op is K.BRANCH:
            then([w for branch in arg[1] for w in alternatives(branch)])
        elif op is K.SUBPATTERN:
            then(alternatives(arg[-1]))
        elif op is K.IN and all(x is K.LITERAL for x, _ in arg) and len(arg) <= 6:
            then([[chr(c)] for _, c in arg])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[1] == 1 and len(arg[2]) == 1 and arg[2][0][0] is K.LITERAL:
            then([[""], *alternatives(arg[2])])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT) and arg[0] >= 1:
            once = alternatives(arg[2])
            then([[*w, "", ""] if len(w) > 1 else [w[0], ""] for w in once] if arg[1] > 1 else once)
        else:
            then([["", ""]])
    return ways


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """OR of ANDs of lower-case trigrams that every match holds; None where some way to match has no trigram."""
    ways = set()
    for way in alternatives(parser.parse(pattern)):
        ways.add(frozenset(p.lower()[i:i + 3] for p in way for i in range(len(p) - 2)))
    if not all(ways):
        return None
    return sorted((w for w in ways if not any(o < w for o in ways)), key=sorted)


def candidates(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(id, th, rules): the rules whose trigrams a document holds, from an inverted index of the trigrams that any rule asks for.

    The index lists (trigram, id, th) of all documents. A clause is met by the documents that are in all its
    posting lists, a rule by those that meet one of its clauses; both are counts grouped by document, so a trigram that every document
    has makes no large group.
    """
    spark = rows.sparkSession
    asked = [(rule, i, t, len(clause)) for rule, p in rules.items() for i, clause in enumerate(trigram_query(p) or ()) for t in sorted(clause)]
    vocabulary = sorted({t for _, _, t, _ in asked})
    low = rows.select("id", "th", F.lower("text").alias("low"))
    has = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in vocabulary)))
    postings = C.stored(low.select("id", "th", has.alias("trigrams")).select(F.explode_outer("trigrams").alias("trigram"), "id", "th").filter("trigram IS NOT NULL"), "op10-postings")
    clauses = F.broadcast(spark.createDataFrame(asked, "rule string, clause int, trigram string, need int"))       # as many rows as the rules have trigrams
    met = postings.distinct().join(clauses, "trigram").groupBy("id", "th", "rule", "clause", "need").agg(F.count(F.lit(1)).alias("c")).filter("c = need")
    return met.groupBy("id", "th").agg(F.collect_set("rule").alias("rules"))


def secret_spans(docs: DataFrame, rules: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): ``rows`` (id, th) of every document, ``spans`` (id, th, kind, start, end, match).

    A rule without mandatory trigrams, such as a run of hexadecimal digits, is searched in every document. Null texts count as
    empty, null ids as the smallest id; rows that repeat another wholly share its spans; an empty table has none. Other
    columns are not read.
    """
    rules = rules or RULES
    rows = C.keyed(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    proposed = C.stored(candidates(rows, rules), "op10-candidates")
    texts = rows.join(proposed, ["id", "th"], "left")
    kinds = [(k, p, None if trigram_query(p) is None else F.coalesce(F.array_contains("rules", k), F.lit(False))) for k, p in rules.items()]
    found = S.find(texts, kinds)
    long_enough = F.length(F.regexp_extract("match", _VALUE, 1)) >= 6
    return rows.select("id", "th"), C.stored(found.filter((F.col("kind") != "assign") | long_enough), "op10-spans")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, spans = secret_spans(C.table(spark, sf_dir, "documents"))
    found = C.stored(S.listed(spans, BASE, [*BASE, *(k for k in RULES if k not in BASE)]), "op10-listed")
    return rows.join(found, ["id", "th"], "left").select(
        C.unkeyed().alias("doc_id"), *(F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))
