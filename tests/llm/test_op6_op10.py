import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from tidemark.llm import op6_pii as op6
from tidemark.llm import op10_secrets as op10
from tidemark.llm import spans as S

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ASSIGN = re.compile(r"""((?:%s))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""" % "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w).replace("_", "_?") for w in ("password", "passwd", "secret", "token", "api_key")))
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")


def luhn(d):
    return sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)).encode()).hexdigest()


def base6(t):
    t, out = t or "", []
    out += [(m.start(), 0, "email", m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, "ip", m.end()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, "card", m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    out += [(m.start(), 3, "phone", m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m.group())) <= 15]
    return out


def base10(t):
    t, out = t or "", []
    out += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m.group(2)) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(t) if len(m.group()) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(t) if len(m.group()) >= 24]
    return out


def texts(bits, seed):
    rng = random.Random(seed)
    rows = [(None, "".join(bits)), (-1, None), (-2, ""), (-3, bits[0]), (-4, "a" * 50_000), (-5, "1 " * 20_000), (-6, "a@b" + ".c" * 30_000), (-7, "é\U0001f600 " + bits[1] * 3000)]
    rows += [(d, "".join(rng.choice(bits) if rng.random() < 0.5 else rng.choice(list("ab1 9.@+-é\n:=_'\"(x") + ["\U0001f600", "0", ".", " "]) for _ in range(rng.randint(0, 40)))) for d in range(300)]
    return rows + rows[3:5]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1, "k") for d, t in rows], "doc_id long, text string, kind string, id int, match string").repartition(6)


def check(out, rows, base, names):
    got = sorted(((r.doc_id, *(r[f"n_{k}"] for k in names), r.base_sha256) for r in out.collect()), key=str)
    want = sorted(((d, *(sum(x[2] == k for x in base(t)) for k in names), digest(base(t))) for d, t in rows), key=str)
    assert got == want


def test_base_pii_is_brute_force(spark):
    bits = ["john.d+x@mail.example.org", "4111 1111 1111 1111", "+49 (30) 1234-5678", "10.0.0.255", "10.0.0.256", "4111111111111112", "@", "a@b", ".com", "+1", "1.2.3.4.5", "000255.1.1.1", "-", "00"]
    rows = texts(bits, 1)
    rows_, spans = op6.pii_spans(frame(spark, rows))
    found = S.listed(spans, op6.BASE, [*op6.BASE, "term"])
    out = rows_.select("id", "th").join(found, ["id", "th"], "left").select(
        F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id"), *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in op6.BASE), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"))
    check(out, rows, base6, op6.BASE)


def test_terms_that_disclose_and_redaction(spark):
    rows = [(d, f"Ask Zebulon at zeb@ex.org or word{d % 7}{d} today") for d in range(5)]
    rows += [(d, f"Ask someone at mail{d}@ex.org or nobody today, plain text {d}") for d in range(5, 60)]
    docs = frame(spark, rows)
    _, spans = op6.pii_spans(docs)
    assert {(r.id, r.kind, r.start, r.end) for r in spans.filter("kind = 'term'").collect()} == {(d, "term", 4, 11) for d in range(5)}
    clean = op6.sanitize(docs)
    assert clean.columns == docs.columns
    got = {r.doc_id: r.text for r in clean.collect()}
    assert got[3] == "Ask [TERM] at [EMAIL] or word33 today" and got[7] == "Ask someone at [EMAIL] or nobody today, plain text 7"
    assert op6.sanitize(docs.limit(0)).count() == 0


def test_terms_far_short_and_in_other_documents_are_brute_force(spark):
    rng = random.Random(5)
    common = [f"w{k}" for k in range(30)]
    people = [("Bo", "bo@ex.org"), ("Łukasz", "l.k@ex.org"), ("Ann", "+49 (30) 1234-5678"), ("X", "10.1.2.3")]
    rows = []
    for d in range(150):
        words = [rng.choice(common) for _ in range(60)]
        if d % 15 == 0:
            name, entity = people[d // 15 % 4]
            words[2], words[50] = name, entity
            if d % 30 == 0:
                words[40] = name.upper()
        if d == 40:
            words[7] = "Ann"
        if d in (60, 61):
            words[3:5] = ["Mo", "lone@ex.org"] if d == 60 else ["Mo2", "a"]
        rows.append((d, " ".join(words)))
    rows += [(500, rows[15][1]), (501, rows[15][1]), (None, rows[45][1])]
    _, spans = op6.pii_spans(frame(spark, rows))
    got = {(r.id, r.start, r.end) for r in spans.filter("kind = 'term'").collect()}

    texts, holds, words = {t for _, t in rows}, {}, {}
    for t in texts:
        base = [(a, b, k) for a, _, k, b in base6(t)]
        holds[t] = {(k, digits(t[a:b]) if k in ("card", "phone") else t[a:b].lower()) for a, b, k in base}
        words[t] = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^\W_]+", t) if any(c.isalpha() for c in m.group()) and not any(a < m.end() and m.start() < b for a, b, _ in base)]
    guilty = {t: set() for t in texts}
    for e in set().union(*holds.values()):
        have = [t for t in texts if e in holds[t]]
        p = len(have) / len(texts)
        for w in {w for t in have for *_, w in words[t]}:
            n, both = (sum(any(x[2] == w for x in words[t]) for t in group) for group in (texts, have))
            if math.log((both + 0.5 * p) / (n + 0.5) / p) >= 0.9 * math.log(1 / p):
                for t in have:
                    guilty[t].add(w)
    want = {(-(2**63) if d is None else d, a, b) for d, t in rows for a, b, w in words[t] if w in guilty[t]}
    assert got == want
    named = {rows[d][1][a:b] for d, a, b in want if d is not None and 0 <= d < 150}
    assert {"Bo", "BO", "Łukasz", "X", "Mo"} <= named and not named & set(common) and {500, 501, -(2**63)} <= {d for d, *_ in want}


def test_base_secrets_are_brute_force(spark):
    bits = ["password", "PassWD", "secret", "Token", "api_key", "APIKEY", "=", ": ", "'", "hunter22", "abc", "AKIA", "ABCDEFGHIJKLMNOP12", "0123456789abcdef01234567", "deadbeef", "ſecret=abcdefgh", "toKen=abcdefgh"]
    rows = texts(bits, 2)
    rows_, spans = op10.secret_spans(frame(spark, rows))
    found = S.listed(spans, op10.BASE, [*op10.RULES])
    out = rows_.join(found, ["id", "th"], "left").select(F.when(F.col("id") != -(2**63), F.col("id")).alias("doc_id"),
                                                        *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in op10.BASE), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"))
    check(out, rows, base10, op10.BASE)
    none = frame(spark, rows).limit(0)
    assert op10.secret_spans(none)[1].count() == 0


def test_trigram_queries_and_further_rules(spark):
    assert op10.trigram_query(op10.RULES["hex"]) is None
    assert op10.trigram_query("AKIA[A-Z0-9]{16,}") == [frozenset({"aki", "kia"})]
    assert set(op10.trigram_query("(?:abc|de_?fg)x")) == {frozenset({"abc", "bcx"}), frozenset({"de_", "e_f", "_fg", "fgx"}), frozenset({"def", "efg", "fgx"})}
    assert [k for k in op10.RULES if op10.trigram_query(op10.RULES[k]) is None] == ["hex"]
    rows = [(1, "x -----BEGIN RSA PRIVATE KEY----- y"), (2, "ghp_" + "a1" * 18), (3, "xoxb-1234567890ab"), (4, "sk_live_" + "Z" * 20), (5, "Bearer " + "Q" * 30), (6, "nothing")]
    _, spans = op10.secret_spans(frame(spark, rows))
    assert {(r.id, r.kind) for r in spans.collect() if r.kind not in op10.BASE} == {(1, "private_key"), (2, "github"), (3, "slack"), (4, "stripe"), (5, "bearer")}
