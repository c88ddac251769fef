"""Conversations as training text with a loss mask, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: Control strings of the template: a block begins with HEAD, the role and COLON, a turn ends with END.
HEAD, COLON, END = "### ", ": ", "</turn>\n"
#: Characters that could begin a control string, and what stands for them; the escape sign itself comes first.
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("#", "\\2"), (":", "\\3"))


def escape(text: Column, role: bool = False) -> Column:
    for plain, code in ESCAPES if role else ESCAPES[:-1]:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    """Every code begins with the escape sign, which is restored last, so no step sees what another one made."""
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(rows: DataFrame, learned_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, mask) per conversation.

    Turns are sorted by number, null first, then by role and text, so that ties have one order; repeated rows are turns of their own.
    Neighbours of one role share a block: one head, then each turn with its end mark, so that the turns
    can be told apart again. ``mask`` lists the lengths of consecutive stretches of ``formatted`` in code points and whether the loss counts
    them: three stretches a turn, its head (length 0 inside a block), its text and its end mark; it covers the text without a gap, and only texts of ``learned_role`` count. Null roles and texts are
    empty strings; rows of null conversation form one conversation; other columns are not read.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.groupBy(F.col(conv_col).alias("conv_id")).agg(F.sort_array(F.collect_list(F.struct(
        F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")))).alias("turns"))
    starts = lambda t, i: (i == 0) | (t["role"] != F.get("turns", i - 1)["role"])
    head = lambda t, i: F.when(starts(t, i), F.concat(F.lit(HEAD), escape(t["role"], True), F.lit(COLON))).otherwise(F.lit(""))
    pieces = F.transform("turns", lambda t, i: F.struct(head(t, i).alias("head"), escape(t["text"]).alias("body"), (t["role"] == learned_role).alias("loss")))
    blocks = turns.select("conv_id", pieces.alias("pieces"))
    run = lambda n, loss: F.struct(F.length(n).cast("long").alias("length"), loss.alias("loss"))
    return blocks.select("conv_id", F.concat_ws("", F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END)))).alias("formatted"),
                         F.flatten(F.transform("pieces", lambda p: F.array(run(p["head"], F.lit(False)), run(p["body"], p["loss"]), run(F.lit(END), F.lit(False))))).alias("mask"))


def _without_last(parts: Column) -> Column:
    """Pieces that an end mark closed: what follows the last mark is empty."""
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, in order.

    Escaped texts hold no head, so the text splits at the heads into blocks, and each block at the end marks into its turns.
    """
    def block(b: Column) -> Column:
        role = F.substring_index(b, COLON, 1)
        turns = F.split(F.substr(b, F.length(role) + len(COLON) + 1), END, -1)
        return F.transform(_without_last(turns), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))
    blocks = F.split(formatted, HEAD, -1)
    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), block))


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped, with nothing between.

    The mask has three stretches a turn: head, text, end mark. Each stretch is cut from the piece of its own turn, so the work is in
    proportion to the length.
    """
    turns = _without_last(F.split(formatted, END, -1))
    said = F.transform(turns, lambda t, i: F.when(F.get(mask, 3 * i + 1)["loss"], F.substr(
        t, (F.get(mask, 3 * i)["length"] + 1).cast("int"), F.get(mask, 3 * i + 1)["length"].cast("int"))))
    return unescape(F.array_join(F.array_compact(said), ""))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    out = format_chats(rows.unionByName(more))
    out = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("mask")).alias("loss"))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.concat_ws("", each), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                      F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)),
t AS (SELECT *, lag(role) OVER w IS DISTINCT FROM role AS head, row_number() OVER w AS k FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(text) + length(regexp_replace(text, '[^\\<#]', '', 'g')) + CASE WHEN head THEN 6 + length(role) + length(regexp_replace(role, '[^\\<#:]', '', 'g')) ELSE 0 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
