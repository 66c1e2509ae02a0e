"""Chat formatting with Spark expressions only.

A conversation becomes one string. Adjacent turns of a role form a block::

    <|im_start|>role<|im_sep|>text<|im_part|>text<|im_end|>

Control strings, these and the common ones of other templates, cannot come out of a text: a backslash is put after the
first character of each, and after each backslash, which ``unescaped`` takes away again. ``loss_spans`` are the (start,
end) character ranges of the assistant's texts in the string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, running

START, SEP, PART, END = "<|im_start|>", "<|im_sep|>", "<|im_part|>", "<|im_end|>"
#: What is escaped: a backslash, or the first character of a control string.
_CONTROL = r"\\|<(?=\|im_(?:start|sep|part|end)\|>|/?s>|</?SYS>>)|\[(?=/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def _literal(mark: str) -> str:
    return r"\Q" + mark + r"\E"


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conv_id of (conv_id, turn, role, text): conv_id, formatted, loss_spans.

    Turns are ordered by turn, then role and text where turn numbers repeat (null first); repeated rows are turns of their
    own. A null text or role is empty. Rows with a null conv_id are one conversation. An empty table gives an empty one, other
    columns are not looked at, whatever their names, and the steps grow in proportion to a conversation's turns and texts.
    """
    rows = turns.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    collected = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    # Turns of a role that follow each other are a block: the places where the role changes cut the array.
    def cut(turns: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(turns) - 1)
        starts = F.filter(places, lambda i: ~F.coalesce(F.get(turns, i - 1)["role"] == F.get(turns, i)["role"], F.lit(False)))

        def block(s: Column, start: Column, k: Column) -> Column:
            own = F.slice(turns, start + 1, F.coalesce(F.get(s, k + 1), F.size(turns)) - start)
            return F.struct(F.get(turns, start)["role"].alias("role"), F.transform(own, lambda t: escaped(t["text"])).alias("texts"))

        return bind(starts, lambda s: F.transform(s, lambda start, k: block(s, start, k)))

    blocks = collected.select("conv_id", cut(F.col("turns")).alias("blocks"))
    head = lambda b: F.concat(F.lit(START), escaped(b["role"]), F.lit(SEP))
    whole = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), F.array_join(b["texts"], PART), F.lit(END))), "")

    # The part of each text in the string: what stands before it, its length, and what stands behind it.
    def parts(b: Column) -> Column:
        last = F.size(b["texts"]) - 1
        return F.transform(b["texts"], lambda t, i: F.struct(
            F.when(i == 0, F.length(head(b))).otherwise(len(PART)).alias("before"), F.length(t).alias("length"), F.when(i == last, len(END)).otherwise(0).alias("after"), (b["role"] == loss_role).alias("counts"),
        ))

    def spans(p: Column) -> Column:
        at = running(F.transform(p, lambda x: x["before"] + x["length"] + x["after"]), F.lit(0), lambda a, n: a + n)
        placed = F.zip_with(p, at, lambda x, a: F.struct(x["counts"].alias("counts"), (a + x["before"]).alias("start"), (a + x["before"] + x["length"]).alias("end")))
        return F.transform(F.filter(placed, lambda x: x["counts"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))

    return blocks.select("conv_id", whole.alias("formatted"), bind(F.flatten(F.transform("blocks", parts)), spans).alias("loss_spans"))


def parse(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) and loss_texts, read back from ``format_conversations``' output alone."""
    blocks = F.filter(F.split("formatted", _literal(END)), lambda b: b != "")
    texts = lambda b: F.split(F.substring_index(b, SEP, -1), _literal(PART), -1)
    role = lambda b: unescaped(F.substring(F.substring_index(b, SEP, 1), len(START) + 1, 2**31 - 1))
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(texts(b), lambda t: F.struct(role(b).alias("role"), unescaped(t).alias("text")))))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss_texts"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of formatted conversations."""
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return parse(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


#: The rows of ``digests`` over conversations and the added conversation -1, for DuckDB.
DIGESTS_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    length(text) + length(regexp_replace(text, '(\\|<\|im_(?:start|sep|part|end)\|>|</?s>|<</?SYS>>|\[/?INST\])', 'x\1', 'g')) - length(text) AS size,
    length(regexp_replace(role, '(\\|<\|im_(?:start|sep|part|end)\|>|</?s>|<</?SYS>>|\[/?INST\])', 'x\1', 'g')) AS role_size
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size + CASE WHEN before IS NOT DISTINCT FROM role THEN 11 ELSE role_size + 32 END)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""
