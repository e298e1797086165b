"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as
context, then the turn itself, whose text alone is under the loss mask. A
conversation that doesn't end with an assistant turn gets one last example
without a target, so no turn is lost.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings inside texts
get one backslash after their first character (behind any that are there),
which ``unescape`` takes away again; roles other than letters, digits and ``_``
are written as ``~`` and hexadecimal digits. So an output can be read back.

Turns are ordered by turn, role and text; null turns come first, null texts
and roles are empty, repeated rows are repeated turns. A null id is a
conversation of its own. Other columns are not looked at, whatever their names. An empty table
gives no rows. Conversations are the unit of work: one is gathered
into one row, as each of its examples needs all turns before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings, without their first character.
_TAILS = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?INST\]|/?s>|</?SYS>>)"


def escape(text: Column) -> Column:
    """Make control strings in a text harmless."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAILS, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """The text before ``escape``."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAILS, r"$1$2$3")


def _write_role(role: Column) -> Column:
    return F.when(F.regexp_like(role, F.lit("^[A-Za-z0-9_]+$")) & ~F.contains(role, F.lit("\n")), role).otherwise(F.concat(F.lit("~"), F.hex(role)))


def _read_role(role: Column) -> Column:
    return F.when(F.startswith(role, F.lit("~")), F.decode(F.unhex(F.substr(role, F.lit(2))), "UTF-8")).otherwise(role)


def format_chats(chats: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """One row per example: conv_id, example, formatted, loss_start, loss_end (code points; both 0 without a target)."""
    empty = F.lit("")
    turns = chats.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("text")).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    parts = whole.select(
        "conv_id",
        F.transform("ts", lambda t: F.struct(
            F.concat(F.lit(BEGIN), _write_role(t["role"]), F.lit("\n")).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("target"),
        )).alias("ps"),
    )
    last = F.size("ps") - 1
    picks = F.filter(F.sequence(F.lit(0), last), lambda i: F.get("ps", i)["target"] | (i == last))
    picked = parts.select("conv_id", "ps", F.posexplode(picks).alias("example", "i"))
    joined = lambda n: F.array_join(F.transform(F.slice("ps", F.lit(1), n), lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    own = F.get("ps", F.col("i"))
    out = picked.select(
        "conv_id", "example", joined(F.col("i")).alias("context"), own["head"].alias("head"), own["body"].alias("body"), own["target"].alias("target"),
    )
    start = F.length("context") + F.length("head")
    return out.select(
        "conv_id", "example", F.concat("context", "head", "body", F.lit(END)).alias("formatted"),
        F.when(F.col("target"), start).otherwise(0).alias("loss_start"),
        F.when(F.col("target"), start + F.length("body")).otherwise(0).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.greatest(F.lit(0), F.size(F.split(formatted, r"<\|im_start\|>")) - 1))

    def turn(p):
        head = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.length(head) + 2, F.length(p) - F.length(head) - 1 - len(END))
        return F.struct(_read_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one with control strings, formatted, read back and digested."""
    chats = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"),
    )
    rows = format_chats(chats.unionByName(extra))
    loss = unescape(F.substr("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    conv = (
        rows.select("conv_id", "example", "formatted", loss.alias("loss"))
        .groupBy("conv_id")
        .agg(
            F.max_by("formatted", "example").alias("whole"), F.sum(F.length("formatted")).alias("formatted_chars"),
            F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        )
        .select("conv_id", "formatted_chars", read_turns(F.col("whole")).alias("turns"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss"))
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return conv.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n,
         length(CASE WHEN regexp_full_match(role, '[A-Za-z0-9_]+') THEN role ELSE '~' || hex(encode(role)) END)
         + length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?INST\]|/?s>|</?SYS>>)', '\1\\\2\3', 'g')) + 24 AS chars
  FROM c),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS upto FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY k), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

QUERIES = {"op2_chat_format": op2_chat_format}
ORACLES = {"op2_chat_format": SQL}
