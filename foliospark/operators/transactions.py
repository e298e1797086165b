"""Transactions of text edits: a batch of commands for each document that holds as a whole or not at all.

Commands are (doc_id, command, ord, start, end, expected, replacement): a stretch of a node's text by code points, the whole text where ``start`` is
null, what must stand there now, and what is put there. A document's batch may also name the ``base`` it was made for, the digest of all its
nodes. Every command is checked before any is carried out, and has a status: ``NodeMissing``, ``BaseMismatch``, ``InRevision``, ``OutOfRange``,
``TextMismatch``, ``DuplicateTarget`` (the same stretch twice), ``Overlap``, ``LimitExceeded``, or ``Ready``. A batch with any other status than ``Ready`` changes nothing.

What was applied has an exact inverse: commands against the new text, tied to its digest, that give back the old one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# How many commands a batch has at most, and how many characters they put in.
MOST_COMMANDS, MOST_CHARS = 10_000, 16 << 20


def fingerprints(nodes: DataFrame) -> DataFrame:
    """(doc_id, base): a digest of every document's nodes (ord, text) in order."""
    line = F.concat_ws("\x1f", F.col("ord").cast("string"), F.sha2(F.coalesce("text", F.lit("")), 256))
    return nodes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", line.alias("line")))).alias("x")).select("doc_id", F.sha2(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), 256).alias("base"))


def checked(nodes: DataFrame, commands: DataFrame, bases: DataFrame | None = None, most_commands: int = MOST_COMMANDS, most_chars: int = MOST_CHARS) -> DataFrame:
    """Commands with their stretch filled in, ``status`` and ``ready``, whether their whole batch is."""
    own = nodes.select("doc_id", "ord", F.coalesce("text", F.lit("")).alias("text"), F.col("in_revision") if "in_revision" in nodes.columns else F.lit(False).alias("in_revision"))
    rows = commands.join(own, ["doc_id", "ord"], "left")
    size = F.length("text")
    rows = rows.withColumns({"start": F.coalesce("start", F.lit(0)), "end": F.when(F.col("start").isNull(), size).otherwise(F.col("end")).cast("int")})
    found = F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))
    batch, place = W.partitionBy("doc_id"), W.partitionBy("doc_id", "ord").orderBy("start", "end", "command")
    far = F.max("end").over(place.rowsBetween(W.unboundedPreceding, -1))
    same = F.count("*").over(W.partitionBy("doc_id", "ord", "start", "end")) > 1
    later = F.lead("start").over(place)
    rows = rows.withColumns({"_far": far, "_same": same, "_next": later, "_n": F.count("*").over(batch), "_chars": F.sum(F.length("replacement")).over(batch)})
    if bases is not None:
        rows = rows.join(bases.select("doc_id", F.col("base").alias("_wanted")), "doc_id", "left").join(fingerprints(nodes), "doc_id", "left")
        stale = F.col("_wanted").isNotNull() & ~F.col("_wanted").eqNullSafe(F.col("base"))
    else:
        stale = F.lit(False)
    status = (
        F.when((F.col("_n") > most_commands) | (F.col("_chars") > most_chars), "LimitExceeded").when(stale, "BaseMismatch").when(F.col("text").isNull(), "NodeMissing").when(F.col("in_revision"), "InRevision")
        .when(~F.coalesce((F.col("start") >= 0) & (F.col("start") <= F.col("end")) & (F.col("end") <= size), F.lit(False)), "OutOfRange").when(~found.eqNullSafe(F.col("expected")), "TextMismatch")
        .when(F.col("_same"), "DuplicateTarget").when((F.coalesce("_far", F.lit(0)) > F.col("start")) | (F.coalesce("_next", F.col("end")) < F.col("end")), "Overlap").otherwise("Ready")
    )
    rows = rows.withColumn("status", status)
    return rows.withColumn("ready", F.bool_and(F.col("status") == "Ready").over(batch)).select("doc_id", "command", "ord", "start", "end", "expected", "replacement", "status", "ready")


def _spliced(text: Column, edits: Column) -> Column:
    """A text with stretches (start, end, replacement), in order and apart from each other, replaced."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate(edits, first, lambda s, e: F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, e["start"] - s["at"]), e["replacement"]).alias("out"), e["end"].alias("at")))
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))


def applied(nodes: DataFrame, plan: DataFrame) -> DataFrame:
    """The nodes after all batches that are ready."""
    edits = plan.where("ready").groupBy("doc_id", "ord").agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("_edits"))
    text = F.when(F.col("_edits").isNotNull(), _spliced(F.coalesce("text", F.lit("")), F.col("_edits"))).otherwise(F.col("text"))
    return nodes.join(edits, ["doc_id", "ord"], "left").withColumn("text", text).select(*nodes.columns)


def inverse(plan: DataFrame) -> DataFrame:
    """Commands that undo the batches that are ready, against the text that they leave."""
    grown = F.length("replacement") - (F.col("end") - F.col("start"))
    before = F.coalesce(F.sum(grown).over(W.partitionBy("doc_id", "ord").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    start = (F.col("start") + before).cast("int")
    return plan.where("ready").select(
        "doc_id", "command", "ord", start.alias("start"), (start + F.length("replacement")).alias("end"), F.col("replacement").alias("expected"), F.col("expected").alias("replacement")
    )


def outcomes(plan: DataFrame) -> DataFrame:
    """(doc_id, outcome, n_commands, n_changed, problems, plan_id): Applied, NoChange or Refused; problems are the statuses other than Ready, and equal plans have equal ids."""
    line = F.concat_ws("\x1f", F.col("ord").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), "expected", "replacement")
    changed = F.count_if(F.col("ready") & (F.col("expected") != F.col("replacement")))
    rows = plan.groupBy("doc_id").agg(
        F.bool_and("ready").alias("ready"), F.count("*").alias("n_commands"), changed.alias("n_changed"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("status") != "Ready", F.col("status")))), ",").alias("problems"),
        F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\x1e"), 256).alias("plan_id"),
    )
    outcome = F.when(~F.col("ready"), "Refused").when(F.col("n_changed") == 0, "NoChange").otherwise("Applied")
    return rows.select("doc_id", outcome.alias("outcome"), "n_commands", "n_changed", "problems", "plan_id")
