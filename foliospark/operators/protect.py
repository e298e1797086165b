"""Sensitive text: detection by patterns, spread to all occurrences, span merging, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Patterns by kind, inside what both Java's and RE2's syntax allow.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "PHONE": r"\+[0-9]{1,2} \([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "CARD": r"[0-9]{16}",
    "IP": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
}


def detect(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row per detected string: key, kind, value."""
    found = F.concat(*[_tagged(text, k, p) for k, p in PATTERNS.items()])
    return rows.select(*key, F.explode(found).alias("f")).select(*key, "f.kind", "f.value")


def _tagged(text: str, kind: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def occurrences(text: Column, value: Column) -> Column:
    """Starts (from 1) of all occurrences of a string in a text, those that overlap included, in one pass over the text."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    parts = F.split(text, quoted)  # cut before each occurrence, so all but the first part begin with one
    cut = F.aggregate(
        parts, F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("starts")),
        lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["starts"], F.array(acc["at"])).alias("starts")),
    )["starts"]
    starts = F.when(F.startswith(text, value), cut).otherwise(F.slice(cut, 2, F.size(parts)))
    return F.when((F.length(value) > 0) & F.contains(text, value), starts)


def spans(rows: DataFrame, doc: str, order: str, text: str = "text") -> DataFrame:
    """Spans of every occurrence, in all paragraphs of its document, of each string detected there: doc, order, start (from 1), end (exclusive)."""
    found = detect(rows, [doc], text).select(doc, F.lower("value").alias("value")).distinct()
    both = rows.select(doc, order, F.lower(text).alias("_text")).join(found, doc).where(F.contains("_text", "value"))
    starts = both.select(doc, order, F.length("value").alias("n"), F.explode(occurrences(F.col("_text"), F.col("value"))).alias("start"))
    return starts.select(doc, order, F.col("start").cast("long").alias("start"), (F.col("start") + F.col("n")).cast("long").alias("end")).distinct()


def merge_spans(rows: DataFrame, key: list[str]) -> DataFrame:
    """Spans with overlapping or adjacent ones made one, as gaps and islands."""
    by = W.partitionBy(*key).orderBy("start", "end")
    furthest = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    marked = rows.withColumn("new", F.when(furthest.isNull() | (F.col("start") > furthest), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def redact(text: Column, mask: str = "[REDACTED]") -> Column:
    """A text with every match of every pattern replaced."""
    for p in PATTERNS.values():
        text = F.regexp_replace(text, F.lit(p), F.lit(mask))
    return text


def bates(n: Column, prefix: str, digits: int) -> Column:
    """A page stamp: a prefix and a number padded with zeros, never cut."""
    s = n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(s) >= digits, s).otherwise(F.lpad(s, digits, "0")))


# What the third level of sanitising empties, and what it removes.
_EMPTIED = ("creator", "description", "subject", "title", "lastModifiedBy", "revision", "keywords", "category", "Company")
_REMOVED = ("attachedTemplate", "rsids")


def sanitise(props: Column, level: int = 1, author: str = "Anonymous") -> Column:
    """Properties of a document without traces of who made it.

    Level 1 drops revision ids (rsid and what begins so), level 2 also names all authors alike, level 3 also empties
    creators, titles, companies and the like, and drops the template.
    """
    if level not in (1, 2, 3):
        raise ValueError("level is 1 to 3")
    gone = lambda k: F.startswith(k, F.lit("rsid")) & (k != "rsids") | (k.isin(*_REMOVED) if level > 2 else F.lit(False))
    kept = F.map_filter(props, lambda k, v: ~gone(k))
    if level == 1:
        return kept
    value = lambda k, v: F.when(k == "author", F.lit(author)).when(k.isin(*_EMPTIED) if level > 2 else F.lit(False), F.lit("")).otherwise(v)
    return F.transform_values(kept, value)
