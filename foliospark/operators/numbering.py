"""Multi-level list numbering with start values, restart rules, section restarts and labels, as window expressions.

Definitions have one row per list: ``starts``, ``restarts``, ``formats`` and ``texts`` are arrays by level (0 to 8), ``legal`` an array
of booleans, ``by_section`` says whether numbers start again after a section break. A restart of null means
after any item of a higher level, 0 never, k after items of the first k levels.

A level's number is its start plus the items of that level since its last reset. Both are running
counts over the items of a list, so a list is one window partition and no state is carried by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import numerals

LEVELS = 9
MOST_LABEL = 31  # fixed value: longer labels aren't shown
FORMATS = ("decimal", "decimalZero", "upperRoman", "lowerRoman", "upperLetter", "lowerLetter", "none")


def _formatted(n: Column, form: Column) -> Column:
    """A number in a format given by a column; null where the format is unknown or has no such number."""
    out = F.lit(None).cast("string")
    for name in FORMATS:
        out = F.when(form == name, numerals.counter(n, name)).otherwise(out)
    return out


def numbered(items: DataFrame, definitions: DataFrame, doc="doc_id", order="ord", number="num_id", level="level", breaks="is_break") -> DataFrame:
    """Items (doc, order, number, level, breaks) with ``counter``, ``status``, ``restarted``, ``label`` and ``label_status``.

    ``breaks`` marks rows before which a section ends. Status: Exact, UnresolvedStart (no start or one below 0),
    UnresolvedRestartRule (a rule that names no higher level), MissingDefinition.
    Label status: Exact, Hidden (no text wanted: empty), MissingLevelText, InvalidLevelText (a placeholder below the item's level, or
    more than nine), ReferencedCounterUnresolved, UnsupportedNumberFormat, LengthLimitExceeded.
    """
    section = F.sum(F.col(breaks).cast("int")).over(W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    rows = items.withColumn("_section", section).join(definitions, number, "left")
    rows = rows.withColumn("_part", F.when(F.col("by_section"), F.col("_section")).otherwise(F.lit(0)))
    at = lambda c, k: F.get(F.col(c), F.lit(k) if isinstance(k, int) else k)
    run = W.partitionBy(doc, number, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    own = F.col(level)

    def exact(k):
        start, rule = at("starts", k), at("restarts", k)
        return start.isNotNull() & (start >= 0) & (rule.isNull() | (rule == 0) | rule.between(1, min(7, k)))

    def resets(k):
        rule = at("restarts", k)
        return F.when(rule.isNull(), own < k).when(rule == 0, F.lit(False)).otherwise((own < rule) & (own < k))

    counts = {f"_n{k}": F.count_if(own == k).over(run) for k in range(LEVELS)}
    rows = rows.withColumns(counts)
    # the count of a level never falls, so its last value at a reset is the largest one
    rows = rows.withColumns({f"_r{k}": F.coalesce(F.max(F.when(resets(k), F.col(f"_n{k}"))).over(run), F.lit(0)) for k in range(LEVELS)})
    value = lambda k: F.when(exact(k) & (F.col(f"_n{k}") > F.col(f"_r{k}")), at("starts", k) + F.col(f"_n{k}") - F.col(f"_r{k}") - 1)
    rows = rows.withColumn("_values", F.array(*[value(k) for k in range(LEVELS)]))
    pick = lambda of: F.get(F.array(*[of(k) for k in range(LEVELS)]), own)
    start, rule = F.get("starts", own), F.get("restarts", own)
    rule_ok = rule.isNull() | (rule == 0) | (rule.between(1, 7) & (rule <= own))
    status = (
        F.when(F.col("starts").isNull(), "MissingDefinition").when(start.isNull() | (start < 0), "UnresolvedStart").when(~rule_ok, "UnresolvedRestartRule").otherwise("Exact")
    )
    restarted = (pick(lambda k: F.col(f"_n{k}") - F.col(f"_r{k}")) == 1) & (pick(lambda k: F.col(f"_n{k}")) > 1)
    rows = rows.withColumns({"counter": F.get("_values", own), "status": status, "restarted": F.coalesce(restarted & F.col("starts").isNotNull(), F.lit(False)), "_text": F.get("texts", own)})
    rows = _labelled(rows, own)
    return rows.drop("_section", "_part", "_values", "_text", *[c for c in rows.columns if c.startswith(("_n", "_r", "_used", "_shown", "_plain"))], *[c for c in definitions.columns if c != number])


def _labelled(rows: DataFrame, own: Column) -> DataFrame:
    """``label`` and ``label_status`` from the level's text, with %1 to %9 as numbers of the levels."""
    text = F.col("_text")
    used = F.transform(F.regexp_extract_all(text, F.lit("%([1-9])"), 1), lambda x: x.cast("int") - 1)
    rows = rows.withColumn("_used", used)
    legal = F.coalesce(F.get("legal", own), F.lit(False))
    form = lambda k: F.when(legal, "decimal").otherwise(F.coalesce(F.get("formats", k), F.lit("decimal")))
    # lambdas are written once for all levels, so the plan stays small
    rows = rows.withColumn("_shown", F.transform("_values", lambda v, k: _formatted(v, form(k))))
    number = lambda out, k: F.replace(out, F.concat(F.lit("%"), k.cast("string")), F.coalesce(F.get("_shown", k - 1), F.lit("")))
    rows = rows.withColumn("_plain", F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), text, number))
    missing = lambda c: F.exists("_used", lambda k: F.get(c, k).isNull())
    status = (
        F.when(F.col("starts").isNull() | text.isNull(), "MissingLevelText").when(text == "", "Hidden")
        .when((F.size("_used") > 9) | F.exists("_used", lambda k: k > own), "InvalidLevelText")
        .when((F.size("_used") == 0) & (F.length(text) <= MOST_LABEL), "Exact").when(F.size("_used") == 0, "LengthLimitExceeded")
        .when((F.col("status") != "Exact") | missing(F.col("_values")), "ReferencedCounterUnresolved").when(missing(F.col("_shown")), "UnsupportedNumberFormat")
        .when(F.length("_plain") > MOST_LABEL, "LengthLimitExceeded").otherwise("Exact")
    )
    rows = rows.withColumn("label_status", status)
    return rows.withColumn("label", F.when(F.col("label_status") == "Exact", F.col("_plain")).when(F.col("label_status") == "Hidden", ""))
