"""Rule findings over nodes: one table of findings, suppression, roll-ups, signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITY = {"Info": 0, "Warning": 1, "Error": 2, "Fatal": 3}


def finding(rows: DataFrame, rule: str, pack: str, severity: str, subject: Column, when: Column) -> DataFrame:
    """Findings of one rule: doc_id, rule, pack, severity, subject, finding_id."""
    hit = rows.where(when).select(F.col("doc_id"), F.lit(rule).alias("rule"), F.lit(pack).alias("pack"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"))
    key = F.concat_ws("|", "rule", F.col("doc_id").cast("string"), "subject")
    return hit.withColumn("finding_id", F.concat(F.lit("finding_"), F.substring(F.sha2(key, 256), 1, 24)))


def union_findings(*parts: DataFrame) -> DataFrame:
    """All findings as one table."""
    return reduce(DataFrame.unionByName, parts)


def evaluate(findings: DataFrame, packs=None, suppressed_rules=(), suppressed_ids=(), least: str = "Info") -> DataFrame:
    """Findings with their state: off (pack disabled), suppressed, filtered (below the severity), or visible."""
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    off = ~F.col("pack").isin(list(packs)) if packs is not None else F.lit(False)
    hidden = F.col("rule").isin(list(suppressed_rules)) | F.col("finding_id").isin(list(suppressed_ids))
    state = F.when(off, "off").when(hidden, "suppressed").when(F.element_at(rank, F.col("severity")) < SEVERITY[least], "filtered").otherwise("visible")
    return findings.withColumn("state", state)


def rollup(findings: DataFrame) -> DataFrame:
    """Counts by pack, rule, severity and state."""
    return findings.groupBy("pack", "rule", "severity", "state").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def signals(findings: DataFrame, most: int = 12) -> DataFrame:
    """The rules found, most severe first, then by name, cut to ``most`` (1 to 32)."""
    if not 1 <= most <= 32:
        raise ValueError("most is 1 to 32")
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    by_rule = findings.groupBy("rule", "severity").agg(F.count("*").alias("n"))
    return by_rule.orderBy(F.element_at(rank, F.col("severity")).desc(), "rule").limit(most)
