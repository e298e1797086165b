"""Mail-merge schema plans: which source column every field of a document takes, and what keeps a document from being merged.

Tables are keyed by ``doc_id``: fields (field, field_type, target, complete, deleted, control_ok), columns (ordinal, name) of the
data source, mappings (mapping, mapped_name, source_column) and configured documents. A field's target goes through the one mapping of its name, if
there is one, to the column it requires; that is found exactly or, where only one column has it, whatever its case.

A binding is ``ResolvedExact``, ``ResolvedCaseInsensitive``, ``Missing``, ``Ambiguous`` or, for fields that take no column, ``NotApplicable``. It blocks
its document with reasons where it can't be carried out; columns that repeat or collide and a missing configuration block it too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fields that take a column, and those that only count or step through records.
WITH_COLUMN, STEPS = ("MERGEFIELD", "MERGEBARCODE", "NEXTIF", "SKIPIF"), ("MERGEREC", "MERGESEQ", "NEXT")


def bindings(fields: DataFrame, columns: DataFrame, mappings: DataFrame) -> DataFrame:
    """(doc_id, field, field_type, required, ordinal, column, status, blocking, reasons) of every field."""
    named = columns.groupBy("doc_id", "name").agg(F.min("ordinal").alias("exact"))
    loose = columns.groupBy("doc_id", F.lower("name").alias("low")).agg(F.count("*").alias("n_loose"), F.min(F.struct("ordinal", "name")).alias("only"))
    mapped = mappings.groupBy("doc_id", F.col("mapped_name").alias("target")).agg(F.count("*").alias("n_mappings"), F.first("source_column", ignorenulls=True).alias("source"))
    rows = fields.join(mapped, ["doc_id", "target"], "left")
    rows = rows.withColumn("required", F.when(F.col("n_mappings") == 1, F.coalesce("source", "target")).otherwise(F.col("target")))
    rows = rows.join(named.withColumnRenamed("name", "required"), ["doc_id", "required"], "left").withColumn("low", F.lower("required")).join(loose, ["doc_id", "low"], "left")
    kind, control = F.col("field_type"), F.col("field_type").isin("NEXTIF", "SKIPIF")
    blank = F.coalesce(F.trim("required") == "", F.lit(True))
    # the first case that applies, as (condition, status, reason)
    cases = [
        (kind.isin(*STEPS), "NotApplicable", F.when(~F.col("control_ok"), "mail_merge_control_syntax_invalid")), (kind == "IF", "NotApplicable", F.lit("conditional_mail_merge_if_unmodeled")),
        (~kind.isin(*WITH_COLUMN), "NotApplicable", F.lit("unsupported_mail_merge_control_fields")), (control & ~F.col("control_ok"), "Missing", F.lit("mail_merge_control_syntax_invalid")),
        (F.col("n_mappings") > 1, "Ambiguous", F.lit("ambiguous_odso_mapping")), (blank, "Missing", F.lit("source_column_name_missing")), (F.col("exact").isNotNull(), "ResolvedExact", F.lit(None)),
        (F.col("n_loose") == 1, "ResolvedCaseInsensitive", F.lit(None)), (F.col("n_loose") > 1, "Ambiguous", F.lit("source_column_ambiguous")), (F.lit(True), "Missing", F.lit("source_column_missing")),
    ]
    status, reason = F, F
    for when, s, r in cases:
        status, reason = status.when(when, s), reason.when(when, r.cast("string"))
    rows = rows.withColumns({"status": status, "reason": reason})
    taken = F.when(F.col("status") == "ResolvedExact", F.struct(F.col("exact").alias("ordinal"), F.col("required").alias("name"))).when(F.col("status") == "ResolvedCaseInsensitive", F.col("only"))
    every = F.array("reason", F.when(~F.col("complete"), "incomplete_mail_merge_fields"), F.when(F.col("deleted"), "deleted_mail_merge_fields"))
    rows = rows.withColumns({"taken": taken, "reasons": F.array_sort(F.filter(every, lambda x: x.isNotNull()))})
    shown = F.when(F.col("status") != "NotApplicable", F.col("required"))
    return rows.select("doc_id", "field", "field_type", shown.alias("required"), F.col("taken.ordinal").alias("ordinal"), F.col("taken.name").alias("column"), "status", (F.size("reasons") > 0).alias("blocking"), "reasons")


def column_issues(columns: DataFrame) -> DataFrame:
    """(doc_id, ordinal, reason): columns that repeat an earlier one, and all of those that differ by case alone or repeat."""
    by = W.partitionBy("doc_id", "name").orderBy("ordinal")
    rows = columns.withColumns({"again": F.row_number().over(by) > 1, "alike": F.count("*").over(W.partitionBy("doc_id", F.lower("name"))) > 1})
    each = F.filter(F.array(F.when(F.col("again"), "source_schema_duplicate_column"), F.when(F.col("alike"), "source_schema_case_collision")), lambda x: x.isNotNull())
    return rows.select("doc_id", "ordinal", F.explode(each).alias("reason"))


def plans(bound: DataFrame, columns: DataFrame, configured: DataFrame) -> DataFrame:
    """(doc_id, can_bind, reasons, n_fields, n_resolved, n_unused) of every document with fields: reasons are sorted; unused columns are those that no field takes."""
    unset = bound.select("doc_id").distinct().join(configured.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("reason", F.lit("mail_merge_configuration_missing"))
    reasons = bound.select("doc_id", F.explode("reasons").alias("reason")).unionByName(column_issues(columns).select("doc_id", "reason")).unionByName(unset)
    blocked = reasons.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))
    used = bound.where("ordinal is not null").select("doc_id", "ordinal").distinct()
    unused = columns.join(used, ["doc_id", "ordinal"], "left_anti").groupBy("doc_id").agg(F.count("*").alias("n_unused"))
    out = bound.groupBy("doc_id").agg(F.count("*").alias("n_fields"), F.count("ordinal").alias("n_resolved")).join(blocked, "doc_id", "left").join(unused, "doc_id", "left")
    return out.select("doc_id", F.col("reasons").isNull().alias("can_bind"), F.coalesce("reasons", F.lit("")).alias("reasons"), "n_fields", "n_resolved", F.coalesce("n_unused", F.lit(0)).alias("n_unused"))
