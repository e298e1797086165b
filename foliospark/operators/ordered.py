"""Ordered computations over rows of a document, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEVELS = 9


def outline(headings: DataFrame, doc="doc_id", order="ord", level="level") -> DataFrame:
    """Parent, previous and next heading, and outline issues.

    The parent is the most recent earlier heading of a smaller level: of the last
    heading of each level, the latest one above the current level.
    """
    before = W.partitionBy(doc).orderBy(order)
    upto = before.rowsBetween(W.unboundedPreceding, -1)
    lasts = [F.max(F.when(F.col(level) == k, F.col(order))).over(upto) for k in range(1, LEVELS)]
    above = [F.when(F.col(level) > k, last) for k, last in enumerate(lasts, 1)]
    previous = F.lag(level).over(before)
    issue = (
        F.when(previous.isNull() & (F.col(level) > 1), F.lit("OUTLINE_FIRST_LEVEL_SKIPPED"))
        .when(F.col(level) > previous + 1, F.lit("OUTLINE_LEVEL_SKIPPED"))
    )
    return headings.withColumns({
        "parent_ord": F.greatest(*above), "prev_ord": F.lag(order).over(before), "next_ord": F.lead(order).over(before), "issue": issue,
    })


def level_audit(headings: DataFrame, doc="doc_id", order="ord", level="level") -> DataFrame:
    """Headings that skip a level; the first one never counts."""
    previous = F.lag(level).over(W.partitionBy(doc).orderBy(order))
    return headings.withColumn("previous", previous).where((F.col("previous") > 0) & (F.col(level) > F.col("previous") + 1))


def list_counters(items: DataFrame, doc="doc_id", order="ord", level="level") -> DataFrame:
    """Counters of a multi-level list that starts at 1 and restarts below a higher level.

    ``counter`` is the item's own number; ``group`` counts the higher-level items
    before it, which is what it restarts on.
    """
    rows = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    groups = F.lit(0)
    for k in range(1, LEVELS + 1):
        groups = F.when(F.col(level) == k, F.sum(F.when(F.col(level) < k, 1).otherwise(0)).over(rows)).otherwise(groups)
    grouped = items.withColumn("group", groups.cast("long"))
    own = W.partitionBy(doc, level, "group").orderBy(order)
    return grouped.withColumn("counter", F.row_number().over(own).cast("long"))


def grid(cells: DataFrame, row: list[str], order: str, span: str, before: str | None = None) -> DataFrame:
    """Start and exclusive end columns of cells with spans."""
    earlier = W.partitionBy(*row).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(span).over(earlier), F.lit(0)) + (F.col(before) if before else F.lit(0))
    return cells.withColumn("start_col", start.cast("long")).withColumn("end_col", (F.col("start_col") + F.col(span)).cast("long"))


def header_prefix(rows: DataFrame, table: str, order: str, declared: str) -> DataFrame:
    """Declared header rows that count: those in the unbroken run from the first row."""
    upto = W.partitionBy(table).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("effective_header", F.min(F.col(declared).cast("int")).over(upto) == 1)


def merge_islands(cells: DataFrame, table: list[str], row: str, restart: str) -> DataFrame:
    """Vertical merge chains by (table, grid range): an island starts at a restart or where a row is missing."""
    by = W.partitionBy(*table).orderBy(row)
    new = (F.col(restart) | F.lag(row).over(by).isNull() | (F.col(row) != F.lag(row).over(by) + 1)).cast("int")
    marked = cells.withColumn("island", F.sum(new).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return (
        marked.groupBy(*table, "island")
        .agg(F.min(row).alias("first_row"), F.max(row).alias("last_row"), F.count("*").alias("n_rows"), F.min_by(restart, row).alias("starts"))
        .withColumn("status", F.when(F.col("starts"), F.lit("CHAIN")).otherwise(F.lit("ORPHAN_CONTINUATION")))
        .drop("starts")
    )


def inherit(rows: DataFrame, doc: str, order: str, value: str) -> Column:
    """A value, or the last one before it."""
    return F.last(value, ignorenulls=True).over(W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, 0))


def sections(rows: DataFrame, is_heading: Column, doc="doc_id", order="ord") -> DataFrame:
    """Running section numbers; what stands before the first heading is section 0."""
    run = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("section", F.sum(is_heading.cast("int")).over(run).cast("long"))


def slug(title: Column, most: int = 40) -> Column:
    """A file name from a title: lower-case letters and digits, others as one underscore."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "_"), "^_|_$", ""), 1, most)


def unique_names(rows: DataFrame, name: str, order: list[str], width: int = 4096) -> DataFrame:
    """File names made unique by _1, _2 and so on, in order.

    A name's rows are numbered inside blocks of ``width`` values of the first order column, and only the blocks' sizes are
    added up by name, so a name that many rows share is no single task.
    """
    block = F.floor(F.col(order[0]) / width)
    held = rows.withColumn("_block", block)
    sizes = held.groupBy(name, "_block").agg(F.count("*").alias("_n"))
    before = sizes.select(name, "_block", (F.sum("_n").over(W.partitionBy(name).orderBy("_block")) - F.col("_n")).alias("_before"))
    placed = held.withColumn("_at", F.row_number().over(W.partitionBy(name, "_block").orderBy(*order)) - 1).join(before, [name, "_block"])
    n = F.col("_at") + F.col("_before")
    return placed.select(*[rows[c] for c in rows.columns], F.when(n == 0, F.col(name)).otherwise(F.concat(name, F.lit("_"), n.cast("string"))).alias("file_name"))


def pair_changes(changes: DataFrame, doc: str, order: str, kind: str) -> DataFrame:
    """A deletion directly followed by an insertion is one replacement."""
    by = W.partitionBy(doc).orderBy(order)
    nxt, prev = F.lead(kind).over(by), F.lag(kind).over(by)
    paired = F.when((F.col(kind) == "del") & (nxt == "ins"), "replacement").when((F.col(kind) == "ins") & (prev == "del"), "paired").otherwise(F.col(kind))
    return changes.withColumn("change", paired).where("change <> 'paired'")


def sort_table(rows: DataFrame, table: str, header: Column, key: str, order: str, descending=False) -> DataFrame:
    """New row places: header rows first as they were, the others by text, ties as they were."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    by = W.partitionBy(table).orderBy((~header).cast("int"), F.when(header, F.lit("")).otherwise(text).desc() if descending else F.when(header, F.lit("")).otherwise(text), order)
    return rows.withColumn("new_row", (F.row_number().over(by) - 1).cast("long"))
