"""Table grids: columns of cells with spans, vertical merges over rows, and what is wrong with them.

Tables are (table, grid_columns), rows (table, row, grid_before, grid_after, header) with rows counted from 0, cells (table, row, cell, span, merge)
in order of ``cell``, with ``merge`` restart, continue or null. A merge is a chain of cells with the same first and last column in rows that
follow each other, opened by a restart. A continuation without a chain above it has an issue: ``VERTICAL_MERGE_SPAN_MISMATCH`` where a chain above covers some
of its columns, ``VERTICAL_MERGE_ORPHAN_CONTINUATION`` where none does; it opens no chain itself.

Spans that aren't 1 to ``MOST_SPAN`` count as 1 and columns left out that are negative as 0, each with an issue. All of it is windows over
rows and over columns of equal places; no pair of cells is compared with another.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST_SPAN = 63


def placed_cells(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells with ``start_col``, exclusive ``end_col`` and ``width``, the columns of their row up to its last cell."""
    good = F.col("span").between(1, MOST_SPAN)
    skipped = rows.select("table", "row", F.greatest("grid_before", F.lit(0)).alias("skipped"))
    out = cells.withColumn("width", F.when(good, F.col("span")).otherwise(1).cast("long")).join(skipped, ["table", "row"])
    upto = F.sum("width").over(W.partitionBy("table", "row").orderBy("cell").rowsBetween(W.unboundedPreceding, 0))
    return out.withColumn("end_col", F.col("skipped") + upto).withColumn("start_col", F.col("end_col") - F.col("width")).drop("skipped", "width")


def merge_chains(cells: DataFrame) -> DataFrame:
    """Merged cells (table, row, cell, start_col, end_col, merge) with ``first_row`` of their chain; null for a continuation without one."""
    own = W.partitionBy("table", "start_col", "end_col").orderBy("row")
    merged = cells.where("merge is not null")
    opens = (F.col("merge") == "restart") | F.lag("row").over(own).isNull() | (F.lag("row").over(own) + 1 < F.col("row"))
    marked = merged.withColumn("opens", opens)
    start = F.last(F.when(F.col("opens"), F.struct("row", "merge")), ignorenulls=True).over(own.rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("start", start).withColumn("first_row", F.when(F.col("start.merge") == "restart", F.col("start.row"))).drop("opens", "start")


def unchained(chained: DataFrame) -> DataFrame:
    """(table, row, cell, issue) of the continuations without a chain.

    The chains above a row lie side by side, so of those that begin before a cell ends the last one reaches farthest.
    """
    above = chained.where("first_row is not null").select("table", (F.col("row") + 1).alias("row"), F.lit(None).cast("long").alias("cell"), F.col("start_col").alias("at"), F.lit(1).alias("side"), F.col("end_col").alias("reach"))
    alone = chained.where("first_row is null").select("table", "row", F.col("cell").cast("long").alias("cell"), F.col("end_col").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("reach"), F.col("start_col").alias("own"))
    far = F.max("reach").over(W.partitionBy("table", "row").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0))
    rows = above.withColumn("own", F.lit(None).cast("long")).unionByName(alone).withColumn("far", far).where("side = 0")
    issue = F.when(F.col("far") > F.col("own"), "VERTICAL_MERGE_SPAN_MISMATCH").otherwise("VERTICAL_MERGE_ORPHAN_CONTINUATION")
    return rows.select("table", "row", "cell", issue.alias("issue"))


def chains(chained: DataFrame) -> DataFrame:
    """(table, start_col, end_col, first_row, last_row, n_cells) of the vertical merges."""
    return chained.where("first_row is not null").groupBy("table", "start_col", "end_col", "first_row").agg(F.max("row").alias("last_row"), F.count("*").alias("n_cells"))


def logical_rows(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows with ``columns``, how many they take with those left out before and after."""
    ends = placed.groupBy("table", "row").agg(F.max("end_col").alias("end_col"))
    before, after = (F.greatest(c, F.lit(0)) for c in ("grid_before", "grid_after"))
    return rows.join(ends, ["table", "row"], "left").withColumn("columns", (F.coalesce("end_col", before) + after).cast("long")).drop("end_col")


def issues(tables: DataFrame, rows: DataFrame, cells: DataFrame) -> DataFrame:
    """(table, row, cell, issue) of all that is wrong; ``cell`` is null for what concerns a row."""
    placed = placed_cells(rows, cells)
    wide = logical_rows(rows, placed).join(tables, "table")
    say = lambda df, what, when, cell=None: df.where(when).select("table", "row", (cell if cell is not None else F.lit(None)).cast("long").alias("cell"), F.lit(what).alias("issue"))
    header = F.min(F.col("header").cast("int")).over(W.partitionBy("table").orderBy("row").rowsBetween(W.unboundedPreceding, 0))
    declared = F.col("grid_columns") > 0
    parts = [
        unchained(merge_chains(placed)),
        say(cells, "GRID_SPAN_INVALID", F.col("span").isNotNull() & ~F.col("span").between(1, MOST_SPAN), F.col("cell")),
        say(rows, "GRID_BEFORE_INVALID", "grid_before < 0"), say(rows, "GRID_AFTER_INVALID", "grid_after < 0"),
        say(wide, "ROW_GRID_OVERFLOW", declared & (F.col("columns") > F.col("grid_columns"))), say(wide, "ROW_GRID_UNDERFLOW", declared & (F.col("columns") < F.col("grid_columns"))),
        say(wide, "ROW_GRID_SKIP_OUT_OF_RANGE", declared & (F.greatest("grid_before", "grid_after") > F.col("grid_columns"))),
        say(rows.withColumn("prefix", header), "HEADER_NOT_CONTIGUOUS", "header and prefix = 0"),
    ]
    return reduce(DataFrame.unionByName, parts)
