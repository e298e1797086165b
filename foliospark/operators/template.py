"""Templates, binding plans, conditions, and table formulas."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def validate_tags(tags: DataFrame, keys: DataFrame) -> DataFrame:
    """Tags of a template without data (missing) and data without a tag (extra)."""
    t, k = tags.select("tag").distinct(), keys.select("tag").distinct()
    return t.join(k, "tag", "left_anti").withColumn("status", F.lit("missing")).unionByName(k.join(t, "tag", "left_anti").withColumn("status", F.lit("extra")))


def fill(controls: DataFrame, data: DataFrame) -> DataFrame:
    """Controls (doc_id, ord, tag, text) filled with values (tag, i, value): the first in place, others as clones behind it."""
    rows = controls.join(data, "tag", "left")
    return rows.select("doc_id", "ord", F.coalesce("i", F.lit(0)).alias("clone"), "tag", F.coalesce("value", "text").alias("text"), F.col("value").isNotNull().alias("filled"))


def bind_columns(fields: DataFrame, columns: DataFrame) -> DataFrame:
    """Fields (field) bound to columns (name): exact first, else regardless of case if just one matches."""
    exact = columns.groupBy(F.col("name").alias("field")).agg(F.count("*").alias("n_exact"))
    loose = columns.groupBy(F.lower("name").alias("low")).agg(F.count("*").alias("n_loose"), F.min("name").alias("only"))
    rows = fields.join(exact, "field", "left").join(loose, F.lower("field") == F.col("low"), "left")
    status = (
        F.when(F.col("n_exact") == 1, "ResolvedExact").when(F.col("n_exact") > 1, "Ambiguous")
        .when(F.col("n_loose") == 1, "ResolvedCaseInsensitive").when(F.col("n_loose") > 1, "Ambiguous").otherwise("Missing")
    )
    bound = F.when(status == "ResolvedExact", F.col("field")).when(status == "ResolvedCaseInsensitive", F.col("only"))
    return rows.select("field", status.alias("status"), bound.alias("column"))


def condition(text: str) -> tuple[str, Column]:
    """A record control ``NEXTIF|SKIPIF column op value`` as (kind, Column); exactly four tokens."""
    parts = text.split()
    if len(parts) != 4 or parts[0] not in ("NEXTIF", "SKIPIF"):
        raise ValueError("a condition is NEXTIF or SKIPIF, a column, an operator and a value")
    kind, left, op, right = parts
    value = right.strip('"')
    try:
        literal = F.lit(float(value))
    except ValueError:
        literal = F.lit(value)
    c = F.col(left)
    ops = {"=": c == literal, "<>": c != literal, "<": c < literal, ">": c > literal, "<=": c <= literal, ">=": c >= literal}
    if op not in ops:
        raise ValueError(f"unknown operator {op}")
    return kind, ops[op]


def skip_records(rows: DataFrame, text: str) -> DataFrame:
    """Records that a SKIPIF condition leaves."""
    kind, c = condition(text)
    if kind != "SKIPIF":
        raise ValueError("only SKIPIF leaves records out")
    return rows.where(~F.coalesce(c, F.lit(False)))


#: What a formula may compute over the cells that a direction names.
FORMULAS = {
    "SUM": F.sum, "AVERAGE": F.avg, "COUNT": F.count, "MAX": F.max, "MIN": F.min, "PRODUCT": F.product,
}


def formula(name: str, value: Column, table: list[str], order: str, direction: str = "ABOVE") -> Column:
    """SUM, AVERAGE, COUNT, MAX, MIN or PRODUCT of the cells ABOVE or BELOW in the same column (``table`` names it), or LEFT or RIGHT in the same row."""
    if direction not in ("ABOVE", "BELOW", "LEFT", "RIGHT"):
        raise ValueError(f"{direction!r} is no direction")
    way = F.asc(order) if direction in ("ABOVE", "LEFT") else F.desc(order)  # a running aggregate either way
    return FORMULAS[name](value).over(W.partitionBy(*table).orderBy(way).rowsBetween(W.unboundedPreceding, -1))


def to_csv_line(columns: list[str]) -> Column:
    """One CSV line; fields with a comma, quote or line end are quoted."""
    def field(c):
        s = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(F.regexp_like(s, F.lit('[,"\n\r]')), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)

    return F.concat_ws(",", *[field(c) for c in columns])


_CELL = re.compile(r"([A-Z]{1,4})([1-9][0-9]{0,5})")


def cell(ref: str) -> tuple[int, int]:
    """(row, column), from 1, of a reference such as B3."""
    if not (m := _CELL.fullmatch(ref)):
        raise ValueError(f"{ref!r} is no cell")
    column = 0
    for ch in m[1]:
        column = 26 * column + ord(ch) - 64
    return int(m[2]), column


def range_formula(cells: DataFrame, name: str, ref: str, table: str, row: str, column: str, value: str) -> DataFrame:
    """(table, result) of SUM, AVERAGE, COUNT, MIN, MAX or PRODUCT over a range such as A1:B3, or one cell, of every table.

    Cells without a number don't count; a range without any gives null, COUNT 0.
    """
    first, _, last = ref.partition(":")
    (r0, c0), (r1, c1) = cell(first), cell(last or first)
    inside = F.col(row).between(min(r0, r1), max(r0, r1)) & F.col(column).between(min(c0, c1), max(c0, c1))
    if name not in FORMULAS:
        raise ValueError(f"{name!r} is no formula")
    return cells.groupBy(table).agg(FORMULAS[name](F.when(inside, F.col(value))).alias("result"))
