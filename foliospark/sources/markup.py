"""Markdown and HTML in and out, CSV tables, and split documents.

The Markdown reader is line-based: headings, list items, quotes, table rows, code
fences and paragraphs, with running block numbers; inline marks are kept as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.operators import ordered


def markdown_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, ord, kind, level and text of each line of a Markdown text; lines inside code fences are code."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.regexp_replace(text, "^﻿", ""), "\n")).alias("ord", "line"))
    fence = F.startswith("line", F.lit("```"))
    lines = lines.withColumn("fences", F.sum(fence.cast("int")).over(W.partitionBy("doc_id").orderBy("ord")))
    line = F.col("line")
    hashes = F.length(F.regexp_extract(line, "^(#{1,6}) ", 1))
    kind = (
        F.when(fence, "fence").when(F.col("fences") % 2 == 1, "code").when(hashes > 0, "heading").when(F.trim(line) == "", "blank")
        .when(F.regexp_like(line, F.lit(r"^ *([-*+]|[0-9]+[.]) ")), "list").when(F.startswith(line, F.lit(">")), "quote").when(F.regexp_like(line, F.lit(r"^ *\|.*\| *$")), "table").otherwise("paragraph")
    )
    plain = F.regexp_replace(line, r"^(#{1,6} | *([-*+]|[0-9]+[.]) |> ?)", "")
    return lines.select(
        "doc_id", F.col("ord").cast("long").alias("ord"), kind.alias("kind"), F.when(kind == "heading", hashes).alias("level"),
        F.when(kind.isin("heading", "list", "quote"), plain).otherwise(line).alias("text"),
    )


def markdown_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Lines of the same kind in a row as one block; blank lines end blocks, headings and list items stand alone."""
    lines = markdown_lines(docs, text)
    by = W.partitionBy("doc_id").orderBy("ord")
    joins = (F.col("kind") == F.lag("kind").over(by)) & ~F.col("kind").isin("heading", "list")
    numbered = lines.withColumn("block", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(by)).where("kind <> 'blank'")
    return numbered.groupBy("doc_id", "block", "kind").agg(
        F.min("level").alias("level"), F.count("*").alias("n_lines"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text")
    )


def to_markdown(kind: Column, level: Column, text: Column) -> Column:
    """One node as a Markdown line: headings up to level 3, any list as dashes."""
    mark = F.when((kind == "heading") & level.between(1, 3), F.concat(F.repeat(F.lit("#"), F.least(level, F.lit(3))), F.lit(" "))).when(kind.isin("list", "list_paragraph"), F.lit("- ")).otherwise(F.lit(""))
    return F.concat(mark, text)


def escape_html(text: Column) -> Column:
    """A text with the characters that HTML reserves written as references."""
    for plain, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(ref))
    return text


# The element of each kind.
_ELEMENTS = {"heading": "h1", "paragraph": "p", "list_paragraph": "li", "hyperlink": "a", "run": "b"}


def to_html(nodes: DataFrame) -> DataFrame:
    """Per document the HTML of its nodes in order."""
    tag = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _ELEMENTS.items() for x in kv]), F.col("kind")), F.lit("div"))
    piece = F.concat(F.lit("<"), tag, F.lit(">"), escape_html(F.coalesce("text", F.lit(""))), F.lit("</"), tag, F.lit(">"))
    parts = nodes.select("doc_id", F.struct("ord", piece.alias("html")).alias("x")).groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return parts.select("doc_id", F.array_join(F.transform("xs", lambda x: x["html"]), "").alias("html"))


def csv_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows of CSV texts without quotes, one per line that isn't empty, padded to the widest row of their document."""
    rows = docs.select("doc_id", F.posexplode(F.split(text, "\n")).alias("row", "line")).where("line <> ''")
    cells = rows.select("doc_id", F.col("row").cast("long").alias("row"), F.split("line", ",").alias("cells"))
    width = F.max(F.size("cells")).over(W.partitionBy("doc_id"))
    return cells.withColumn("width", width).withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells"))))


#: A separator and the field behind it; a field that begins with a quote ends at the quote that isn't doubled, whatever lies between.
_FIELD = r"""(,|\r\n|\n|\r)("[^"]*+(?:""[^"]*+)*+(?:"[^,\r\n]*+)?|[^,\r\n]*+)"""
_QUOTED = r"""(?s)^"([^"]*+(?:""[^"]*+)*+)(?:"(.*))?$"""


def csv_cells(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, row, column, value) of CSV texts, from 0: quoted commas, quotes and line ends belong to their field.

    Rows end with a line feed, a carriage return or both; one at the end opens no row. A quote inside a field that doesn't begin with one is a
    character like others, what stands behind a closing quote is added as it is, and a quote that never closes reaches to the end. An
    empty line is a row without cells, null and empty texts have no rows.
    """
    marked = F.concat(F.lit("\n"), F.col(text))
    pick = lambda k: F.regexp_extract_all(marked, F.lit(_FIELD), k)
    rows = docs.where(F.length(text) > 0).select("doc_id", F.posexplode(F.arrays_zip(pick(1).alias("mark"), pick(2).alias("raw"))).alias("i", "x"))
    by = W.partitionBy("doc_id").orderBy("i")
    rows = rows.select("doc_id", "i", F.col("x.mark").alias("mark"), F.col("x.raw").alias("raw")).withColumn("row", F.sum((F.col("mark") != ",").cast("long")).over(by) - 1)
    alone = (F.col("mark") != ",") & F.coalesce(F.lead("mark").over(by) != ",", F.lit(True)) & (F.col("raw") == "")
    quoted = F.startswith("raw", F.lit('"'))
    value = F.when(quoted, F.concat(F.replace(F.regexp_extract("raw", _QUOTED, 1), F.lit('""'), F.lit('"')), F.regexp_extract("raw", _QUOTED, 2))).otherwise(F.col("raw"))
    column = F.row_number().over(W.partitionBy("doc_id", "row").orderBy("i")) - 1
    return rows.withColumns({"alone": alone, "value": value}).where(~F.col("alone")).select("doc_id", "row", column.cast("long").alias("column"), "value")


def write_sections(rows: DataFrame, is_heading: Column, path: str) -> None:
    """Split documents at headings: one folder per document and section, text before the first heading as section 0."""
    ordered.sections(rows, is_heading).write.partitionBy("doc_id", "section").mode("overwrite").parquet(path)
