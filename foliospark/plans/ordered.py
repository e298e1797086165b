"""Queries of ordered computations: outlines, lists, grids, sections, sorting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions import numerals
from foliospark.operators import ordered as o
from foliospark.sources import table


_TIES = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def _lines(spark, sf_dir):
    """Lines of orders with a place of their own: line numbers repeat within an order."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.withColumn("ord", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*_TIES)).cast("long"))


def _headings(spark, sf_dir):
    """Lines of an order stand in for headings: the level is 1 to 4 by part."""
    return _lines(spark, sf_dir).select(F.col("l_orderkey").alias("doc_id"), "ord", (1 + F.col("l_partkey") % 4).cast("int").alias("level"))


def outline_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent, neighbours and issues of every heading."""
    return o.outline(_headings(spark, sf_dir))


def outline_issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outline issues by kind."""
    return o.outline(_headings(spark, sf_dir)).where("issue is not null").groupBy("issue").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("documents"))


def heading_level_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings that skip a level, the first one excepted."""
    return o.level_audit(_headings(spark, sf_dir))


def list_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multi-level list counters."""
    return o.list_counters(_headings(spark, sf_dir))


def list_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered labels by level: decimal, letters, Roman numerals, padded decimals."""
    rows = o.list_counters(_headings(spark, sf_dir))
    forms = {1: ("%1.", "decimal"), 2: ("(%1)", "lowerLetter"), 3: ("%1)", "lowerRoman"), 4: ("%1", "decimalZero")}
    text = F.lit(None).cast("string")
    for level, (template, form) in forms.items():
        text = F.when(F.col("level") == level, numerals.label(F.lit(template), [numerals.counter(F.col("counter"), form)])).otherwise(text)
    return rows.select("doc_id", "ord", "level", text.alias("label"))


def counter_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys in all counter formats."""
    n = F.col("o_orderkey")
    forms = ("decimalZero", "upperRoman", "lowerRoman", "upperLetter", "lowerLetter")
    return table(spark, sf_dir, "orders").select(n, *[numerals.counter(n, f).alias(f) for f in forms])


def grid_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid columns of table cells: a line is a cell, its span is 1 to 3."""
    cells = _lines(spark, sf_dir).select(
        F.col("l_orderkey").alias("row"), F.col("ord").alias("cell"), (1 + F.col("l_suppkey") % 3).cast("long").alias("span"), (F.col("l_orderkey") % 2).alias("grid_before")
    )
    return o.grid(cells, ["row"], "cell", "span", "grid_before").select("row", "cell", "start_col", "end_col")


def table_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest row of each table; a customer's orders form its table."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    cells = grid_positions(spark, sf_dir).join(orders, F.col("row") == F.col("o_orderkey"))
    return cells.groupBy(F.col("o_custkey").alias("table_id")).agg(F.max("end_col").alias("width"), F.countDistinct("row").alias("n_rows"))


def header_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header rows that count: declared ones in the first unbroken run."""
    rows = _lines(spark, sf_dir).select("l_orderkey", "ord", (F.col("l_returnflag") != "N").alias("declared"))
    return o.header_prefix(rows, "l_orderkey", "ord", "declared")


def merge_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertical merge chains over the rows of a user's events, by kind of event."""
    cells = table(spark, sf_dir, "events").select("user_id", "event_type", (F.col("event_id") % 1000).alias("row"), (F.col("event_id") % 7 == 0).alias("restart"), "event_id")
    cells = cells.groupBy("user_id", "event_type", "row").agg(F.bool_or("restart").alias("restart"))
    return o.merge_islands(cells, ["user_id", "event_type"], "row", "restart")


def section_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A section's binding, or the last one before it: purchases bind a value, other events inherit it."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", F.col("value")).alias("binding"))
    return rows.withColumn("effective", o.inherit(rows, "user_id", "event_id", "binding"))


def sections_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by section: a user's turn opens one; what is before belongs to section 0."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("ord"), "role", "text")
    return o.sections(turns, F.col("role") == "user").groupBy("doc_id", "section").agg(F.count("*").alias("n_turns"), F.sum(F.length("text")).cast("long").alias("chars"))


def unique_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of turns as split documents, from their first two words, made unique."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", o.slug(F.substring_index("text", " ", 2)).alias("name"))
    return o.unique_names(rows, "name", ["conv_id", "turn"])


def change_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions followed by an insertion as replacements, counted by user."""
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id", F.when(F.col("event_type") == "click", "del").when(F.col("event_type") == "view", "ins").otherwise("keep").alias("kind")
    )
    return o.pair_changes(rows, "user_id", "event_id", "kind").groupBy("user_id", "change").agg(F.count("*").alias("n"))


def sort_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each order sorted by a text column, header rows first, ties stable, descending."""
    rows = _lines(spark, sf_dir).select("l_orderkey", "ord", "l_returnflag")
    return o.sort_table(rows, "l_orderkey", F.col("ord") == 1, "l_returnflag", "ord", descending=True)


_LI = f"li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_TIES)}) AS ord FROM lineitem)"
_H = f"{_LI}, h AS (SELECT l_orderkey AS doc_id, ord, CAST(1 + l_partkey % 4 AS INTEGER) AS level FROM li)"
_W = "OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_OUTLINE = f"""{_H},
a AS (SELECT *, {", ".join(f"max(CASE WHEN level = {k} THEN ord END) {_W} AS l{k}" for k in range(1, 4))},
             lag(level) OVER (PARTITION BY doc_id ORDER BY ord) AS pl, lag(ord) OVER (PARTITION BY doc_id ORDER BY ord) AS prev_ord,
             lead(ord) OVER (PARTITION BY doc_id ORDER BY ord) AS next_ord FROM h),
o AS (SELECT doc_id, ord, level, greatest({", ".join(f"CASE WHEN level > {k} THEN l{k} END" for k in range(1, 4))}) AS parent_ord, prev_ord, next_ord,
             CASE WHEN pl IS NULL AND level > 1 THEN 'OUTLINE_FIRST_LEVEL_SKIPPED' WHEN level > pl + 1 THEN 'OUTLINE_LEVEL_SKIPPED' END AS issue FROM a)"""
_COUNTERS = f"""{_H},
g AS (SELECT x.*, CAST((SELECT count(*) FROM h y WHERE y.doc_id = x.doc_id AND y.ord <= x.ord AND y.level < x.level) AS BIGINT) AS "group" FROM h x),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, level, "group" ORDER BY ord) AS counter FROM g)"""


def _roman(n):
    places = [["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"],
              ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"], ["", "M", "MM", "MMM"]]
    digit = lambda k: f"{places[k]}[({n} // {10 ** k}) % 10 + 1]"
    return f"CASE WHEN {n} BETWEEN 1 AND 3999 THEN {digit(3)} || {digit(2)} || {digit(1)} || {digit(0)} END"


_LETTERS = """x AS (
  SELECT o_orderkey AS n, o_orderkey AS r, '' AS s FROM orders
  UNION ALL SELECT n, (r - 1) // 26, chr(CAST(65 + (r - 1) % 26 AS INTEGER)) || s FROM x WHERE r > 0),
l AS (SELECT n, s FROM x WHERE r = 0 AND n BETWEEN 1 AND 1000000)"""

QUERIES = {
    f.__name__: f
    for f in (
        outline_hierarchy, outline_issue_counts, heading_level_audit, list_counters, list_labels, counter_formats, grid_positions, table_widths,
        header_prefix, merge_islands, section_inheritance, sections_running, unique_file_names, change_pairing, sort_table,
    )
}
_GRID = _LI + """, c AS (SELECT l_orderkey AS row, ord AS cell, CAST(1 + l_suppkey % 3 AS BIGINT) AS span, l_orderkey % 2 AS b FROM li),
g AS (SELECT row, cell, CAST(coalesce(sum(span) OVER (PARTITION BY row ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + b AS BIGINT) AS start_col, span FROM c)"""
ORACLES = {
    "outline_hierarchy": f"WITH {_OUTLINE} SELECT * FROM o",
    "outline_issue_counts": f"WITH {_OUTLINE} SELECT issue, count(*) AS n, count(DISTINCT doc_id) AS documents FROM o WHERE issue IS NOT NULL GROUP BY issue",
    "heading_level_audit": f"WITH {_H}, a AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY ord) AS previous FROM h) SELECT * FROM a WHERE previous > 0 AND level > previous + 1",
    "list_counters": f"WITH {_COUNTERS} SELECT * FROM c",
    "list_labels": f"""WITH {_COUNTERS} SELECT doc_id, ord, level, CASE level WHEN 1 THEN counter || '.' WHEN 2 THEN '(' || chr(CAST(96 + counter AS INTEGER)) || ')'
WHEN 3 THEN lower({_roman("counter")}) || ')' ELSE CASE WHEN counter < 10 THEN '0' || counter ELSE CAST(counter AS VARCHAR) END END AS label FROM c""",
    "counter_formats": f"""WITH RECURSIVE {_LETTERS}
SELECT o_orderkey, CASE WHEN o_orderkey < 10 THEN '0' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END AS decimalZero, {_roman("o_orderkey")} AS upperRoman,
       lower({_roman("o_orderkey")}) AS lowerRoman, l.s AS upperLetter, lower(l.s) AS lowerLetter
FROM orders LEFT JOIN l ON l.n = o_orderkey""",
    "grid_positions": f"WITH {_GRID} SELECT row, cell, start_col, start_col + span AS end_col FROM g",
    "table_widths": f"WITH {_GRID} SELECT o_custkey AS table_id, max(start_col + span) AS width, count(DISTINCT row) AS n_rows FROM g JOIN orders ON row = o_orderkey GROUP BY o_custkey",
    "header_prefix": f"""WITH {_LI} SELECT l_orderkey, ord, l_returnflag <> 'N' AS declared,
  min(CAST(l_returnflag <> 'N' AS INTEGER)) OVER (PARTITION BY l_orderkey ORDER BY ord ROWS UNBOUNDED PRECEDING) = 1 AS effective_header FROM li""",
    "merge_islands": """WITH c AS (SELECT user_id, event_type, event_id % 1000 AS row, bool_or(event_id % 7 = 0) AS restart FROM events GROUP BY ALL),
l AS (SELECT *, lag(row) OVER (PARTITION BY user_id, event_type ORDER BY row) AS p FROM c),
i AS (SELECT *, sum(CASE WHEN restart OR p IS NULL OR row <> p + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY row ROWS UNBOUNDED PRECEDING) AS island FROM l)
SELECT user_id, event_type, CAST(island AS BIGINT) AS island, min(row) AS first_row, max(row) AS last_row, count(*) AS n_rows,
       CASE WHEN min_by(restart, row) THEN 'CHAIN' ELSE 'ORPHAN_CONTINUATION' END AS status FROM i GROUP BY user_id, event_type, island""",
    "section_inheritance": """WITH r AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN value END AS binding FROM events)
SELECT *, last_value(binding IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS effective FROM r""",
    "sections_running": """WITH s AS (SELECT conv_id AS doc_id, text, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM conversations)
SELECT doc_id, section, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM s GROUP BY doc_id, section""",
    "unique_file_names": """WITH s AS (SELECT conv_id, turn, substring(regexp_replace(regexp_replace(lower(array_to_string(string_split(text, ' ')[1:2], ' ')), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g'), 1, 40) AS name FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY conv_id, turn) - 1 AS n FROM s)
SELECT conv_id, turn, name, CASE WHEN n = 0 THEN name ELSE name || '_' || n END AS file_name FROM r""",
    "change_pairing": """WITH k AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'del' WHEN 'view' THEN 'ins' ELSE 'keep' END AS kind FROM events),
n AS (SELECT *, lead(kind) OVER w AS nx, lag(kind) OVER w AS pv FROM k WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
c AS (SELECT user_id, CASE WHEN kind = 'del' AND nx = 'ins' THEN 'replacement' WHEN kind = 'ins' AND pv = 'del' THEN 'paired' ELSE kind END AS change FROM n)
SELECT user_id, change, count(*) AS n FROM c WHERE change <> 'paired' GROUP BY user_id, change""",
    "sort_table": f"""WITH {_LI} SELECT l_orderkey, ord, l_returnflag, row_number() OVER (PARTITION BY l_orderkey
  ORDER BY CASE WHEN ord = 1 THEN 0 ELSE 1 END, CASE WHEN ord = 1 THEN '' ELSE l_returnflag END DESC, ord) - 1 AS new_row FROM li""",
}
