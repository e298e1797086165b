"""Queries of nesting, subtrees, references in both directions, sets, maps, merged texts and cell ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions.fields import field_class, field_name, invokes_application, is_external
from foliospark.operators import diff as d
from foliospark.operators import formulas
from foliospark.operators import query as q
from foliospark.operators import styles as st
from foliospark.operators import tables
from foliospark.operators import template as t
from foliospark.operators.protect import sanitise
from foliospark.sources import table
from foliospark.sources.projectors import page_nodes, page_tokens


def page_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent and depth of every node of the pages."""
    return q.with_parents(page_nodes(table(spark, sf_dir, "pages"))).select("doc_id", "ord", "kind", "parent_ord", "depth")


def island_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every body and island of the pages, by digest and length."""
    nodes = page_nodes(table(spark, sf_dir, "pages"))
    return q.node_texts(nodes, nodes.where("kind in ('body', 'island')")).select("doc_id", "ord", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("chars"))


def labels_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels moved by fifty ids, each with whether the document it names exists and what its source is."""
    refs = table(spark, sf_dir, "labels").select((F.col("doc_id") + 50).alias("ref"), "quality")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), "source")
    return refs.join(docs.withColumn("resolved", F.lit(True)), "ref", "left").select("ref", "quality", F.coalesce("resolved", F.lit(False)).alias("resolved"), "source")


def id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that order, and those with a balance, as sets: union, intersection and differences."""
    a = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    b = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    parts = {"union": a.union(b).distinct(), "intersection": a.intersect(b), "only_first": a.subtract(b), "only_second": b.subtract(a)}
    each = [df.agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max("id").alias("most")).where("n > 0").withColumn("name", F.lit(name)) for name, df in parts.items()]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of lines (order and number) that more than one line has, or that aren't positive."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    valid = (F.col("l_orderkey") > 0) & (F.col("l_linenumber") > 0)
    return rows.where((F.col("n") > 1) | ~valid).select("l_orderkey", "l_linenumber", "n", valid.alias("valid"))


def property_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between the properties of orders and those of an edited copy."""
    o = table(spark, sf_dir, "orders")
    before = F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority", F.lit("customer"), F.col("o_custkey").cast("string"))
    after = F.map_filter(
        F.map_concat(F.map_filter(before, lambda k, v: ~((k == "status") & (F.col("o_orderkey") % 4 == 0))), F.create_map(F.lit("checked"), F.lit("yes"))),
        lambda k, v: (k != "checked") | (F.col("o_orderkey") % 3 == 0),
    )
    after = F.transform_values(after, lambda k, v: F.when((k == "priority") & (F.col("o_orderkey") % 5 == 0), F.lower(v)).otherwise(v))
    return o.select("o_orderkey", F.inline(d.map_changes(before, after)))


def text_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents merged line by line from two edited copies: one edits every third line, the other every fourth and now and then adds one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edit = lambda n, mark: F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when((i + F.col("doc_id")) % n == 0, F.concat(x, F.lit(mark))).otherwise(x)), "\n")
    right = F.when(F.col("doc_id") % 7 == 0, F.concat(edit(4, " right"), F.lit("\nmore"))).otherwise(edit(4, " right"))
    merged = d.merge_texts(F.col("text"), edit(3, " left"), right)
    return docs.withColumn("m", merged).select("doc_id", F.col("m.outcome").alias("outcome"), F.sha2("m.text", 256).alias("text_sha256"))


def merge_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents merged from two edited copies, some added, removed or left alone by a side; texts that both changed are merged line by line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edit = lambda n, mark: F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.when((i + F.col("doc_id")) % n == 0, F.concat(x, F.lit(mark))).otherwise(x)), "\n")
    left = docs.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 != 0, edit(3, " left")).otherwise(F.col("text")))
    right = F.when(F.col("doc_id") % 7 == 0, F.concat(edit(4, " right"), F.lit("\nmore"))).when(F.col("doc_id") % 3 != 0, edit(4, " right")).otherwise(F.col("text"))
    out = d.three_way_merge(docs.where("doc_id % 13 <> 0"), left, docs.where("doc_id % 17 <> 0").withColumn("text", right), "doc_id", "text", texts=True)
    return out.select("doc_id", "outcome", "conflict", F.sha2("merged", 256).alias("merged_sha256"))


def _cells(spark, sf_dir):
    """Orders as tables: a row per line in order, four columns of numbers."""
    ties = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    lines = table(spark, sf_dir, "lineitem").withColumn("row", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ties)).cast("long"))
    values = F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax")], F.col("l_linenumber").cast("double"))
    return lines.select("l_orderkey", "row", F.posexplode(values).alias("i", "value")).select("l_orderkey", "row", (F.col("i") + 1).alias("column"), "value")


def range_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas over ranges of every order's cells."""
    cells = _cells(spark, sf_dir)
    one = lambda name, ref, as_: t.range_formula(cells, name, ref, "l_orderkey", "row", "column", "value").withColumnRenamed("result", as_)
    out = one("SUM", "A1:B3", "sum_a1_b3").join(one("AVERAGE", "D2:A4", "avg_a2_d4"), "l_orderkey").join(one("COUNT", "C2:C9", "count_c2_c9"), "l_orderkey").join(one("MAX", "D1", "max_d1"), "l_orderkey")
    return out.select("l_orderkey", F.round("sum_a1_b3", 6).alias("sum_a1_b3"), F.round("avg_a2_d4", 6).alias("avg_a2_d4"), "count_c2_c9", "max_d1")


def row_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the cells to the left and counts of those to the right, of every cell."""
    f = lambda name, way: t.formula(name, F.col("value"), ["l_orderkey", "row"], "column", way)
    return _cells(spark, sf_dir).select("l_orderkey", "row", "column", F.round(f("SUM", "LEFT"), 6).alias("sum_left"), f("COUNT", "RIGHT").alias("n_right"))


#: Formulas by their cell, over the columns quantity, discount, tax and number of an order's lines.
_FORMULAS = {
    "A1": "=IF(AND(B1 > 0.02, D1 <= 4), ROUND(C1 * 100, 0) + SUM(A2:B4), -AVERAGE(BELOW, RIGHT))",
    "B2": "= MOD(A2 + 7, D3 * 2) ^ 2 - 50% * INT(A1 / 3)",
    "C1": "A1 / (D1 - D2 + 1)",
    "D3": "IF(B1 = 0, A1 / B1, MAX(A1:A3, 20) + SIGN(B2 - C2) * COUNT(LEFT, ABOVE))",
    "D4": "PRODUCT(D1:D3) - MIN(A1, A2, ABS(A3 - 40))",
    "A5": "NOT(A1 > A2) + 2 * (OR(B1 < C1, B2 < C2) = TRUE)",
    "B7": "(A1 - 25) ^ 0.5",
}


def formula_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of formulas in every order's table; tables that lack a cell, divisions by zero and roots of negatives have a status."""
    out = formulas.evaluate(_cells(spark, sf_dir), _FORMULAS, "l_orderkey", "row", "column", "value", replace=True)
    return out.withColumn("result", F.round("result", 6))


def _tables(spark, sf_dir):
    """Customers as tables: their orders are rows, lines are cells with spans, merges and now and then a fault."""
    t = lambda name: table(spark, sf_dir, name)
    orders = t("orders").select(F.col("o_custkey").alias("table"), "o_orderkey", (F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("long").alias("row"))
    key = F.col("o_orderkey")
    rows = orders.select("table", "row", F.when(key % 29 == 0, -1).when(key % 7 == 0, 1).when(key % 61 == 0, 12).otherwise(0).alias("grid_before"), (key % 5).cast("int").alias("grid_after"), (key % 3 != 0).alias("header"))
    ties = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    lines = t("lineitem").withColumn("cell", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ties)).cast("long")).join(orders, F.col("l_orderkey") == key)
    span = F.when(F.col("l_suppkey") % 37 == 0, 0).when(F.col("l_suppkey") % 41 == 0, 2).when(F.col("l_suppkey") % 43 == 0, F.lit(None)).otherwise(1 + F.col("cell") % 2).cast("long")
    merge = F.when(F.col("l_partkey") % 4 == 0, "restart").when(F.col("l_partkey") % 4 < 3, "continue")
    cells = lines.select("table", "row", "cell", span.alias("span"), merge.alias("merge"))
    return t("customer").select(F.col("c_custkey").alias("table"), (5 + F.col("c_custkey") % 7).cast("int").alias("grid_columns")), rows, cells


def merge_chain_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is wrong with the grids and vertical merges of customers' tables."""
    return tables.issues(*_tables(spark, sf_dir))


def merge_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vertical merges of customers' tables."""
    _, rows, cells = _tables(spark, sf_dir)
    return tables.chains(tables.merge_chains(tables.placed_cells(rows, cells)))


def redundant_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct properties of lines that say what their order's style says already."""
    lines = table(spark, sf_dir, "lineitem")
    style = lines.groupBy("l_orderkey").agg(F.max("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    rows = lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus").distinct().join(style, "l_orderkey")
    entry = lambda level, source, name, value: F.struct(F.lit(level).alias("level"), F.lit(source).alias("source"), F.lit(name).alias("name"), value.alias("value"))
    bold = lambda c: F.when(c == "O", "true").otherwise("false")
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"]
    props = rows.select(*key, F.inline(F.array(
        entry(1, "style", "font", F.col("flag")), entry(1, "style", "bold", bold(F.col("status"))), entry(2, "direct", "font", F.col("l_returnflag")), entry(2, "direct", "bold", bold(F.col("l_linestatus"))),
    )))
    return st.redundant_direct(props, key)


def field_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field instructions by class, made from the tags of pages and the kinds of events."""
    tags = page_tokens(table(spark, sf_dir, "pages")).where("not is_close")
    names = F.create_map(*[F.lit(x) for pair in (("a", ' HYPERLINK "x"'), ("title", "title \\* upper"), ("li", "Seq item"), ("nav", "TOC \\o"), ("script", "MACROBUTTON go"), ("style", " link a b"), ("p", "")) for x in pair])
    fields = tags.select(F.coalesce(F.try_element_at(names, F.col("tag")), F.col("tag")).alias("instruction")).unionByName(
        table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "view", "PAGE").when(F.col("event_type") == "error", "DDEAUTO x").otherwise(F.col("event_type")).alias("instruction"))
    )
    name = fields.withColumn("name", field_name(F.col("instruction")))
    return name.groupBy("name", field_class(F.col("name")).alias("kind"), is_external(F.col("name")).alias("external"), invokes_application(F.col("name")).alias("invokes")).agg(F.count("*").alias("n"))


def sanitised_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of customers as documents after each level of sanitising."""
    props = F.create_map(
        F.lit("author"), "c_name", F.lit("rsidR"), F.col("c_custkey").cast("string"), F.lit("rsids"), F.lit("1 2"), F.lit("Company"), "c_mktsegment", F.lit("language"), F.lit("en"),
    )
    rows = table(spark, sf_dir, "customer").withColumn("props", props)
    each = [rows.select("c_custkey", F.lit(k).alias("level"), F.explode(sanitise(F.col("props"), k)).alias("name", "value")) for k in (1, 2, 3)]
    return each[0].unionByName(each[1]).unionByName(each[2])


QUERIES = {
    f.__name__: f
    for f in (field_kinds, sanitised_properties, page_nesting, island_texts, labels_resolved, id_sets, duplicate_ids, property_changes, text_merge, merge_entries, range_formulas, row_formulas, formula_expressions, merge_chain_issues, merge_chains, redundant_formatting)
}
_NODES = r"""
k AS (SELECT page_id AS doc_id, CAST(generate_subscripts(regexp_extract_all(html, '<[^>]+>[^<]*'), 1) AS BIGINT) AS ord, unnest(regexp_extract_all(html, '<[^>]+>[^<]*')) AS token FROM pages),
t AS (SELECT doc_id, ord, regexp_extract(token, '^</?([A-Za-z0-9!]+)', 1) AS tag, starts_with(token, '</') AS is_close, regexp_extract(token, '^<[^>]+>([^<]*)$', 1) AS text FROM k),
bal AS (SELECT *, count(*) FILTER (NOT is_close) OVER w AS o, count(*) FILTER (is_close) OVER w AS c FROM t WHERE tag IN ('article', 'h1', 'p', 'b', 'br', 'a', 'li', 'nav', 'footer', 'script', 'style') WINDOW w AS (PARTITION BY doc_id, tag ORDER BY ord)),
e AS (SELECT a.*, (SELECT min(b.ord) FROM bal b WHERE b.doc_id = a.doc_id AND b.tag = a.tag AND b.is_close AND b.ord > a.ord AND b.o - a.o = b.c - a.c - 1) AS fin FROM bal a),
n AS (SELECT doc_id, ord, coalesce(fin, ord) AS last, text,
             CASE tag WHEN 'article' THEN 'body' WHEN 'h1' THEN 'heading' WHEN 'p' THEN 'paragraph' WHEN 'b' THEN 'run' WHEN 'br' THEN 'break'
                      WHEN 'a' THEN 'hyperlink' WHEN 'li' THEN 'list_paragraph' ELSE 'island' END AS kind FROM e WHERE NOT is_close)"""
_TIES = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
_CELLS = f"""r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_TIES}) AS row FROM lineitem),
c AS (SELECT l_orderkey, row, unnest([1, 2, 3, 4]) AS "column", unnest([CAST(l_quantity AS DOUBLE), l_discount, l_tax, l_linenumber]) AS value FROM r)"""
_EDIT = "list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1 + doc_id) % {n} = 0 THEN x || '{mark}' ELSE x END)"
_TABLES = f"""WITH RECURSIVE o AS (SELECT o_custkey AS tab, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS "row" FROM orders),
rw AS (SELECT *, CASE WHEN k % 29 = 0 THEN -1 WHEN k % 7 = 0 THEN 1 WHEN k % 61 = 0 THEN 12 ELSE 0 END AS gb, k % 5 AS ga, k % 3 <> 0 AS header, 5 + tab % 7 AS grid FROM o),
li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_TIES}) AS cell FROM lineitem),
ce AS (SELECT rw.*, cell, l_partkey % 4 AS m, CASE WHEN l_suppkey % 37 = 0 THEN 0 WHEN l_suppkey % 41 = 0 THEN 2 WHEN l_suppkey % 43 = 0 THEN NULL ELSE 1 + cell % 2 END AS span FROM li JOIN rw ON l_orderkey = k),
pl AS (SELECT *, greatest(gb, 0) + sum(CASE WHEN span >= 1 THEN span ELSE 1 END) OVER (PARTITION BY k ORDER BY cell) AS e FROM ce),
pc AS (SELECT *, e - CASE WHEN span >= 1 THEN span ELSE 1 END AS s FROM pl),
ch(tab, s, e, first_row, "row", cell) AS (SELECT tab, s, e, "row", "row", cell FROM pc WHERE m = 0
  UNION ALL SELECT p.tab, p.s, p.e, ch.first_row, p."row", p.cell FROM ch JOIN pc p ON p.tab = ch.tab AND p.s = ch.s AND p.e = ch.e AND p."row" = ch."row" + 1 AND p.m IN (1, 2))"""
ORACLES = {
    "merge_chain_issues": _TABLES + """,
al AS (SELECT p.* FROM pc p WHERE m IN (1, 2) AND NOT EXISTS (SELECT 1 FROM ch WHERE ch.tab = p.tab AND ch."row" = p."row" AND ch.cell = p.cell)),
w AS (SELECT rw.*, coalesce(x.e, greatest(gb, 0)) + ga AS cols FROM rw LEFT JOIN (SELECT k, max(e) AS e FROM pc GROUP BY k) x USING (k))
SELECT tab AS "table", "row", cell, CASE WHEN EXISTS (SELECT 1 FROM ch WHERE ch.tab = al.tab AND ch."row" = al."row" - 1 AND ch.s < al.e AND al.s < ch.e) THEN 'VERTICAL_MERGE_SPAN_MISMATCH' ELSE 'VERTICAL_MERGE_ORPHAN_CONTINUATION' END AS issue FROM al
UNION ALL SELECT tab, "row", cell, 'GRID_SPAN_INVALID' FROM ce WHERE span = 0 UNION ALL SELECT tab, "row", NULL, 'GRID_BEFORE_INVALID' FROM rw WHERE gb < 0
UNION ALL SELECT tab, "row", NULL, 'ROW_GRID_OVERFLOW' FROM w WHERE cols > grid UNION ALL SELECT tab, "row", NULL, 'ROW_GRID_UNDERFLOW' FROM w WHERE cols < grid
UNION ALL SELECT tab, "row", NULL, 'ROW_GRID_SKIP_OUT_OF_RANGE' FROM w WHERE gb > grid OR ga > grid
UNION ALL SELECT tab, "row", NULL, 'HEADER_NOT_CONTIGUOUS' FROM rw r WHERE header AND EXISTS (SELECT 1 FROM rw x WHERE x.tab = r.tab AND x."row" < r."row" AND NOT x.header)""",
    "merge_chains": _TABLES + """ SELECT tab AS "table", CAST(s AS BIGINT) AS start_col, CAST(e AS BIGINT) AS end_col, first_row, max("row") AS last_row, count(*) AS n_cells FROM ch GROUP BY ALL""",
    "field_kinds": r"""WITH g AS (SELECT unnest(regexp_extract_all(html, '<([A-Za-z0-9!]+)[^>]*>', 1)) AS tag FROM pages),
f AS (SELECT CASE tag WHEN 'a' THEN 'HYPERLINK' WHEN 'title' THEN 'TITLE' WHEN 'li' THEN 'SEQ' WHEN 'nav' THEN 'TOC' WHEN 'script' THEN 'MACROBUTTON' WHEN 'style' THEN 'LINK' WHEN 'p' THEN '' ELSE upper(tag) END AS name FROM g
UNION ALL SELECT CASE event_type WHEN 'view' THEN 'PAGE' WHEN 'error' THEN 'DDEAUTO' ELSE upper(event_type) END FROM events)
SELECT name, CASE name WHEN 'HYPERLINK' THEN 'Hyperlink' WHEN 'TITLE' THEN 'DocumentMetadata' WHEN 'SEQ' THEN 'Sequence' WHEN 'TOC' THEN 'TableOfContents' WHEN 'MACROBUTTON' THEN 'Automation'
  WHEN 'LINK' THEN 'ExternalContent' WHEN 'DDEAUTO' THEN 'ExternalContent' WHEN 'PAGE' THEN 'Layout' ELSE 'Unknown' END AS kind, name IN ('LINK', 'DDEAUTO') AS "external", name IN ('LINK', 'DDEAUTO', 'MACROBUTTON') AS invokes, count(*) AS n
FROM f GROUP BY ALL""",
    "sanitised_properties": """SELECT c_custkey, level, name, value FROM (
SELECT c_custkey, level, 'author' AS name, CASE WHEN level > 1 THEN 'Anonymous' ELSE c_name END AS value FROM customer, (VALUES (1), (2), (3)) l(level)
UNION ALL SELECT c_custkey, level, 'rsids', '1 2' FROM customer, (VALUES (1), (2)) l(level)
UNION ALL SELECT c_custkey, level, 'Company', CASE WHEN level > 2 THEN '' ELSE c_mktsegment END FROM customer, (VALUES (1), (2), (3)) l(level)
UNION ALL SELECT c_custkey, level, 'language', 'en' FROM customer, (VALUES (1), (2), (3)) l(level))""",
    "page_nesting": f"""WITH {_NODES} SELECT n.doc_id, n.ord, n.kind, max(o.ord) AS parent_ord, count(o.ord) AS depth
FROM n LEFT JOIN n o ON o.doc_id = n.doc_id AND o.ord < n.ord AND n.ord <= o.last GROUP BY n.doc_id, n.ord, n.kind""",
    "island_texts": f"""WITH {_NODES}, s AS (SELECT o.doc_id, o.ord, ltrim(string_agg(CASE WHEN n.kind IN ('paragraph', 'heading', 'list_paragraph') THEN chr(10) ELSE '' END || n.text, '' ORDER BY n.ord), chr(10)) AS text FROM n o JOIN n ON n.doc_id = o.doc_id AND n.ord BETWEEN o.ord AND o.last
WHERE o.kind IN ('body', 'island') AND n.text <> '' GROUP BY o.doc_id, o.ord) SELECT doc_id, ord, sha256(text) AS text_sha256, CAST(length(text) AS BIGINT) AS chars FROM s""",
    "labels_resolved": "SELECT l.doc_id + 50 AS ref, quality, d.doc_id IS NOT NULL AS resolved, source FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id + 50",
    "id_sets": """WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders), b AS (SELECT DISTINCT c_custkey AS id FROM customer WHERE c_acctbal > 0),
u AS (SELECT 'union' AS name, id FROM (SELECT id FROM a UNION SELECT id FROM b) UNION ALL SELECT 'intersection', id FROM a WHERE id IN (SELECT id FROM b)
      UNION ALL SELECT 'only_first', id FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT 'only_second', id FROM b WHERE id NOT IN (SELECT id FROM a))
SELECT name, count(*) AS n, min(id) AS least, max(id) AS most FROM u GROUP BY name""",
    "duplicate_ids": "SELECT l_orderkey, l_linenumber, count(*) AS n, l_orderkey > 0 AND l_linenumber > 0 AS valid FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 OR l_orderkey <= 0 OR l_linenumber <= 0",
    "property_changes": """SELECT o_orderkey, 'status' AS name, 'Removed' AS change, o_orderstatus AS old, NULL AS new FROM orders WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 'checked', 'Added', NULL, 'yes' FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, 'priority', 'Changed', o_orderpriority, lower(o_orderpriority) FROM orders WHERE o_orderkey % 5 = 0 AND lower(o_orderpriority) <> o_orderpriority""",
    "text_merge": f"""WITH v AS (SELECT doc_id, string_split(text, chr(10)) AS a, {_EDIT.format(n=3, mark=" left")} AS l,
  CASE WHEN doc_id % 7 = 0 THEN list_append({_EDIT.format(n=4, mark=" right")}, 'more') ELSE {_EDIT.format(n=4, mark=" right")} END AS r FROM documents),
x AS (SELECT *, len(a) = len(r) AS same, list_bool_or(list_transform(a, lambda y, i: l[i] <> a[i] AND r[i] <> a[i])) AS clash,
  list_transform(a, lambda y, i: CASE WHEN l[i] <> y THEN l[i] ELSE r[i] END) AS m FROM v)
SELECT doc_id, CASE WHEN NOT same THEN 'StructureConflict' WHEN clash THEN 'Conflict' ELSE 'TextMerged' END AS outcome, CASE WHEN same AND NOT clash THEN sha256(array_to_string(m, chr(10))) END AS text_sha256 FROM x""",
    "merge_entries": f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 13 <> 0 THEN text END AS a, CASE WHEN doc_id % 11 <> 0 THEN CASE WHEN doc_id % 5 <> 0 THEN array_to_string({_EDIT.format(n=3, mark=" left")}, chr(10)) ELSE text END END AS l,
  CASE WHEN doc_id % 17 <> 0 THEN CASE WHEN doc_id % 7 = 0 THEN array_to_string({_EDIT.format(n=4, mark=" right")}, chr(10)) || chr(10) || 'more' WHEN doc_id % 3 <> 0 THEN array_to_string({_EDIT.format(n=4, mark=" right")}, chr(10)) ELSE text END END AS r FROM documents),
s AS (SELECT *, string_split(a, chr(10)) AS x, string_split(l, chr(10)) AS y, string_split(r, chr(10)) AS z FROM d WHERE a IS NOT NULL OR l IS NOT NULL OR r IS NOT NULL),
t AS (SELECT *, len(x) = len(y) AND len(x) = len(z) AS even, list_bool_or(list_transform(x, lambda v, i: y[i] <> v AND z[i] <> v AND y[i] <> z[i])) AS clash, list_transform(x, lambda v, i: CASE WHEN y[i] <> v THEN y[i] ELSE z[i] END) AS m FROM s),
o AS (SELECT *, CASE WHEN l IS NOT DISTINCT FROM r THEN CASE WHEN a IS NOT DISTINCT FROM l THEN 'Unchanged' ELSE 'Shared' END WHEN a IS NOT DISTINCT FROM l THEN 'Right' WHEN a IS NOT DISTINCT FROM r THEN 'Left'
  WHEN a IS NULL OR l IS NULL OR r IS NULL OR NOT even OR clash THEN 'Conflict' ELSE 'TextMerged' END AS outcome FROM t)
SELECT doc_id, outcome, CASE WHEN outcome = 'Conflict' THEN CASE WHEN a IS NULL THEN 'AddedDifferently' WHEN l IS NULL THEN 'DeletedOnLeftModifiedOnRight' WHEN r IS NULL THEN 'ModifiedOnLeftDeletedOnRight' WHEN NOT even THEN 'StructureConflict' ELSE 'ModifiedDifferently' END END AS conflict,
  sha256(CASE WHEN outcome IN ('Unchanged', 'Shared', 'Left') THEN l WHEN outcome = 'Right' THEN r WHEN outcome = 'TextMerged' THEN array_to_string(m, chr(10)) END) AS merged_sha256 FROM o""",
    "range_formulas": f"""WITH {_CELLS} SELECT l_orderkey, round(sum(value) FILTER (row BETWEEN 1 AND 3 AND "column" BETWEEN 1 AND 2), 6) AS sum_a1_b3, round(avg(value) FILTER (row BETWEEN 2 AND 4), 6) AS avg_a2_d4,
count(value) FILTER (row BETWEEN 2 AND 9 AND "column" = 3) AS count_c2_c9, max(value) FILTER (row = 1 AND "column" = 4) AS max_d1 FROM c GROUP BY l_orderkey""",
    "row_formulas": f"""WITH {_CELLS} SELECT l_orderkey, row, "column", round(sum(value) OVER (PARTITION BY l_orderkey, row ORDER BY "column" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS sum_left, CAST(4 - "column" AS BIGINT) AS n_right FROM c""",
    "formula_expressions": f"""WITH {_CELLS},
w AS (SELECT l_orderkey, row, l_quantity AS a, l_discount AS b, l_tax AS c, CAST(l_linenumber AS DOUBLE) AS d FROM r),
g AS (SELECT l_orderkey, max(row) AS h, {", ".join(f"max({x}) FILTER (row = {i}) AS {x}{i}" for x in "abcd" for i in range(1, 8))}, sum(a + b) FILTER (row BETWEEN 2 AND 4) AS s,
  count(*) - 1 AS below, coalesce(sum(a) FILTER (row > 1), 0) AS sum_below FROM w GROUP BY l_orderkey),
f AS (
  SELECT l_orderkey, 'A1' AS cell, 4 AS needs, CASE WHEN b1 > 0.02 AND d1 <= 4 THEN floor(c1 * 100 + 0.5) + coalesce(s, 0) ELSE -(sum_below + b1 + c1 + d1) / (below + 3) END AS x, NULL AS e, h FROM g
  UNION ALL SELECT l_orderkey, 'B2', 3, CASE WHEN d3 <> 0 THEN power((a2 + 7) % (d3 * 2), 2) - 0.5 * trunc(a1 / 3) END, CASE WHEN d3 = 0 THEN 'DivisionByZero' END, h FROM g
  UNION ALL SELECT l_orderkey, 'C1', 2, CASE WHEN d1 - d2 + 1 <> 0 THEN a1 / (d1 - d2 + 1) END, CASE WHEN d1 - d2 + 1 = 0 THEN 'DivisionByZero' END, h FROM g
  UNION ALL SELECT l_orderkey, 'D3', 3, CASE WHEN b1 <> 0 THEN greatest(a1, a2, a3, 20) + sign(b2 - c2) * 5 END, CASE WHEN b1 = 0 THEN 'DivisionByZero' END, h FROM g
  UNION ALL SELECT l_orderkey, 'D4', 4, d1 * d2 * d3 - least(a1, a2, abs(a3 - 40)), NULL, h FROM g
  UNION ALL SELECT l_orderkey, 'A5', 5, CASE WHEN a1 > a2 THEN 0 ELSE 1 END + CASE WHEN b1 < c1 OR b2 < c2 THEN 2 ELSE 0 END, NULL, h FROM g
  UNION ALL SELECT l_orderkey, 'B7', 7, CASE WHEN a1 >= 25 THEN sqrt(a1 - 25) END, CASE WHEN a1 < 25 THEN 'NotANumber' END, h FROM g)
SELECT l_orderkey, cell, CASE WHEN h >= needs AND e IS NULL THEN round(x, 6) END AS result, CASE WHEN h < needs THEN 'OutsideTable' ELSE coalesce(e, 'Exact') END AS status FROM f""",
    "redundant_formatting": """WITH s AS (SELECT l_orderkey, max(l_returnflag) AS flag, min(l_linestatus) AS status FROM lineitem GROUP BY l_orderkey),
d AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus, 'font' AS name, l_returnflag AS value FROM d JOIN s USING (l_orderkey) WHERE l_returnflag = flag
UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus, 'bold', CASE l_linestatus WHEN 'O' THEN 'true' ELSE 'false' END FROM d JOIN s USING (l_orderkey) WHERE (l_linestatus = 'O') = (status = 'O')""",
}
