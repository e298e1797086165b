"""Queries of numbering with rules, and of lint rules over the tables as one collection of documents.

Stand-ins: orders are tables and outlines, their lines rows and headings; parts are styles, lines of orders use them; users are
documents whose events are list items; pages have titles, links and islands; labels and events refer to documents and customers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.functions.lineage import checkpointed
from foliospark.operators import graph as g
from foliospark.operators import numbering
from foliospark.operators import ordered as o
from foliospark.operators import rules as r
from foliospark.sources import table
from foliospark.sources.projectors import page_nodes

#: Lists by number: starts, restart rules, formats, texts, legal levels, restart after sections.
_LISTS = """VALUES
  (0, array(1, 1, 1, 1), array(null, null, null, null), array('decimal', 'lowerLetter', 'lowerRoman', 'decimalZero'), array('%1.', '%1.%2)', '(%3)', '%1-%4'), array(false, false, false, false), false),
  (1, array(5, 3, 1, 1), array(null, 0, 1, 2), array('upperRoman', 'decimal', 'upperLetter', 'decimal'), array('Article %1', '%1.%2', '%3', 'Section %1.%2.%3.%4 of this very long text'), array(false, true, false, true), true),
  (2, array(1, null, 1, -1), array(null, null, 7, null), array('decimal', 'decimal', 'chicago', 'decimal'), array('*', '%2', '%1 %3', '%4'), array(false, false, false, false), false),
  (3, array(0, 9999, 1, 1), array(null, null, null, 3), array('decimal', 'lowerRoman', 'decimal', 'none'), array('%3', '%2', '', null), array(false, false, false, false), true)
  AS t(num_id, starts, restarts, formats, texts, legal, by_section)"""


def _list_items(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), (F.col("event_id") % 5).cast("int").alias("num_id"),
        ((F.col("event_id") * 7 + F.floor(F.col("event_id") / 11)) % 4).cast("int").alias("level"), (F.col("event_type") == "purchase").alias("is_break"),
    )


def list_labels_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and labels of users' events as items of five lists, one of them without a definition, with all rules."""
    return numbering.numbered(_list_items(spark, sf_dir), spark.sql(f"SELECT * FROM {_LISTS}"))


def numbering_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items by list, level, status and label status."""
    return list_labels_multi(spark, sf_dir).groupBy("num_id", "level", "status", "label_status").agg(F.count("*").alias("n"), F.count_if(F.col("restarted")).alias("restarts"))


def _lines(spark, sf_dir):
    ties = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    return table(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ties)).cast("long")).withColumn("doc_id", F.col("l_orderkey"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all rules that the tables can show."""
    t = lambda name: table(spark, sf_dir, name)
    lines, parts = _lines(spark, sf_dir), t("part").withColumn("doc_id", F.col("p_partkey"))
    heads = o.outline(lines.select("doc_id", "ord", (1 + F.col("l_partkey") % 4).cast("int").alias("level")))
    nodes = page_nodes(t("pages"))
    tagged, href = F.element_at("props", F.lit("tag")), F.element_at("props", F.lit("href"))
    titled = nodes.where((F.col("kind") == "heading") & (F.trim("text") != "")).select("doc_id").distinct()
    pages = t("pages").select(F.col("page_id").alias("doc_id"))
    tables = lines.groupBy("doc_id").agg(F.count("*").alias("n"), F.min_by("l_returnflag", "ord").alias("first"))
    same = parts.groupBy("p_brand", "p_size", "p_type").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n > 1")
    # names, so that a parent that has no row never is a key of one
    name = F.col("p_partkey").cast("string")
    chains = g.chain(parts.select(name.alias("style"), F.when(F.col("p_partkey") % 9 == 0, F.concat(F.lit("none:"), name)).when(F.col("p_partkey") > 1, F.floor(F.col("p_partkey") / 2).cast("string")).alias("up")), "style", "up")
    # three rules read the numbers, which are computed once
    items = checkpointed(numbering.numbered(_list_items(spark, sf_dir), spark.sql(f"SELECT * FROM {_LISTS}")).select("doc_id", "ord", "num_id", "status", "label_status"))
    always = F.lit(True)
    at = F.col("ord")
    some = lambda rows, rule, pack, severity, subject, when=always: r.finding(rows, rule, pack, severity, subject, when)
    orphans = t("labels").withColumn("doc_id", F.col("doc_id") + 50).join(t("documents"), "doc_id", "left_anti")
    unknown = t("events").select(F.col("event_id").alias("doc_id"), (F.col("user_id") * 11).alias("user_id")).join(t("customer"), F.col("user_id") == F.col("c_custkey"), "left_anti")
    unplaced = t("customer").select((F.col("c_custkey") + 10).alias("doc_id")).join(t("orders"), F.col("doc_id") == F.col("o_custkey"), "left_anti")
    unbound = t("supplier").select((F.col("s_suppkey") + 3).alias("doc_id")).join(lines.select("l_suppkey"), F.col("doc_id") == F.col("l_suppkey"), "left_anti")
    return r.union_findings(
        some(heads, "HEADING_ORDER", "Accessibility", "Warning", at, F.col("issue").isNotNull()),
        some(heads, "OUTLINE_DIAGNOSTIC", "Core", "Info", at, F.col("parent_ord").isNull() & (F.col("level") > 1)),
        some(nodes, "HEADING_EMPTY", "Accessibility", "Error", at, (F.col("kind") == "heading") & (F.trim("text") == "")),
        some(pages.join(titled, "doc_id", "left_anti"), "DOCUMENT_TITLE", "Accessibility", "Warning", F.lit("document")),
        some(tables, "TABLE_HEADER", "Accessibility", "Warning", F.lit("table"), (F.col("n") > 1) & (F.col("first") == "N")),
        some(nodes, "EXTERNAL_RELATIONSHIP", "Security", "Warning", at, (F.col("kind") == "hyperlink") & F.regexp_like(href, F.lit("^[a-z]+:"))),
        some(nodes, "HIDDEN_TEXT", "Security", "Warning", at, tagged.isin("script", "style") & (F.trim("text") != "")),
        some(parts.withColumn("doc_id", F.col("p_partkey") + 7).join(lines.select("l_partkey"), F.col("doc_id") == F.col("l_partkey"), "left_anti"), "STYLE_UNUSED", "Styles", "Info", F.col("p_name")),
        some(same, "EQUIVALENT_FORMATTING", "Styles", "Info", F.concat_ws("|", "p_brand", "p_size", "p_type")),
        some(chains.withColumn("doc_id", F.col("node").cast("long")), "STYLE_GRAPH", "Styles", "Error", F.col("status"), F.col("status") != "Resolved"),
        some(lines, "DIRECT_OVERRIDE", "Styles", "Info", at, (F.col("l_discount") > 0.05) & (F.col("l_tax") > 0.05)),
        some(unplaced, "RELATIONSHIP_UNUSED", "Core", "Info", F.lit("customer")),
        some(orphans, "ORPHAN_PART", "Core", "Error", F.lit("label")),
        some(unknown, "REFERENCE_GRAPH", "Core", "Error", F.col("user_id")),
        some(unbound, "UNBOUND_SECTION_STORY", "Core", "Warning", F.lit("supplier")),
        some(items, "NUMBERING_COUNTER_UNRESOLVED", "Core", "Warning", at, F.col("status") != "Exact"),
        some(items, "NUMBERING_LABEL_INVALID", "Core", "Warning", at, F.col("label_status").isin("InvalidLevelText", "UnsupportedNumberFormat", "LengthLimitExceeded")),
        some(items, "NUMBERING_GRAPH", "Core", "Error", F.col("num_id"), F.col("status") == "MissingDefinition").distinct(),
    )


_CHOICE = {"packs": ["Core", "Accessibility", "Styles"], "suppressed_rules": ["STYLE_UNUSED", "REFERENCE_GRAPH"], "least": "Warning"}


def lint_rule_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of eighteen rules with its state: one pack off, two rules suppressed, Info filtered."""
    return r.evaluate(findings(spark, sf_dir), **_CHOICE).select("doc_id", "rule", "pack", "severity", "subject", "finding_id", "state")


def lint_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By rule: findings of its pack if it is on (matched), and of these the suppressed, filtered and visible ones."""
    rows = r.evaluate(findings(spark, sf_dir), **_CHOICE)
    n = lambda *states: F.count_if(F.col("state").isin(*states))
    return rows.groupBy("rule", "pack", "severity").agg(
        n("suppressed", "filtered", "visible").alias("matched"), n("suppressed").alias("suppressed"), n("filtered").alias("filtered"), n("visible").alias("visible")
    )


QUERIES = {f.__name__: f for f in (list_labels_multi, numbering_status_counts, lint_rule_findings, lint_rule_counts)}

_I = """d(num_id, starts, restarts, formats, texts, legal, by_section) AS (VALUES
  (0, [1, 1, 1, 1], [NULL::INTEGER, NULL, NULL, NULL], ['decimal', 'lowerLetter', 'lowerRoman', 'decimalZero'], ['%1.', '%1.%2)', '(%3)', '%1-%4'], [false, false, false, false], false),
  (1, [5, 3, 1, 1], [NULL, 0, 1, 2], ['upperRoman', 'decimal', 'upperLetter', 'decimal'], ['Article %1', '%1.%2', '%3', 'Section %1.%2.%3.%4 of this very long text'], [false, true, false, true], true),
  (2, [1, NULL, 1, -1], [NULL, NULL, 7, NULL], ['decimal', 'decimal', 'chicago', 'decimal'], ['*', '%2', '%1 %3', '%4'], [false, false, false, false], false),
  (3, [0, 9999, 1, 1], [NULL, NULL, NULL, 3], ['decimal', 'lowerRoman', 'decimal', 'none'], ['%3', '%2', '', NULL], [false, false, false, false], true)),
ev AS (SELECT user_id AS doc_id, event_id AS ord, CAST(event_id % 5 AS INTEGER) AS num_id, CAST((event_id * 7 + event_id // 11) % 4 AS INTEGER) AS level, event_type = 'purchase' AS is_break FROM events),
se AS (SELECT *, sum(CASE WHEN is_break THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS sec FROM ev),
it AS (SELECT se.*, CASE WHEN by_section THEN sec ELSE 0 END AS part, starts, restarts, formats, texts, legal FROM se LEFT JOIN d USING (num_id)),
lv AS (SELECT unnest(range(4)) AS k),
pr AS (  -- for every item and level: earlier items of its list, itself included, after the last one that resets the level
  SELECT i.doc_id, i.ord, lv.k, max(CASE WHEN j.level < lv.k AND (i.restarts[lv.k + 1] IS NULL OR (i.restarts[lv.k + 1] <> 0 AND j.level < i.restarts[lv.k + 1])) THEN j.ord END) AS reset
  FROM it i, lv, it j WHERE j.doc_id = i.doc_id AND j.num_id = i.num_id AND j.part = i.part AND j.ord <= i.ord AND i.starts IS NOT NULL GROUP BY ALL),
cn AS (SELECT p.doc_id, p.ord, p.k, count(CASE WHEN j.level = p.k AND (p.reset IS NULL OR j.ord > p.reset) THEN 1 END) AS n, count(CASE WHEN j.level = p.k THEN 1 END) AS every
  FROM pr p JOIN it i ON i.ord = p.ord AND i.doc_id = p.doc_id JOIN it j ON j.doc_id = i.doc_id AND j.num_id = i.num_id AND j.part = i.part AND j.ord <= i.ord GROUP BY ALL),
va AS (SELECT c.*, CASE WHEN n > 0 AND starts[k + 1] >= 0 AND (restarts[k + 1] IS NULL OR restarts[k + 1] = 0 OR restarts[k + 1] BETWEEN 1 AND least(7, k)) THEN starts[k + 1] + n - 1 END AS v FROM cn c JOIN it USING (doc_id, ord)),
vs AS (SELECT doc_id, ord, list(v ORDER BY k) AS vals, list(n ORDER BY k) AS ns, list(every ORDER BY k) AS es FROM va GROUP BY ALL),
st AS (SELECT it.*, vals[level + 1] AS counter, coalesce(ns[level + 1] = 1 AND es[level + 1] > 1, false) AS restarted, vals, texts[level + 1] AS text,
  CASE WHEN starts IS NULL THEN 'MissingDefinition' WHEN starts[level + 1] IS NULL OR starts[level + 1] < 0 THEN 'UnresolvedStart'
       WHEN NOT (restarts[level + 1] IS NULL OR restarts[level + 1] = 0 OR restarts[level + 1] BETWEEN 1 AND level) THEN 'UnresolvedRestartRule' ELSE 'Exact' END AS status FROM it LEFT JOIN vs USING (doc_id, ord)),
"""
_FORMS = "CASE f{k} WHEN 'decimal' THEN CAST(v{k} AS VARCHAR) WHEN 'decimalZero' THEN CASE WHEN v{k} < 10 THEN '0' ELSE '' END || v{k} WHEN 'none' THEN '' WHEN 'upperRoman' THEN {roman} WHEN 'lowerRoman' THEN lower({roman}) WHEN 'upperLetter' THEN {letter} WHEN 'lowerLetter' THEN lower({letter}) END"


def _roman(v):
    ones, tens = ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"], ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"]
    hundreds = ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"]
    return f"CASE WHEN {v} BETWEEN 1 AND 3999 THEN repeat('M', CAST({v} // 1000 AS INTEGER)) || {hundreds}[{v} // 100 % 10 + 1] || {tens}[{v} // 10 % 10 + 1] || {ones}[{v} % 10 + 1] END"


def _letter(v):
    return f"CASE WHEN {v} BETWEEN 1 AND 26 THEN chr(CAST(64 + {v} AS INTEGER)) WHEN {v} BETWEEN 27 AND 702 THEN chr(CAST(64 + ({v} - 1) // 26 AS INTEGER)) || chr(CAST(65 + ({v} - 1) % 26 AS INTEGER)) END"


_I += f"""fo AS (SELECT *, {", ".join(f"vals[{k + 1}] AS v{k}, CASE WHEN legal[level + 1] THEN 'decimal' ELSE formats[{k + 1}] END AS f{k}, contains(text, '%{k + 1}') AS u{k}" for k in range(4))} FROM st),
fs AS (SELECT *, {", ".join(_FORMS.format(k=k, roman=_roman(f"v{k}"), letter=_letter(f"v{k}")) + f" AS s{k}" for k in range(4))} FROM fo),
wh AS (SELECT *, {"replace(" * 4}text{"".join(f", '%{k + 1}', coalesce(s{k}, ''))" for k in range(4))} AS plain, {" OR ".join(f"(u{k} AND level < {k})" for k in range(4))} AS low, {" OR ".join(f"u{k}" for k in range(4))} AS anyused,
  {" OR ".join(f"(u{k} AND v{k} IS NULL)" for k in range(4))} AS nov, {" OR ".join(f"(u{k} AND s{k} IS NULL)" for k in range(4))} AS nos FROM fs),
la AS (SELECT *, CASE WHEN text IS NULL THEN 'MissingLevelText' WHEN text = '' THEN 'Hidden' WHEN low THEN 'InvalidLevelText' WHEN NOT anyused THEN CASE WHEN length(text) <= 31 THEN 'Exact' ELSE 'LengthLimitExceeded' END
  WHEN status <> 'Exact' OR nov THEN 'ReferencedCounterUnresolved' WHEN nos THEN 'UnsupportedNumberFormat' WHEN length(plain) > 31 THEN 'LengthLimitExceeded' ELSE 'Exact' END AS label_status FROM wh),
nu AS (SELECT doc_id, ord, num_id, level, is_break, counter, status, restarted, CASE label_status WHEN 'Exact' THEN plain WHEN 'Hidden' THEN '' END AS label, label_status FROM la)"""
_TIES = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
_L = rf"""li AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_TIES}) AS ord FROM lineitem),
he AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY ord) AS pl, min(level) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ml FROM (SELECT l_orderkey AS doc_id, ord, 1 + l_partkey % 4 AS level FROM li)),
tk AS (SELECT page_id AS doc_id, CAST(generate_subscripts(regexp_extract_all(html, '<[^>]+>[^<]*'), 1) AS BIGINT) AS ord, unnest(regexp_extract_all(html, '<[^>]+>[^<]*')) AS token FROM pages),
tg AS (SELECT doc_id, ord, regexp_extract(token, '^</?([A-Za-z0-9!]+)', 1) AS tag, regexp_extract(token, '^<[^>]+>([^<]*)$', 1) AS text, regexp_extract(token, '^<[^>]*href="([^"]*)"', 1) AS href FROM tk WHERE NOT starts_with(token, '</')),
f0 AS (
  SELECT doc_id, 'HEADING_ORDER' AS rule, 'Accessibility' AS pack, 'Warning' AS severity, CAST(ord AS VARCHAR) AS subject FROM he WHERE (pl IS NULL AND level > 1) OR level > pl + 1
  UNION ALL SELECT doc_id, 'OUTLINE_DIAGNOSTIC', 'Core', 'Info', CAST(ord AS VARCHAR) FROM he WHERE level > 1 AND (ml IS NULL OR ml >= level)
  UNION ALL SELECT doc_id, 'HEADING_EMPTY', 'Accessibility', 'Error', CAST(ord AS VARCHAR) FROM tg WHERE tag = 'h1' AND trim(text) = ''
  UNION ALL SELECT page_id, 'DOCUMENT_TITLE', 'Accessibility', 'Warning', 'document' FROM pages WHERE page_id NOT IN (SELECT doc_id FROM tg WHERE tag = 'h1' AND trim(text) <> '')
  UNION ALL SELECT l_orderkey, 'TABLE_HEADER', 'Accessibility', 'Warning', 'table' FROM li GROUP BY l_orderkey HAVING count(*) > 1 AND arg_min(l_returnflag, ord) = 'N'
  UNION ALL SELECT doc_id, 'EXTERNAL_RELATIONSHIP', 'Security', 'Warning', CAST(ord AS VARCHAR) FROM tg WHERE tag = 'a' AND regexp_matches(href, '^[a-z]+:')
  UNION ALL SELECT doc_id, 'HIDDEN_TEXT', 'Security', 'Warning', CAST(ord AS VARCHAR) FROM tg WHERE tag IN ('script', 'style') AND trim(text) <> ''
  UNION ALL SELECT p_partkey + 7, 'STYLE_UNUSED', 'Styles', 'Info', p_name FROM part WHERE p_partkey + 7 NOT IN (SELECT l_partkey FROM lineitem)
  UNION ALL SELECT min(p_partkey), 'EQUIVALENT_FORMATTING', 'Styles', 'Info', p_brand || '|' || p_size || '|' || p_type FROM part GROUP BY p_brand, p_size, p_type HAVING count(*) > 1
  UNION ALL SELECT node, 'STYLE_GRAPH', 'Styles', 'Error', 'Missing' FROM ch GROUP BY node HAVING bool_or(spot % 9 = 0)
  UNION ALL SELECT l_orderkey, 'DIRECT_OVERRIDE', 'Styles', 'Info', CAST(ord AS VARCHAR) FROM li WHERE l_discount > 0.05 AND l_tax > 0.05
  UNION ALL SELECT c_custkey + 10, 'RELATIONSHIP_UNUSED', 'Core', 'Info', 'customer' FROM customer WHERE c_custkey + 10 NOT IN (SELECT o_custkey FROM orders)
  UNION ALL SELECT doc_id + 50, 'ORPHAN_PART', 'Core', 'Error', 'label' FROM labels WHERE doc_id + 50 NOT IN (SELECT doc_id FROM documents)
  UNION ALL SELECT event_id, 'REFERENCE_GRAPH', 'Core', 'Error', CAST(user_id * 11 AS VARCHAR) FROM events WHERE user_id * 11 NOT IN (SELECT c_custkey FROM customer)
  UNION ALL SELECT s_suppkey + 3, 'UNBOUND_SECTION_STORY', 'Core', 'Warning', 'supplier' FROM supplier WHERE s_suppkey + 3 NOT IN (SELECT l_suppkey FROM lineitem)
  UNION ALL SELECT doc_id, 'NUMBERING_COUNTER_UNRESOLVED', 'Core', 'Warning', CAST(ord AS VARCHAR) FROM nu WHERE status <> 'Exact'
  UNION ALL SELECT doc_id, 'NUMBERING_LABEL_INVALID', 'Core', 'Warning', CAST(ord AS VARCHAR) FROM nu WHERE label_status IN ('InvalidLevelText', 'UnsupportedNumberFormat', 'LengthLimitExceeded')
  UNION ALL SELECT DISTINCT doc_id, 'NUMBERING_GRAPH', 'Core', 'Error', CAST(num_id AS VARCHAR) FROM nu WHERE status = 'MissingDefinition'),
fi AS (SELECT *, 'finding_' || substring(sha256(rule || '|' || doc_id || '|' || subject), 1, 24) AS finding_id,
  CASE WHEN pack = 'Security' THEN 'off' WHEN rule IN ('STYLE_UNUSED', 'REFERENCE_GRAPH') THEN 'suppressed' WHEN severity = 'Info' THEN 'filtered' ELSE 'visible' END AS state FROM f0)"""
_CH = "ch AS (SELECT p_partkey AS node, p_partkey AS spot FROM part UNION ALL SELECT node, CAST(floor(spot / 2) AS BIGINT) FROM ch WHERE spot > 1 AND spot % 9 <> 0)"
ORACLES = {
    "list_labels_multi": f"WITH {_I} SELECT * FROM nu",
    "numbering_status_counts": f"WITH {_I} SELECT num_id, level, status, label_status, count(*) AS n, count(CASE WHEN restarted THEN 1 END) AS restarts FROM nu GROUP BY ALL",
    "lint_rule_findings": f"WITH RECURSIVE {_I}, {_CH}, {_L} SELECT doc_id, rule, pack, severity, subject, finding_id, state FROM fi",
    "lint_rule_counts": f"""WITH RECURSIVE {_I}, {_CH}, {_L} SELECT rule, pack, severity, count(CASE WHEN state <> 'off' THEN 1 END) AS matched, count(CASE WHEN state = 'suppressed' THEN 1 END) AS suppressed,
count(CASE WHEN state = 'filtered' THEN 1 END) AS filtered, count(CASE WHEN state = 'visible' THEN 1 END) AS visible FROM fi GROUP BY rule, pack, severity""",
}
