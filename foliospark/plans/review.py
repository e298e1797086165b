"""Queries of diff, merge, patch, review, rules, protection, templates and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.operators import diff as d
from foliospark.operators import protect as p
from foliospark.operators import rules as r
from foliospark.operators import semantic
from foliospark.operators import template as t
from foliospark.sources import table
from foliospark.sources.projectors import document_nodes, page_nodes

# --- diff, merge, patch ---------------------------------------------------------------


def _versions(spark, sf_dir):
    """Three versions of the customers: the ancestor and two edited copies."""
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    k = F.col("key")
    left = base.where(k % 11 != 0).withColumn("value", F.when(k % 5 == 0, F.concat("value", F.lit("!"))).otherwise(F.col("value")))
    right = base.where(k % 13 != 0).withColumn("value", F.when(k % 10 == 0, F.concat("value", F.lit("!"))).when(k % 7 == 0, F.lower("value")).otherwise(F.col("value")))
    extra = lambda s: base.where(k % 17 == 0).select((k + 1_000_000).alias("key"), F.lit(s).alias("value"))
    return base, left.unionByName(extra("new")), right.unionByName(extra("other"))


def entry_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that differ between the ancestor and the left version."""
    base, left, _ = _versions(spark, sf_dir)
    return d.entry_diff(base, left, "key", "value")


def three_way_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome, conflict and merged value per entry."""
    return d.three_way_merge(*_versions(spark, sf_dir), "key", "value").select("key", "outcome", "conflict", "merged")


def merge_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge with conflicts settled: left for even keys, the ancestor for keys divisible by three."""
    versions = _versions(spark, sf_dir)
    k = F.col("key")
    choices = versions[0].unionByName(versions[1]).select("key").distinct()
    choices = choices.withColumn("choice", F.when(k % 2 == 0, "UseLeft").when(k % 3 == 0, "UseAncestor")).where("choice is not null")
    return d.three_way_merge(*versions, "key", "value", choices).groupBy("outcome").agg(F.count("*").alias("n"), F.count("merged").alias("kept"))


def patch_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A patch from left to right, applied and taken back: operations, failures and rows that differ in the end."""
    _, left, right = _versions(spark, sf_dir)
    patch = d.create_patch(left, right, "key", "value")
    there = d.apply_patch(left, patch, "key", "value")
    back = d.apply_patch(there.drop("failed"), d.reverse_patch(patch), "key", "value")
    wrong = back.drop("failed").join(left.withColumnRenamed("value", "was"), "key", "full").where(~F.col("value").eqNullSafe(F.col("was")))
    part = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return (
        patch.groupBy(F.col("op").alias("what")).agg(F.count("*").alias("n"))
        .unionByName(part(there.where("failed"), "failed")).unionByName(part(wrong, "wrong"))
    )


def merge_review_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of three reviewers, from events, merged: applied, skipped or in conflict."""
    rows = table(spark, sf_dir, "events").select(
        (F.col("event_id") % 3).alias("reviewer"), F.col("event_id").alias("ord"), F.when(F.col("event_type") == "error", "del").otherwise("ins").alias("kind"),
        F.concat(F.lit("paragraph "), (F.col("user_id") % 500).cast("string")).alias("preceding"), F.concat(F.col("event_type"), (F.col("event_id") % 4).cast("string")).alias("text"),
    )
    return d.merge_reviews(rows).select("reviewer", "ord", "kind", "place", "text", "outcome")


def tracked_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of conversations with system turns as deletions and assistant turns as insertions: accepted and rejected."""
    kind = F.when(F.col("role") == "system", "del").when(F.col("role") == "assistant", "ins").otherwise("keep")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), kind.alias("kind"), "text")
    n = lambda accept, name: F.sum(F.when(d.stays(F.col("kind"), accept), F.length("text"))).cast("long").alias(name)
    return rows.groupBy("conv_id").agg(n(True, "accepted"), n(False, "rejected"))


def compare_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph changes between every document and its edited copy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("base"))
    edited = F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("base", " the ", " a ")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("A new line.\n"), "base")).otherwise(F.regexp_replace("base", "\n[^\n]*$", ""))
    return d.compare_documents(docs.withColumn("revised", edited))


def semantic_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between every document and a copy with lines moved, changed, removed and added."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("base"))
    lines = F.split("base", "\n")
    edited = (
        F.when(F.col("doc_id") % 4 == 0, F.array_join(F.concat(F.slice(lines, -1, 1), F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))), "\n"))
        .when(F.col("doc_id") % 4 == 1, F.regexp_replace("base", "[.] ", "; ")).when(F.col("doc_id") % 4 == 2, F.regexp_replace("base", "\n[^\n]*$", ""))
        .otherwise(F.concat("base", F.lit("\nA line that is new.")))
    )
    return semantic.semantic_diff(docs.withColumn("revised", edited))


def compare_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause alignment between conversations and their edited copies: each turn is a clause headed by its first words."""
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), "turn", F.substring_index("text", " ", 4).alias("heading"), F.col("text").alias("body")
    )
    clause = lambda h, b: F.sort_array(F.collect_list(F.struct("turn", h.alias("heading"), b.alias("body"))))
    renamed = F.when(F.col("turn") % 3 == 1, F.concat("heading", F.lit("s"))).otherwise(F.col("heading"))
    changed = F.when(F.col("turn") % 3 == 2, F.upper("body")).otherwise(F.col("body"))
    pairs = turns.groupBy("doc_id").agg(clause(F.col("heading"), F.col("body")).alias("ours"), F.filter(clause(renamed, changed), lambda c: c["turn"] != 3).alias("theirs"))
    return d.compare_clauses(pairs)


def moved_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders whose place changes against the rest when they are sorted by price."""
    lines = table(spark, sf_dir, "lineitem")
    ties = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    place = lambda *by: F.row_number().over(W.partitionBy("l_orderkey").orderBy(*by)).cast("long")
    rows = lines.withColumn("before", place(*ties)).withColumn("after", place("l_extendedprice", *ties))
    return d.moved_children(rows.select("l_orderkey", "before", "after"), "l_orderkey", "before", "after")


def first_line_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle similarity of each turn to the one before it in its conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    pairs = turns.withColumn("prior", before).where("prior is not null")
    return d.shingle_dice(pairs, "text", "prior").select("conv_id", F.col("turn").cast("long").alias("turn"), F.round("dice", 6).alias("dice"))


def equal_after_normalising(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are equal once case and white space are set aside, by group."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2(d.normalise(F.translate("text", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞẞ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß")), 256).alias("key"))
    return rows.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


# --- rules ------------------------------------------------------------------------------


def _findings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = document_nodes(docs).where("kind = 'paragraph'")
    pages = page_nodes(table(spark, sf_dir, "pages"))
    at = F.col("ord")
    digests = docs.select("doc_id", F.sha2("text", 256).alias("digest"))
    copies = digests.join(digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "digest")
    tagged = F.element_at("props", F.lit("tag"))
    return r.union_findings(
        r.finding(lines, "CORE_ARTIFACT", "Core", "Warning", at, F.regexp_like("text", F.lit("DRAFT|TODO|FIXME|XXX"))),
        r.finding(lines, "CORE_EMPTY_PARAGRAPH", "Core", "Info", at, F.trim("text") == ""),
        r.finding(lines, "SECURITY_CREDENTIAL", "Security", "Error", at, F.regexp_like("text", F.lit("(password|token|secret) ?="))),
        r.finding(copies, "CORE_DUPLICATE_DOCUMENT", "Core", "Warning", F.lit("document"), F.col("n") > 1),
        r.finding(pages, "ACCESSIBILITY_HEADING_EMPTY", "Accessibility", "Error", at, (F.col("kind") == "heading") & (F.trim("text") == "")),
        r.finding(pages, "CORE_UNCLOSED_ELEMENT", "Core", "Warning", at, tagged.isin("p", "b") & (F.col("subtree_end") == F.col("ord"))),
        r.finding(pages, "SECURITY_SCRIPT", "Security", "Info", at, tagged == "script"),
    )


def lint_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all rules with their states: one rule suppressed, Info filtered, one pack off."""
    return r.evaluate(_findings(spark, sf_dir), packs=["Core", "Security"], suppressed_rules=["CORE_UNCLOSED_ELEMENT"], least="Warning").select("doc_id", "rule", "severity", "subject", "finding_id", "state")


def lint_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by pack, rule, severity and state."""
    return r.rollup(r.evaluate(_findings(spark, sf_dir), packs=["Core", "Security"], suppressed_rules=["CORE_UNCLOSED_ELEMENT"], least="Warning"))


def analysis_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most severe rules found."""
    return r.signals(_findings(spark, sf_dir), 3)


# --- protection -----------------------------------------------------------------------------


def pii_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected strings by document and kind."""
    return p.detect(table(spark, sf_dir, "documents"), ["doc_id"]).groupBy("doc_id", "kind", "value").agg(F.count("*").alias("n"))


def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged spans of every occurrence of every detected string, anywhere in its document."""
    lines = document_nodes(table(spark, sf_dir, "documents")).where("kind = 'paragraph'")
    return p.merge_spans(p.spans(lines, "doc_id", "ord"), ["doc_id", "ord"])


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redacted texts by digest and length, for documents that change."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", p.redact(F.col("text")).alias("clean"))
    return rows.where("clean <> text").select("doc_id", F.sha2("clean", 256).alias("clean_sha256"), F.length("clean").cast("long").alias("chars"))


def page_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bates numbers of pages."""
    return table(spark, sf_dir, "pages").select("page_id", p.bates(F.col("page_id") + 995, "AB", 4).alias("stamp"))


# --- templates and tables ---------------------------------------------------------------------


def template_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags (customers that order) without data (customers by key and a half) and the reverse."""
    tags = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tag"))
    return t.validate_tags(tags, table(spark, sf_dir, "customer").select((F.col("c_custkey") + F.floor(F.col("c_custkey") / 2)).alias("tag")))


def template_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Controls of orders filled with the lines' flags: the first in place, others cloned."""
    controls = table(spark, sf_dir, "orders").select(F.lit(1).alias("doc_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderkey").alias("tag"), F.col("o_orderpriority").alias("text"))
    data = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tag"), F.col("l_returnflag").alias("value")).agg(F.count("*").alias("n"))
    data = data.withColumn("i", (F.row_number().over(W.partitionBy("tag").orderBy("value")) - 1).cast("long")).select("tag", "i", "value")
    return t.fill(controls, data).select("ord", F.col("clone").cast("long").alias("clone"), "text", "filled")


def binding_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-case priorities and segments as fields, bound to columns exactly or regardless of case."""
    fields = table(spark, sf_dir, "orders").select(F.lower("o_orderpriority").alias("field")).unionByName(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("field"))).distinct()
    columns = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("name")).distinct().unionByName(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("name")).distinct())
    return t.bind_columns(fields, columns)


def skip_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipients that a SKIPIF condition leaves, by segment."""
    rows = t.skip_records(table(spark, sf_dir, "customer"), "SKIPIF c_acctbal < 1000")
    return rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def table_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formulas over the cells above each line of an order."""
    ties = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    lines = table(spark, sf_dir, "lineitem").withColumn("ord", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ties)).cast("long"))
    f = lambda name, way="ABOVE": F.round(t.formula(name, F.col("l_quantity"), ["l_orderkey"], "ord", way), 4)
    return lines.select(
        "l_orderkey", "ord", f("SUM").alias("sum_above"), f("AVERAGE").alias("avg_above"), t.formula("COUNT", F.col("l_quantity"), ["l_orderkey"], "ord").alias("n_above"),
        f("MAX").alias("max_above"), f("MIN", "BELOW").alias("min_below"),
    )


def table_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as CSV lines, read back."""
    lines = table(spark, sf_dir, "supplier").select("s_suppkey", t.to_csv_line(["s_suppkey", "s_name", "s_nationkey"]).alias("line"))
    back = F.from_csv("line", F.lit("k long, name string, nation int"))
    return lines.select("s_suppkey", "line", back["k"].alias("k"), back["name"].alias("name"), back["nation"].alias("nation"))


def package_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint per source that doesn't depend on the order of its entries: the digest of sums of the entries' digests, by words of 60 bits.

    The sums are added up before the shuffle and can't overflow: 38 digits hold more than 10**19 entries.
    """
    digest = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), F.length("text").cast("string"), F.sha2("text", 256)), 256)
    words = [F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)").alias(f"w{k}") for k in range(4)]
    sums = table(spark, sf_dir, "documents").select("source", *words).groupBy("source").agg(F.count("*").alias("entries"), *[F.sum(f"w{k}").cast("string").alias(f"w{k}") for k in range(4)])
    return sums.select("source", "entries", F.sha2(F.concat_ws("|", "w0", "w1", "w2", "w3"), 256).alias("fingerprint"))


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and values by hour and kind (an addition: the batch form of the streaming job)."""
    from foliospark.streaming.events import hourly

    return hourly(table(spark, sf_dir, "events")).select("hour", "event_type", "n", F.round("total", 2).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        entry_diff, three_way_merge, merge_resolved, patch_roundtrip, merge_review_rounds, tracked_changes, compare_documents, semantic_diff, compare_contracts, moved_children,
        first_line_similarity, equal_after_normalising, lint_findings, lint_rollup, analysis_signals, pii_entities, pii_spans, redact_text, page_stamps, template_tags,
        template_fill, binding_plan, skip_records, table_formulas, table_csv, package_fingerprint, event_windows,
    )
}

_V = """a AS (SELECT c_custkey AS key, c_name AS value FROM customer),
l AS (SELECT key, CASE WHEN key % 5 = 0 THEN value || '!' ELSE value END AS value FROM a WHERE key % 11 <> 0 UNION ALL SELECT key + 1000000, 'new' FROM a WHERE key % 17 = 0),
r AS (SELECT key, CASE WHEN key % 10 = 0 THEN value || '!' WHEN key % 7 = 0 THEN lower(value) ELSE value END AS value FROM a WHERE key % 13 <> 0
      UNION ALL SELECT key + 1000000, 'other' FROM a WHERE key % 17 = 0)"""
_M = _V + """,
k AS (SELECT coalesce(a.key, l.key, r.key) AS key, a.value AS a, l.value AS l, r.value AS r FROM a FULL JOIN l ON a.key = l.key FULL JOIN r ON coalesce(a.key, l.key) = r.key),
o AS (SELECT *, CASE WHEN l IS NOT DISTINCT FROM r THEN CASE WHEN a IS NOT DISTINCT FROM l THEN 'Unchanged' ELSE 'Shared' END
                     WHEN a IS NOT DISTINCT FROM l THEN 'Right' WHEN a IS NOT DISTINCT FROM r THEN 'Left' ELSE 'Conflict' END AS outcome FROM k),
m AS (SELECT *, CASE WHEN outcome <> 'Conflict' THEN NULL WHEN a IS NULL THEN 'AddedDifferently' WHEN l IS NULL THEN 'DeletedOnLeftModifiedOnRight'
                     WHEN r IS NULL THEN 'ModifiedOnLeftDeletedOnRight' ELSE 'ModifiedDifferently' END AS conflict,
             CASE WHEN outcome IN ('Unchanged', 'Shared', 'Left') THEN l WHEN outcome = 'Right' THEN r END AS merged FROM o)"""
_P = "x AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS ord, unnest(string_split(text, chr(10))) AS text FROM documents)"
_F = r"""
k AS (SELECT page_id AS doc_id, CAST(generate_subscripts(regexp_extract_all(html, '<[^>]+>[^<]*'), 1) AS BIGINT) AS ord,
             unnest(regexp_extract_all(html, '<[^>]+>[^<]*')) AS token FROM pages),
t AS (SELECT doc_id, ord, regexp_extract(token, '^</?([A-Za-z0-9!]+)', 1) AS tag, starts_with(token, '</') AS is_close, regexp_extract(token, '^<[^>]+>([^<]*)$', 1) AS text FROM k),
bal AS (SELECT *, count(*) FILTER (NOT is_close) OVER w AS o, count(*) FILTER (is_close) OVER w AS c FROM t WINDOW w AS (PARTITION BY doc_id, tag ORDER BY ord)),
e AS (SELECT a.*, (SELECT min(b.ord) FROM bal b WHERE b.doc_id = a.doc_id AND b.tag = a.tag AND b.is_close AND b.ord > a.ord AND b.o - a.o = b.c - a.c - 1) AS ends FROM bal a),
f AS (
  SELECT doc_id, 'CORE_ARTIFACT' AS rule, 'Core' AS pack, 'Warning' AS severity, CAST(ord AS VARCHAR) AS subject FROM x WHERE regexp_matches(text, 'DRAFT|TODO|FIXME|XXX')
  UNION ALL SELECT doc_id, 'CORE_EMPTY_PARAGRAPH', 'Core', 'Info', CAST(ord AS VARCHAR) FROM x WHERE trim(text) = ''
  UNION ALL SELECT doc_id, 'SECURITY_CREDENTIAL', 'Security', 'Error', CAST(ord AS VARCHAR) FROM x WHERE regexp_matches(text, '(password|token|secret) ?=')
  UNION ALL SELECT doc_id, 'CORE_DUPLICATE_DOCUMENT', 'Core', 'Warning', 'document' FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)
  UNION ALL SELECT doc_id, 'ACCESSIBILITY_HEADING_EMPTY', 'Accessibility', 'Error', CAST(ord AS VARCHAR) FROM e WHERE tag = 'h1' AND NOT is_close AND trim(text) = ''
  UNION ALL SELECT doc_id, 'CORE_UNCLOSED_ELEMENT', 'Core', 'Warning', CAST(ord AS VARCHAR) FROM e WHERE tag IN ('p', 'b') AND NOT is_close AND ends IS NULL
  UNION ALL SELECT doc_id, 'SECURITY_SCRIPT', 'Security', 'Info', CAST(ord AS VARCHAR) FROM e WHERE tag = 'script' AND NOT is_close),
s AS (SELECT *, 'finding_' || substring(sha256(rule || '|' || doc_id || '|' || subject), 1, 24) AS finding_id,
             CASE WHEN pack NOT IN ('Core', 'Security') THEN 'off' WHEN rule = 'CORE_UNCLOSED_ELEMENT' THEN 'suppressed' WHEN severity = 'Info' THEN 'filtered' ELSE 'visible' END AS state FROM f)"""
_PII = list(p.PATTERNS.items())
_D = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{v}')) AS value FROM documents" for k, v in _PII)
_DX = " UNION ALL ".join(f"SELECT doc_id, ord, text, unnest(regexp_extract_all(text, '{v}')) AS value FROM x" for k, v in _PII)
_CLEAN = "text"
for _, _v in _PII:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_v}', '[REDACTED]', 'g')"
_TIES = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
_GRAMS = "list_distinct(list_transform(range(1, greatest(2, length({0}) - 1)), lambda i: substring({0}, i, 3)))"

ORACLES = {
    "entry_diff": f"""WITH {_V} SELECT coalesce(a.key, l.key) AS key, CASE WHEN a.key IS NULL THEN 'Added' WHEN l.key IS NULL THEN 'Removed' ELSE 'Modified' END AS difference,
sha256(a.value) AS sha_a, sha256(l.value) AS sha_b FROM a FULL JOIN l ON a.key = l.key WHERE a.value IS DISTINCT FROM l.value""",
    "three_way_merge": f"WITH {_M} SELECT key, outcome, conflict, merged FROM m",
    "merge_resolved": f"""WITH {_M}, c AS (SELECT *, CASE WHEN outcome = 'Conflict' AND key IN (SELECT key FROM a UNION SELECT key FROM l) THEN CASE WHEN key % 2 = 0 THEN 'l' WHEN key % 3 = 0 THEN 'a' END END AS ch FROM m)
SELECT CASE WHEN ch IS NOT NULL THEN 'Resolved' ELSE outcome END AS outcome, count(*) AS n, count(CASE ch WHEN 'l' THEN l WHEN 'a' THEN a ELSE merged END) AS kept FROM c GROUP BY 1""",
    "patch_roundtrip": f"""WITH {_V} SELECT CASE WHEN l.key IS NULL THEN 'Add' WHEN r.key IS NULL THEN 'Delete' ELSE 'Replace' END AS what, count(*) AS n
FROM l FULL JOIN r ON l.key = r.key WHERE l.value IS DISTINCT FROM r.value GROUP BY 1 UNION ALL SELECT 'failed', 0 UNION ALL SELECT 'wrong', 0""",
    "merge_review_rounds": """WITH c AS (SELECT event_id % 3 AS reviewer, event_id AS ord, CASE WHEN event_type = 'error' THEN 'del' ELSE 'ins' END AS kind,
  'paragraph ' || (user_id % 500) AS place, event_type || (event_id % 4) AS text FROM events),
w AS (SELECT *, row_number() OVER (PARTITION BY kind, place, text ORDER BY reviewer, ord) AS nth, first_value(text) OVER (PARTITION BY kind, place ORDER BY reviewer, ord) AS ft FROM c)
SELECT reviewer, ord, kind, place, text, CASE WHEN nth > 1 THEN 'Skipped' WHEN text <> ft THEN 'Conflict' ELSE 'Applied' END AS outcome FROM w""",
    "tracked_changes": """SELECT conv_id, CAST(sum(CASE WHEN role <> 'system' THEN length(text) END) AS BIGINT) AS accepted,
CAST(sum(CASE WHEN role <> 'assistant' THEN length(text) END) AS BIGINT) AS rejected FROM conversations GROUP BY conv_id""",
    "first_line_similarity": f"""WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM conversations),
g AS (SELECT conv_id, turn, {_GRAMS.format("text")} AS a, {_GRAMS.format("prior")} AS b FROM t WHERE prior IS NOT NULL)
SELECT conv_id, turn, round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) AS dice FROM g""",
    "equal_after_normalising": r"""WITH k AS (SELECT doc_id, sha256(lower(trim(regexp_replace(translate(text, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞẞ', 'àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß'), '[ \t\n\x0b\f\r]+', ' ', 'g')))) AS key FROM documents)
SELECT key, count(*) AS n, min(doc_id) AS first_doc FROM k GROUP BY key HAVING count(*) > 1""",
    "lint_findings": f"WITH {_P}, {_F} SELECT doc_id, rule, severity, subject, finding_id, state FROM s",
    "lint_rollup": f"WITH {_P}, {_F} SELECT pack, rule, severity, state, count(*) AS n, count(DISTINCT doc_id) AS documents FROM s GROUP BY ALL",
    "analysis_signals": f"""WITH {_P}, {_F} SELECT rule, severity, count(*) AS n FROM s GROUP BY rule, severity
ORDER BY CASE severity WHEN 'Fatal' THEN 3 WHEN 'Error' THEN 2 WHEN 'Warning' THEN 1 ELSE 0 END DESC, rule LIMIT 3""",
    "pii_entities": f"WITH d AS ({_D}) SELECT doc_id, kind, value, count(*) AS n FROM d GROUP BY ALL",
    "pii_spans": f"""WITH {_P}, v AS (SELECT DISTINCT doc_id, lower(value) AS value FROM ({_DX})),
d AS (SELECT x.doc_id, x.ord, x.text, v.value FROM x JOIN v ON v.doc_id = x.doc_id AND contains(lower(x.text), v.value)),
o AS (SELECT doc_id, ord, length(value) AS n, lower(text) AS t, lower(value) AS v, unnest(range(1, length(text) - length(value) + 2)) AS s FROM d),
sp AS (SELECT DISTINCT doc_id, ord, s, s + n AS e FROM o WHERE substring(t, s, n) = v),
i AS (SELECT *, CASE WHEN max(e) OVER (PARTITION BY doc_id, ord ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= s THEN 0 ELSE 1 END AS n FROM sp),
g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, ord ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM i)
SELECT doc_id, ord, min(s) AS start, max(e) AS "end" FROM g GROUP BY doc_id, ord, island""",
    "redact_text": f"SELECT doc_id, sha256({_CLEAN}) AS clean_sha256, CAST(length({_CLEAN}) AS BIGINT) AS chars FROM documents WHERE {_CLEAN} <> text",
    "page_stamps": "SELECT page_id, 'AB' || CASE WHEN page_id + 995 > 999 THEN CAST(page_id + 995 AS VARCHAR) ELSE lpad(CAST(page_id + 995 AS VARCHAR), 4, '0') END AS stamp FROM pages",
    "template_tags": """WITH t AS (SELECT DISTINCT o_custkey AS tag FROM orders), k AS (SELECT c_custkey + c_custkey // 2 AS tag FROM customer)
SELECT tag, 'missing' AS status FROM t WHERE tag NOT IN (SELECT tag FROM k) UNION ALL SELECT tag, 'extra' FROM k WHERE tag NOT IN (SELECT tag FROM t)""",
    "template_fill": """WITH v AS (SELECT DISTINCT l_orderkey AS tag, l_returnflag AS value FROM lineitem),
d AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY value) - 1 AS i FROM v)
SELECT o_orderkey AS ord, coalesce(i, 0) AS clone, coalesce(value, o_orderpriority) AS text, value IS NOT NULL AS filled FROM orders LEFT JOIN d ON tag = o_orderkey""",
    "binding_plan": """WITH f AS (SELECT c_mktsegment AS field FROM customer UNION SELECT lower(o_orderpriority) FROM orders),
c AS (SELECT DISTINCT o_orderpriority AS name FROM orders UNION ALL SELECT DISTINCT c_mktsegment FROM customer),
x AS (SELECT field, (SELECT count(*) FROM c WHERE name = field) AS ne, (SELECT count(*) FROM c WHERE lower(name) = lower(field)) AS nl, (SELECT min(name) FROM c WHERE lower(name) = lower(field)) AS one FROM f)
SELECT field, CASE WHEN ne = 1 THEN 'ResolvedExact' WHEN ne > 1 THEN 'Ambiguous' WHEN nl = 1 THEN 'ResolvedCaseInsensitive' WHEN nl > 1 THEN 'Ambiguous' ELSE 'Missing' END AS status,
       CASE WHEN ne = 1 THEN field WHEN ne = 0 AND nl = 1 THEN one END AS "column" FROM x""",
    "skip_records": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT coalesce(c_acctbal < 1000, false) GROUP BY c_mktsegment",
    "table_formulas": f"""WITH l AS (SELECT l_orderkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_TIES}) AS ord FROM lineitem)
SELECT l_orderkey, ord, round(sum(l_quantity) OVER a, 4) AS sum_above, round(avg(l_quantity) OVER a, 4) AS avg_above, count(l_quantity) OVER a AS n_above,
       max(l_quantity) OVER a AS max_above, min(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS min_below
FROM l WINDOW a AS (PARTITION BY l_orderkey ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "table_csv": "SELECT s_suppkey, s_suppkey || ',' || s_name || ',' || s_nationkey AS line, s_suppkey AS k, s_name AS name, s_nationkey AS nation FROM supplier",
    "package_fingerprint": f"""WITH d AS (SELECT source, sha256(doc_id || '|' || length(text) || '|' || sha256(text)) AS h FROM documents)
SELECT source, count(*) AS entries, sha256({" || '|' || ".join(f"CAST(sum(CAST(CAST('0x' || substring(h, {1 + 15 * k}, 15) AS BIGINT) AS HUGEINT)) AS VARCHAR)" for k in range(4))}) AS fingerprint FROM d GROUP BY source""",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL",
}
