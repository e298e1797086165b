"""Queries of bindings to data stores, of edits that hold as a whole, and of mail-merge schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.lineage import checkpointed
from foliospark.operators import bindings as b
from foliospark.operators import mailmerge as m
from foliospark.operators import transactions as t
from foliospark.sources import table
from foliospark.sources.projectors import page_tree

from .trees import TREE

#: Bindings of every page: the store that they name, prefix mappings, and path.
_LISTS = "xmlns:l='urn:list'"
BINDINGS = (
    ("own", _LISTS, "/html/body/article/p[2]"), ("own", _LISTS, "/html[1]/body/nav/ul/l:li"), ("own", '  xmlns:q="urn:list" ', "/html/body/nav/ul/q:li[3]/q:a"), ("own", _LISTS, "/html/x:body"), ("own", _LISTS, "//p"),
    ("own", _LISTS, "/html/body/p[0]"), ("own", _LISTS, "/html/"), ("own", _LISTS, " "), ("own", "xmlns:l=urn", "/html"), ("none", _LISTS, "/html"), ("short", _LISTS, "/html"), ("unknown", _LISTS, "/html"), ("twice", _LISTS, "/html"),
    ("closed", _LISTS, "/html"), ("own", _LISTS, "/html/body/aside"), ("own", _LISTS, "/html[2]"), ("own", _LISTS + " " + _LISTS, "/html"), ("own", None, "/html/body/l:a"), ("own", _LISTS, "/html/head/title[last()]"),
)


def control_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nineteen bindings of every page, taken as a data store: their status and targets, and whether a repeating section has as many items."""
    pages = table(spark, sf_dir, "pages")
    tree = page_tree(pages).where("tag <> '#text'")
    elements = tree.select("doc_id", F.lit(1).alias("store"), F.col("ord").alias("node"), F.col("parent_ord").alias("parent"), "ord", F.when(F.col("tag").isin("a", "li"), "urn:list").otherwise("").alias("namespace"), F.col("tag").alias("name"))
    guid = lambda name: F.regexp_replace(F.md5(F.concat(F.col("page_id").cast("string"), F.lit(name))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    store = lambda k, name, readable: F.struct(F.lit(k).alias("store"), F.concat(F.lit("{"), F.upper(guid(name)), F.lit("}")).alias("item_id"), F.lit(readable).alias("readable"))
    stores = pages.select(F.col("page_id").alias("doc_id"), F.inline(F.array(store(1, "own", True), store(2, "twice", True), store(3, "twice", True), store(4, "closed", False))))
    ids = {"own": guid("own"), "twice": F.upper(guid("twice")), "closed": F.regexp_replace(guid("closed"), "-", ""), "unknown": guid("unknown"), "short": F.lit("{1234}"), "none": F.lit("")}
    entry = lambda k, name, mappings, path: F.struct(F.lit(k).alias("binding"), ids[name].alias("store_id"), F.lit(mappings).cast("string").alias("mappings"), F.lit(path).alias("path"))
    wanted = pages.select(F.col("page_id").alias("doc_id"), F.inline(F.array(*[entry(k, *x) for k, x in enumerate(BINDINGS, 1)])))
    resolved, targets = b.resolve(wanted, stores, elements)
    spans = targets.groupBy("doc_id", "binding").agg(F.min("ord").alias("first_target"), F.max("ord").alias("last_target"))
    sections = b.repeating_sections(pages.select(F.col("page_id").alias("doc_id"), F.lit(2).alias("binding"), (F.col("page_id") % 8).alias("items")), resolved)
    out = resolved.join(spans, ["doc_id", "binding"], "left").join(sections.select("doc_id", "binding", "matches"), ["doc_id", "binding"], "left")
    return out.select("doc_id", "binding", "status", "n_targets", "first_target", "last_target", "matches")


def edit_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of edits for every document, good or at fault by its id: the outcome, the text after it, and whether the inverse restores the old one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    nodes = checkpointed(docs.select("doc_id", F.posexplode("lines").alias("ord", "text")))
    line = lambda k: F.get("lines", k)
    last, kind = F.size("lines") - 1, F.col("doc_id") % 8
    text = line(F.lit(0))
    half = F.floor(F.length(text) / 2).cast("int")
    none = F.lit(None).cast("int")

    def command(k, ord_, expected, replacement, start=none, end=none, when=None):
        x = F.struct(F.lit(k).alias("command"), ord_.cast("int").alias("ord"), start.alias("start"), end.alias("end"), expected.alias("expected"), replacement.alias("replacement"))
        return x if when is None else F.when(when, x)

    every = [
        command(1, F.lit(0), F.when(kind == 1, F.concat(text, F.lit("?"))).otherwise(text), F.when(kind == 6, text).otherwise(F.concat(F.lit("new "), text)), when=~kind.isin(3, 7)),
        command(2, last, line(last), F.lit(""), when=kind.isin(0, 1)), command(3, F.lit(0), text, F.lit("again"), when=kind == 2), command(4, last + 5, F.lit(""), F.lit("x"), when=kind == 4),
        command(5, F.lit(0), F.substring(text, F.lit(1), half), F.lit("<b>"), F.lit(0), half, kind.isin(3, 7)), command(6, F.lit(0), F.substring(text, half + 1, F.length(text)), F.lit("</b>tail"), half, F.length(text), kind == 7),
        command(7, F.lit(0), text, F.lit("all"), F.lit(0), F.length(text), kind == 3),
    ]
    commands = docs.select("doc_id", F.inline(F.filter(F.array(*every), lambda x: x.isNotNull())))
    now = t.fingerprints(nodes)
    bases = now.withColumn("base", F.when(F.col("doc_id") % 8 == 5, F.reverse("base")).otherwise(F.col("base")))
    plan = checkpointed(t.checked(nodes, commands, bases))
    after = checkpointed(t.applied(nodes, plan))
    undo = t.checked(after, t.inverse(plan), t.fingerprints(after))
    back = t.fingerprints(t.applied(after, undo)).withColumnRenamed("base", "restored")
    whole = after.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("whole"))
    out = t.outcomes(plan).join(whole, "doc_id").join(now, "doc_id").join(back, "doc_id")
    return out.select("doc_id", "outcome", "n_commands", "n_changed", "problems", F.sha2("whole", 256).alias("text_sha256"), (F.col("base") == F.col("restored")).alias("restored"))


def _merge(spark, sf_dir):
    """Nations as documents: columns from their customers, fields from their orders, four mappings each, and a configuration for most."""
    customers, c = table(spark, sf_dir, "customer"), F.col
    key = c("c_custkey")
    name = F.when(key % 4 == 0, c("c_mktsegment")).when(key % 4 == 1, F.lower("c_mktsegment")).when(key % 4 == 2, c("c_name")).otherwise(F.concat(F.lit("Col"), (key % 7).cast("string")))
    columns = customers.where("c_custkey % 5 < 2").select(c("c_nationkey").alias("doc_id"), key.alias("ordinal"), name.alias("name"))
    orders = table(spark, sf_dir, "orders").join(customers.select(key.alias("o_custkey"), c("c_nationkey").alias("doc_id")), "o_custkey")
    o = c("o_orderkey")
    pick = lambda column, *values: F.get(F.array(*[F.lit(v) for v in values]), (column % len(values)).cast("int"))
    target = F.when(o % 6 == 5, F.concat(F.lit("Name"), (c("o_custkey") % 5).cast("string"))).otherwise(pick(o % 6, "BUILDING", "machinerY", "Col3", "COL5", " ", ""))
    fields = orders.select("doc_id", o.alias("field"), pick(F.floor(o / 6), "MERGEFIELD", "MERGEFIELD", "NEXTIF", "MERGEREC", "MERGEFIELD", "IF", "MERGEFIELD", "ADDRESSBLOCK", "MERGEBARCODE").alias("field_type"), target.alias("target"), (o % 31 != 0).alias("complete"), (o % 37 == 0).alias("deleted"), (o % 5 != 0).alias("control_ok"))
    entry = lambda k, mapped, source: F.struct(F.lit(k).alias("mapping"), F.lit(mapped).alias("mapped_name"), F.lit(source).cast("string").alias("source_column"))
    nations = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("doc_id"))
    mappings = nations.select("doc_id", F.inline(F.array(entry(1, "Name0", "BUILDING"), entry(2, "Name1", None), entry(3, "Name2", "Col3"), entry(4, "Name2", "Col4"), entry(5, "Name3", "machinery"))))
    return fields, columns, mappings, nations.where("doc_id % 6 <> 1")


def merge_schema_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source column of every field, or why it has none."""
    fields, columns, mappings, _ = _merge(spark, sf_dir)
    return m.bindings(fields, columns, mappings).withColumn("reasons", F.array_join("reasons", ","))


def merge_schema_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's fields can be bound, what blocks it, and how many columns no field takes."""
    fields, columns, mappings, configured = _merge(spark, sf_dir)
    return m.plans(m.bindings(fields, columns, mappings), columns, configured)


QUERIES = {f.__name__: f for f in (control_bindings, edit_transactions, merge_schema_bindings, merge_schema_plans)}
_MERGE = """co AS (SELECT c_nationkey AS doc_id, c_custkey AS ordinal, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN c_name ELSE 'Col' || (c_custkey % 7) END AS name FROM customer WHERE c_custkey % 5 < 2),
fi AS (SELECT c_nationkey AS doc_id, o_orderkey AS field, ['MERGEFIELD', 'MERGEFIELD', 'NEXTIF', 'MERGEREC', 'MERGEFIELD', 'IF', 'MERGEFIELD', 'ADDRESSBLOCK', 'MERGEBARCODE'][(o_orderkey // 6) % 9 + 1] AS ty,
  CASE o_orderkey % 6 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'machinerY' WHEN 2 THEN 'Col3' WHEN 3 THEN 'COL5' WHEN 4 THEN ' ' ELSE 'Name' || (o_custkey % 5) END AS target, o_orderkey % 31 <> 0 AS whole, o_orderkey % 37 = 0 AS gone, o_orderkey % 5 <> 0 AS ok
  FROM orders JOIN customer ON c_custkey = o_custkey),
rq AS (SELECT *, CASE target WHEN 'Name0' THEN 'BUILDING' WHEN 'Name3' THEN 'machinery' ELSE target END AS required FROM fi),
ma AS (SELECT rq.*, (SELECT min(ordinal) FROM co WHERE co.doc_id = rq.doc_id AND co.name = required) AS ex, (SELECT count(*) FROM co WHERE co.doc_id = rq.doc_id AND lower(co.name) = lower(required)) AS n,
  (SELECT min(ordinal) FROM co WHERE co.doc_id = rq.doc_id AND lower(co.name) = lower(required)) AS lo FROM rq),
st AS (SELECT *, CASE WHEN ty IN ('MERGEREC', 'IF', 'ADDRESSBLOCK') THEN 'NotApplicable' WHEN ty = 'NEXTIF' AND NOT ok THEN 'Missing' WHEN target = 'Name2' THEN 'Ambiguous' WHEN trim(required) = '' THEN 'Missing' WHEN ex IS NOT NULL THEN 'ResolvedExact'
    WHEN n = 1 THEN 'ResolvedCaseInsensitive' WHEN n > 1 THEN 'Ambiguous' ELSE 'Missing' END AS status,
  CASE WHEN ty = 'MERGEREC' THEN CASE WHEN NOT ok THEN 'mail_merge_control_syntax_invalid' END WHEN ty = 'IF' THEN 'conditional_mail_merge_if_unmodeled' WHEN ty = 'ADDRESSBLOCK' THEN 'unsupported_mail_merge_control_fields'
    WHEN ty = 'NEXTIF' AND NOT ok THEN 'mail_merge_control_syntax_invalid' WHEN target = 'Name2' THEN 'ambiguous_odso_mapping' WHEN trim(required) = '' THEN 'source_column_name_missing' WHEN ex IS NOT NULL OR n = 1 THEN NULL WHEN n > 1 THEN 'source_column_ambiguous' ELSE 'source_column_missing' END AS why FROM ma),
bi AS (SELECT doc_id, field, ty AS field_type, CASE WHEN status <> 'NotApplicable' THEN required END AS required, CASE status WHEN 'ResolvedExact' THEN ex WHEN 'ResolvedCaseInsensitive' THEN lo END AS ordinal,
  CASE status WHEN 'ResolvedExact' THEN required WHEN 'ResolvedCaseInsensitive' THEN (SELECT min(name) FROM co WHERE co.doc_id = st.doc_id AND co.ordinal = lo) END AS "column", status,
  list_sort(list_filter([why, CASE WHEN NOT whole THEN 'incomplete_mail_merge_fields' END, CASE WHEN gone THEN 'deleted_mail_merge_fields' END], lambda x: x IS NOT NULL)) AS reasons FROM st)"""
ORACLES = {
    "control_bindings": f"""WITH {TREE},
below AS (SELECT c.*, p.tag AS above, row_number() OVER (PARTITION BY c.doc_id, c.par, c.tag ORDER BY c.ord) AS r FROM nd c LEFT JOIN nd p ON p.doc_id = c.doc_id AND p.ord = c.par WHERE c.tag <> '#text'),
h AS (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM below WHERE par IS NULL AND tag = 'html'),
bo AS (SELECT b.doc_id, b.ord, h.r FROM below b JOIN h ON h.doc_id = b.doc_id AND h.ord = b.par WHERE b.tag = 'body'),
li AS (SELECT l.doc_id, l.ord, l.r, bo.r AS html FROM below l JOIN below u ON u.doc_id = l.doc_id AND u.ord = l.par AND u.tag = 'ul' JOIN below n ON n.doc_id = u.doc_id AND n.ord = u.par AND n.tag = 'nav' JOIN bo ON bo.doc_id = n.doc_id AND bo.ord = n.par WHERE l.tag = 'li'),
tg AS (
  SELECT p.doc_id, 1 AS binding, p.ord FROM below p JOIN below a ON a.doc_id = p.doc_id AND a.ord = p.par AND a.tag = 'article' JOIN bo ON bo.doc_id = a.doc_id AND bo.ord = a.par WHERE p.tag = 'p' AND p.r = 2
  UNION ALL SELECT doc_id, 2, ord FROM li WHERE html = 1
  UNION ALL SELECT a.doc_id, 3, a.ord FROM below a JOIN li ON li.doc_id = a.doc_id AND li.ord = a.par AND li.r = 3 WHERE a.tag = 'a'
  UNION ALL SELECT doc_id, 16, ord FROM h WHERE r = 2),
n AS (SELECT doc_id, binding, count(*) AS n, min(ord) AS lo, max(ord) AS hi FROM tg GROUP BY ALL),
s(binding, status) AS (VALUES (1, NULL), (2, NULL), (3, NULL), (4, 'XPathInvalid'), (5, 'XPathUnsupported'), (6, 'XPathUnsupported'), (7, 'XPathInvalid'), (8, 'XPathMissing'), (9, 'PrefixMappingsInvalid'), (10, 'StoreIdMissing'),
  (11, 'StoreIdInvalid'), (12, 'StoreMissing'), (13, 'StoreAmbiguous'), (14, 'StoreUnreadable'), (15, NULL), (16, NULL), (17, 'PrefixMappingsInvalid'), (18, 'XPathInvalid'), (19, 'XPathUnsupported'))
SELECT page_id AS doc_id, s.binding, coalesce(status, CASE WHEN n > 0 THEN 'Resolved' ELSE 'TargetMissing' END) AS status, coalesce(n, 0) AS n_targets, lo AS first_target, hi AS last_target,
  CASE WHEN s.binding = 2 THEN page_id % 8 = coalesce(n, 0) END AS matches FROM pages CROSS JOIN s LEFT JOIN n ON n.doc_id = page_id AND n.binding = s.binding""",
    "edit_transactions": """WITH d AS (SELECT doc_id, doc_id % 8 AS k, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT *, len(ls) AS n, ls[1] AS a, ls[-1] AS z FROM d),
o AS (SELECT *, CASE k WHEN 0 THEN CASE WHEN n = 1 THEN 'DuplicateTarget' ELSE '' END WHEN 1 THEN CASE WHEN n = 1 THEN 'DuplicateTarget,TextMismatch' ELSE 'TextMismatch' END WHEN 2 THEN 'DuplicateTarget'
     WHEN 3 THEN CASE WHEN length(a) = 0 THEN 'DuplicateTarget' WHEN length(a) = 1 THEN '' ELSE 'Overlap' END WHEN 4 THEN 'NodeMissing' WHEN 5 THEN 'BaseMismatch' WHEN 6 THEN '' ELSE CASE WHEN length(a) = 0 THEN 'DuplicateTarget' ELSE '' END END AS problems,
     CASE WHEN k IN (5, 6) THEN 1 ELSE 2 END AS n_commands FROM e),
r AS (SELECT *, CASE WHEN problems <> '' THEN 'Refused' WHEN k = 6 THEN 'NoChange' ELSE 'Applied' END AS outcome FROM o)
SELECT doc_id, outcome, CAST(n_commands AS BIGINT) AS n_commands, CAST(CASE WHEN outcome <> 'Applied' THEN 0 WHEN k = 0 AND z = '' THEN 1 ELSE 2 END AS BIGINT) AS n_changed, problems, true AS restored,
  sha256(array_to_string(CASE WHEN outcome <> 'Applied' THEN ls WHEN k = 0 THEN list_concat(['new ' || a], ls[2:n - 1], ['']) WHEN k = 3 THEN list_concat(['<b>all'], ls[2:n]) ELSE list_concat(['<b></b>tail'], ls[2:n]) END, chr(10))) AS text_sha256 FROM r""",
    "merge_schema_bindings": f"""WITH {_MERGE} SELECT doc_id, field, field_type, required, ordinal, "column", status, len(reasons) > 0 AS blocking, array_to_string(reasons, ',') AS reasons FROM bi""",
    "merge_schema_plans": f"""WITH {_MERGE},
re AS (SELECT doc_id, unnest(reasons) AS reason FROM bi UNION ALL SELECT doc_id, 'source_schema_duplicate_column' FROM co GROUP BY doc_id, name HAVING count(*) > 1
  UNION ALL SELECT doc_id, 'source_schema_case_collision' FROM co GROUP BY doc_id, lower(name) HAVING count(*) > 1 UNION ALL SELECT doc_id, 'mail_merge_configuration_missing' FROM bi WHERE doc_id % 6 = 1),
g AS (SELECT doc_id, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM re GROUP BY doc_id),
u AS (SELECT doc_id, count(*) AS n FROM co WHERE (doc_id, ordinal) NOT IN (SELECT (doc_id, ordinal) FROM bi WHERE ordinal IS NOT NULL) GROUP BY doc_id)
SELECT b.doc_id, g.reasons IS NULL AS can_bind, coalesce(g.reasons, '') AS reasons, count(*) AS n_fields, count(ordinal) AS n_resolved, coalesce(any_value(u.n), 0) AS n_unused FROM bi b LEFT JOIN g USING (doc_id) LEFT JOIN u USING (doc_id) GROUP BY b.doc_id, g.reasons""",
}
