"""Queries of markup, styles, roles, layout and record controls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import styles as st
from foliospark.operators import template
from foliospark.sources import inline, markup, table
from foliospark.sources.projectors import document_nodes, page_nodes


def _as_markdown(spark, sf_dir):
    """Conversations as Markdown documents: user turns are headings, system turns quotes, every third other turn a list item."""
    turns = table(spark, sf_dir, "conversations")
    mark = F.when(F.col("role") == "user", "## ").when(F.col("role") == "system", "> ").when(F.col("turn") % 3 == 0, "- ").otherwise("")
    line = F.concat(mark, F.regexp_replace("text", "\n", " "))
    ordered = F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of Markdown documents by kind."""
    blocks = markup.markdown_blocks(_as_markdown(spark, sf_dir))
    return blocks.groupBy("doc_id", "kind").agg(F.count("*").alias("blocks"), F.sum("n_lines").alias("lines"), F.sum(F.length("text")).cast("long").alias("chars"))


def export_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of pages as Markdown lines, by digest per page."""
    nodes = page_nodes(table(spark, sf_dir, "pages")).where("kind in ('heading', 'paragraph', 'list_paragraph')")
    lines = nodes.select("doc_id", F.struct("ord", markup.to_markdown(F.col("kind"), F.lit(1), F.col("text")).alias("line")).alias("x"))
    whole = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    text = F.array_join(F.transform("xs", lambda x: x["line"]), "\n")
    return whole.select("doc_id", F.sha2(text, 256).alias("markdown_sha256"), F.length(text).cast("long").alias("chars"))


def export_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as HTML, by digest."""
    html = markup.to_html(document_nodes(table(spark, sf_dir, "documents")).where("kind = 'paragraph'"))
    return html.select("doc_id", F.sha2("html", 256).alias("html_sha256"), F.length("html").cast("long").alias("chars"))


def csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read as CSV: rows padded to the widest of their document, and how many cells were added."""
    rows = markup.csv_rows(table(spark, sf_dir, "documents"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"), F.max("width").cast("long").alias("width"), F.sum(F.size("cells")).cast("long").alias("cells"), F.sum(F.size(F.filter("cells", lambda x: x == ""))).cast("long").alias("empty_cells"))


def effective_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective properties of orders: defaults, two style levels from the lines' flags, and direct values."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    one = li.groupBy("l_orderkey").agg(F.min("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"), F.count("*").alias("n"))
    entry = lambda level, source, name, value: F.struct(F.lit(level).alias("level"), F.lit(source).alias("source"), F.lit(name).alias("name"), value.alias("value"))
    yes = lambda c: F.when(c, "true").otherwise("false")
    rows = one.select("l_orderkey", F.inline(F.array(
        entry(0, "default", "bold", yes(F.col("n") > 4)), entry(1, "style", "bold", yes(F.col("flag") == "A")), entry(2, "style", "bold", yes(F.col("status") == "O")),
        entry(0, "default", "size", F.lit("11")), entry(1, "style", "size", F.concat(F.col("n").cast("string"))), entry(3, "direct", "font", F.col("flag")), entry(1, "style", "font", F.lit("N")),
    )))
    return st.cascade(rows, ["l_orderkey"])


def equivalent_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share size, brand and type: styles with equal formatting."""
    return st.equivalent_styles(table(spark, sf_dir, "part"), "p_partkey", ["p_size", "p_brand"]).select("n", "first_style")


def role_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of parts' texts: a lexical label from the type, a declared one by key; conflicts carry no role."""
    lex = st.lexical_role(F.concat(F.when(F.col("p_size") % 3 == 0, "Theorem 1. ").when(F.col("p_size") % 3 == 1, "proofs ").otherwise("Dowód: "), F.col("p_name")))
    parts = table(spark, sf_dir, "part").select("p_partkey", lex.alias("lex"))
    lexical = parts.where("lex is not null").select("p_partkey", F.col("lex").alias("role"), F.lit(False).alias("declared"), F.lit(True).alias("lexical"))
    declared = parts.where("p_partkey % 4 = 0").select("p_partkey", F.lit("Theorem").alias("role"), F.lit(True).alias("declared"), F.lit(False).alias("lexical"))
    return st.classify_roles(lexical.unionByName(declared), ["p_partkey"])


def table_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders (tables) too wide for the section that ends after them: every seventh order of a customer ends one."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ord"), F.floor(F.col("o_totalprice") / 20).cast("long").alias("width"))
    key = F.col("ord")
    ends = orders.where(key % 7 == 0).select("doc", "ord", F.lit(12240).cast("long").alias("page"), F.lit(1440).cast("long").alias("left"), F.lit(1440).cast("long").alias("right"), F.lit(720).cast("long").alias("spacing"), (1 + key % 2).alias("cols"))
    return st.table_overflow(orders.where(key % 7 != 0), ends)


def theme_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' sizes as a colour channel, made darker and lighter."""
    return table(spark, sf_dir, "part").select("p_partkey", st.shade(F.col("p_size") * 5, 0.25).alias("shade"), st.tint(F.col("p_size") * 5, 0.5).alias("tint"))


def recipient_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipients by how they can be told apart: a unique tag, an ambiguous one, or none."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") < 0, None).otherwise(F.concat("c_mktsegment", (F.col("c_custkey") % 700).cast("string"))).alias("tag"))
    n = rows.where("tag is not null").groupBy("tag").agg(F.count("*").alias("n"))
    kind = F.when(F.col("tag").isNull(), "Missing").when(F.col("n") == 1, "UniqueTag").otherwise("Ambiguous")
    return rows.join(n, "tag", "left").select("c_custkey", kind.alias("identity"))


def merge_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents' nodes as one: the second's places and ids follow the first's."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("ord"))
    first = turns.where("conv_id % 2 = 0").select((F.col("conv_id") / 2).cast("long").alias("doc_id"), "ord")
    length = first.groupBy("doc_id").agg((F.max("ord") + 1).alias("shift"))
    second = turns.where("conv_id % 2 = 1").select(F.floor(F.col("conv_id") / 2).cast("long").alias("doc_id"), "ord").join(length, "doc_id").select("doc_id", (F.col("ord") + F.col("shift")).alias("ord"))
    return first.unionByName(second).groupBy("doc_id").agg(F.count("*").alias("nodes"), F.countDistinct("ord").alias("places"), F.max("ord").alias("last"))


def replace_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first occurrence of a word in each document replaced, with the text expected before; others untouched."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.locate(" the ", "text").alias("at"))
    new = F.concat(F.substr("text", F.lit(1), F.col("at")), F.lit("THE"), F.substr("text", F.col("at") + 4))
    return rows.where("at > 0").select("doc_id", F.col("at").cast("long").alias("at"), F.sha2(new, 256).alias("new_sha256"))


_MD = """md AS (SELECT conv_id AS doc_id, turn, CASE WHEN role = 'user' THEN 'heading' WHEN role = 'system' THEN 'quote' WHEN turn % 3 = 0 THEN 'list' ELSE 'paragraph' END AS kind,
  length(text) AS n FROM conversations),
b AS (SELECT *, CASE WHEN kind NOT IN ('heading', 'list') AND lag(kind) OVER (PARTITION BY doc_id ORDER BY turn) = kind THEN 0 ELSE 1 END AS new FROM md)"""
_NODES = r"""k AS (SELECT page_id AS doc_id, CAST(generate_subscripts(regexp_extract_all(html, '<[^>]+>[^<]*'), 1) AS BIGINT) AS ord, unnest(regexp_extract_all(html, '<[^>]+>[^<]*')) AS token FROM pages),
t AS (SELECT doc_id, ord, regexp_extract(token, '^</?([A-Za-z0-9!]+)', 1) AS tag, regexp_extract(token, '^<[^>]+>([^<]*)$', 1) AS text FROM k WHERE NOT starts_with(token, '</'))"""

def csv_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as CSV texts with commas, quotes and line ends inside their fields, read back: cells by digest."""
    lines = document_nodes(table(spark, sf_dir, "documents")).where("kind = 'paragraph'")
    odd = F.when(F.col("ord") % 4 == 0, F.concat("text", F.lit(',"x"\n'), "text")).when(F.col("ord") % 4 == 1, F.concat(F.lit('"'), "text")).when(F.col("ord") % 4 == 2, F.concat("text", F.lit("\r\nend"))).otherwise(F.col("text"))
    rows = lines.select("doc_id", "ord", F.col("ord").cast("string").alias("n"), odd.alias("odd"), F.lit("").alias("none"))
    rows = rows.select("doc_id", F.struct("ord", template.to_csv_line(["n", "odd", "none"]).alias("line")).alias("x"))
    texts = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"]), "\r\n").alias("text"))
    cells = markup.csv_cells(texts)
    return cells.select("doc_id", "row", "column", F.length("value").cast("long").alias("chars"), F.sha2("value", 256).alias("value_sha256"))


def markdown_inline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with every other word marked as strong, emphasised, code, deleted or a link, read back: the plain text and the spans over it."""
    lines = document_nodes(table(spark, sf_dir, "documents")).where("kind = 'paragraph'")
    safe = lambda w: F.regexp_replace(w, r"([!-/:-@\[-`{-~])", r"\\$1")

    def marked(w, i):
        k = (i + 1) % 7
        return (
            F.when(k == 1, F.concat(F.lit("**"), safe(w), F.lit("**"))).when(k == 3, F.concat(F.lit("*"), safe(w), F.lit("*"))).when((k == 5) & ~F.contains(w, F.lit("`")), F.concat(F.lit("`"), w, F.lit("`")))
            .when(k == 6, F.concat(F.lit("~~"), safe(w), F.lit("~~"))).when(k == 0, F.concat(F.lit("["), safe(w), F.lit("](http://x/"), (i + 1).cast("string"), F.lit(")"))).otherwise(safe(w))
        )

    words = F.regexp_extract_all("text", F.lit("[^ \t\r\n\f\x0B]+"), 0)
    read = inline.inline_marks(lines.select("doc_id", "ord", F.array_join(F.transform(words, marked), " ").alias("text")))
    said = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"), x["target"])), ",")
    return read.select("doc_id", "ord", F.sha2("plain", 256).alias("plain_sha256"), F.size("spans").cast("long").alias("n_spans"), F.sha2(said, 256).alias("spans_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        markdown_blocks, export_markdown, export_html, csv_tables, csv_quoted, markdown_inline, effective_formatting, equivalent_styles, role_labels, table_overflow, theme_colours, recipient_identity, merge_documents, replace_first,
    )
}
_LINES = "SELECT doc_id, CAST(generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS BIGINT) AS ord, unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents"
ORACLES = {
    "csv_quoted": f"""WITH l AS ({_LINES}),
c AS (SELECT doc_id, ord - 1 AS "row", CAST(ord AS VARCHAR) AS n, CASE ord % 4 WHEN 0 THEN text || ',"x"' || chr(10) || text WHEN 1 THEN '"' || text WHEN 2 THEN text || chr(13) || chr(10) || 'end' ELSE text END AS odd FROM l),
v AS (SELECT doc_id, "row", CAST(0 AS BIGINT) AS "column", n AS value FROM c UNION ALL SELECT doc_id, "row", 1, odd FROM c UNION ALL SELECT doc_id, "row", 2, '' FROM c)
SELECT doc_id, "row", "column", CAST(length(value) AS BIGINT) AS chars, sha256(value) AS value_sha256 FROM v""",
    "markdown_inline": rf"""WITH l AS ({_LINES}), w AS (SELECT doc_id, ord, regexp_extract_all(text, '[^ \t\r\n\f\x0B]+') AS ws FROM l),
e AS (SELECT doc_id, ord, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
p AS (SELECT *, CAST(sum(length(word) + 1) OVER (PARTITION BY doc_id, ord ORDER BY i) AS BIGINT) - 1 AS e FROM e),
s AS (SELECT doc_id, ord, i, CASE i % 7 WHEN 1 THEN 'strong' WHEN 3 THEN 'emphasis' WHEN 5 THEN 'code' WHEN 6 THEN 'deleted' ELSE 'link' END || ':' || (e - length(word)) || ':' || e || CASE WHEN i % 7 = 0 THEN ':http://x/' || i ELSE '' END AS said
  FROM p WHERE i % 7 NOT IN (2, 4) AND NOT (i % 7 = 5 AND contains(word, '`'))),
g AS (SELECT doc_id, ord, count(*) AS n, string_agg(said, ',' ORDER BY i) AS said FROM s GROUP BY ALL)
SELECT doc_id, ord, sha256(array_to_string(ws, ' ')) AS plain_sha256, coalesce(n, 0) AS n_spans, sha256(coalesce(said, '')) AS spans_sha256 FROM w LEFT JOIN g USING (doc_id, ord)""",
    "markdown_blocks": f"""WITH {_MD} SELECT doc_id, kind, CAST(sum(new) AS BIGINT) AS blocks, count(*) AS lines, CAST(sum(n) + count(*) - sum(new) AS BIGINT) AS chars FROM b GROUP BY doc_id, kind""",
    "export_markdown": f"""WITH {_NODES}, m AS (SELECT doc_id, string_agg(CASE tag WHEN 'h1' THEN '# ' WHEN 'li' THEN '- ' ELSE '' END || text, chr(10) ORDER BY ord) AS s FROM t WHERE tag IN ('h1', 'p', 'li') GROUP BY doc_id)
SELECT doc_id, sha256(s) AS markdown_sha256, CAST(length(s) AS BIGINT) AS chars FROM m""",
    "export_html": """WITH p AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS ord, unnest(string_split(text, chr(10))) AS t FROM documents),
h AS (SELECT doc_id, string_agg('<p>' || replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</p>', '' ORDER BY ord) AS s FROM p GROUP BY doc_id)
SELECT doc_id, sha256(s) AS html_sha256, CAST(length(s) AS BIGINT) AS chars FROM h""",
    "csv_tables": """WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, string_split(line, ',') AS cells FROM r WHERE line <> ''),
w AS (SELECT *, max(len(cells)) OVER (PARTITION BY doc_id) AS width FROM c)
SELECT doc_id, count(*) AS n_rows, max(width) AS width, CAST(sum(width) AS BIGINT) AS cells, CAST(sum(width - len(list_filter(cells, lambda x: x <> ''))) AS BIGINT) AS empty_cells FROM w GROUP BY doc_id""",
    "effective_formatting": """WITH o AS (SELECT l_orderkey, min(l_returnflag) AS flag, max(l_linestatus) AS status, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, 'bold' AS name, CASE WHEN (CASE WHEN n > 4 THEN 1 ELSE 0 END + CASE WHEN flag = 'A' THEN 1 ELSE 0 END + CASE WHEN status = 'O' THEN 1 ELSE 0 END) % 2 = 1 THEN 'true' ELSE 'false' END AS value, 'style' AS origin FROM o
UNION ALL SELECT l_orderkey, 'size', CAST(n AS VARCHAR), 'style' FROM o UNION ALL SELECT l_orderkey, 'font', flag, 'direct' FROM o""",
    "equivalent_styles": "SELECT count(*) AS n, min(p_partkey) AS first_style FROM part GROUP BY p_size, p_brand HAVING count(*) > 1",
    "role_labels": """WITH p AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'Theorem' WHEN 1 THEN NULL ELSE 'Proof' END AS lex, p_partkey % 4 = 0 AS dec FROM part)
SELECT p_partkey, CASE WHEN dec AND lex <> 'Theorem' THEN 'Conflicting' WHEN dec THEN 'Declared' ELSE 'LexicalCandidate' END AS classification,
       CASE WHEN dec AND lex <> 'Theorem' THEN NULL WHEN dec THEN 'Theorem' ELSE lex END AS role FROM p WHERE dec OR lex IS NOT NULL""",
    "table_overflow": """WITH o AS (SELECT o_custkey AS doc, o_orderkey AS ord, CAST(floor(o_totalprice / 20) AS BIGINT) AS width FROM orders),
s AS (SELECT doc, ord, CAST(floor((12240 - 2880 - 720 * (ord % 2)) / (1 + ord % 2)) AS BIGINT) AS room FROM o WHERE ord % 7 = 0),
j AS (SELECT o.doc, o.ord, o.width, coalesce((SELECT arg_min(s.room, s.ord) FROM s WHERE s.doc = o.doc AND s.ord > o.ord), 9360) AS room FROM o WHERE o.ord % 7 <> 0)
SELECT * FROM j WHERE width > room""",
    "theme_colours": "SELECT p_partkey, CAST(round(p_size * 5 * 0.75) AS INTEGER) AS shade, CAST(round(p_size * 5 + (255 - p_size * 5) * 0.5) AS INTEGER) AS tint FROM part",
    "recipient_identity": """WITH r AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment || (c_custkey % 700) END AS tag FROM customer)
SELECT c_custkey, CASE WHEN tag IS NULL THEN 'Missing' WHEN count(*) OVER (PARTITION BY tag) = 1 THEN 'UniqueTag' ELSE 'Ambiguous' END AS identity FROM r""",
    "merge_documents": """WITH t AS (SELECT conv_id, CAST(turn AS BIGINT) AS ord FROM conversations), f AS (SELECT CAST(conv_id / 2 AS BIGINT) AS doc_id, ord FROM t WHERE conv_id % 2 = 0),
l AS (SELECT doc_id, max(ord) + 1 AS shift FROM f GROUP BY doc_id),
m AS (SELECT * FROM f UNION ALL SELECT doc_id, ord + shift FROM (SELECT CAST((conv_id - 1) / 2 AS BIGINT) AS doc_id, ord FROM t WHERE conv_id % 2 = 1) JOIN l USING (doc_id))
SELECT doc_id, count(*) AS nodes, count(DISTINCT ord) AS places, max(ord) AS last FROM m GROUP BY doc_id""",
    "replace_first": """WITH d AS (SELECT doc_id, text, instr(text, ' the ') AS p FROM documents)
SELECT doc_id, CAST(p AS BIGINT) AS at, sha256(substring(text, 1, p) || 'THE' || substring(text, p + 4)) AS new_sha256 FROM d WHERE p > 0""",
}
