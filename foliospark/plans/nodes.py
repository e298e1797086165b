"""Queries over the node model of documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import query as q
from foliospark.operators import ranking
from foliospark.sources import table
from foliospark.sources.projectors import conversation_nodes, document_nodes, page_nodes, page_tokens


def _documents(spark, sf_dir):
    return document_nodes(table(spark, sf_dir, "documents"))


def query_paragraph_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of English documents that hold a phrase, with category and preview."""
    nodes = q.with_props(q.of_kinds(_documents(spark, sf_dir), ["paragraph"]), {"lang": "en"})
    return q.preview(nodes.where(q.text_matches(F.col("text"), "license")))


def query_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of one source and language, by properties."""
    return q.with_props(q.of_kinds(_documents(spark, sf_dir), ["document"]), {"lang": "de", "source": "src0"}).select("doc_id", "ord", "subtree_end")


def query_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of the paragraphs that begin with a word, in document order."""
    nodes = q.of_kinds(_documents(spark, sf_dir), ["paragraph"])
    hits = nodes.where(q.text_matches(F.col("text"), "The ", "startswith", ignore_case=False)).select("doc_id", "ord", "text")
    return q.page(hits, ["doc_id", "ord"], offset=50, limit=80)


def query_match_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many paragraphs each text mode matches."""
    nodes = q.of_kinds(_documents(spark, sf_dir), ["paragraph"])
    modes = ("contains", "equals", "startswith", "endswith")
    return nodes.agg(*[F.count_if(q.text_matches(F.col("text"), "the.", m)).alias(f"n_{m}") for m in modes])


def query_subtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each document's subtree, by digest, length and whether it ends with a stop."""
    text = q.subtree_text(_documents(spark, sf_dir).where("kind = 'paragraph'"))
    return text.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("chars"), F.endswith("text", F.lit(".")).alias("ends_with_stop"))


def query_public_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperlinks of pages with the properties that a projection may show."""
    nodes = q.of_kinds(page_nodes(table(spark, sf_dir, "pages")), ["hyperlink"])
    shown = q.public_props(nodes.withColumn("props", F.map_concat("props", F.create_map(F.lit("name"), F.col("text")))))
    return shown.select("doc_id", "ord", F.element_at("props", F.lit("href")).alias("href"), F.map_contains_key("props", "name").alias("has_name"))


def has_ancestor_island(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hyperlinks of pages inside a navigation or footer element."""
    nodes = page_nodes(table(spark, sf_dir, "pages"))
    islands = nodes.where((F.col("kind") == "island") & F.element_at("props", F.lit("tag")).isin("nav", "footer"))
    return q.has_ancestor(nodes.where("kind = 'hyperlink'"), islands).select("doc_id", "ord", F.element_at("props", F.lit("href")).alias("href"))


def has_descendant_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies and islands of pages that hold a paragraph."""
    nodes = page_nodes(table(spark, sf_dir, "pages"))
    return q.has_descendant(nodes.where("kind in ('body', 'island')"), nodes.where("kind = 'paragraph'")).select("doc_id", "ord", "kind", "subtree_end")


def kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of all projectors by origin and kind."""
    parts = [
        (_documents(spark, sf_dir), "documents"), (page_nodes(table(spark, sf_dir, "pages")), "pages"),
        (conversation_nodes(table(spark, sf_dir, "conversations")), "conversations"),
    ]
    each = [n.groupBy("kind").agg(F.count("*").alias("n")).withColumn("origin", F.lit(o)) for n, o in parts]
    return each[0].unionByName(each[1]).unionByName(each[2])


def property_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences and distinct values of each property of document nodes."""
    pairs = _documents(spark, sf_dir).select(F.explode("props").alias("name", "value"))
    return pairs.groupBy("name").agg(F.count("*").alias("occurrences"), F.countDistinct("value").alias("distinct_values"))


def doc_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, characters and paragraphs per document."""
    words = F.size(F.filter(F.split("text", r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))
    nodes = _documents(spark, sf_dir).where("kind = 'paragraph'")
    return nodes.groupBy("doc_id").agg(
        F.sum(words).cast("long").alias("words"), F.sum(F.length("text")).cast("long").alias("chars"), F.count_if(F.trim("text") != "").alias("paragraphs")
    )


def reading_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minutes and seconds to read each document at 200 words a minute, rounded half to even."""
    stats = doc_statistics(spark, sf_dir)
    return stats.select(
        "doc_id", "words", F.bround(F.col("words") / F.lit(200.0), 1).alias("minutes"), F.bround(F.col("words") * F.lit(60.0) / F.lit(200.0), 0).cast("long").alias("seconds")
    )


def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive search over non-empty paragraphs of documents and conversations, text cut to 300 characters."""
    docs = _documents(spark, sf_dir).where("kind = 'paragraph'").withColumn("origin", F.lit("document"))
    turns = conversation_nodes(table(spark, sf_dir, "conversations")).withColumn("origin", F.lit("conversation"))
    nodes = docs.unionByName(turns).where(F.trim("text") != "")
    return nodes.where(q.text_matches(F.col("text"), "License")).select("origin", "doc_id", "ord", F.substring("text", 1, 300).alias("text"))


def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of a pattern for mail addresses, per paragraph."""
    nodes = _documents(spark, sf_dir).where("kind = 'paragraph'")
    return q.search_regex(nodes, "[a-z0-9]+@[a-z0-9]+[.][a-z.]+").select("doc_id", "ord", F.col("match_no").cast("long").alias("match_no"), "match")


def page_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening and closing tags of pages by name."""
    return page_tokens(table(spark, sf_dir, "pages")).groupBy("tag").agg(F.count_if(~F.col("is_close")).alias("opened"), F.count_if("is_close").alias("closed"))


def _catalogue(spark, sf_dir):
    """Parts as named steps with descriptions, plan and apply steps among them, and queries over them: names, plurals, parts of words and steps."""
    part = table(spark, sf_dir, "part")
    base = F.concat_ws("_", F.replace("p_name", F.lit(" "), F.lit("_")), F.col("p_partkey").cast("string"))
    key = F.col("p_partkey")
    names = F.filter(F.array(F.concat(F.lit("plan_"), base), F.when(key % 2 == 0, F.concat(F.lit("apply_"), base)), F.when(key % 5 == 0, F.concat(F.lit("plan_"), base, F.lit("_apply"))), F.when(key % 7 == 0, F.concat(base, F.lit(".info")))), lambda x: x.isNotNull())
    entries = part.select(F.explode(names).alias("name"), F.concat_ws(" ", "p_type", "p_brand", F.when(key % 3 == 0, F.col("p_name")), F.concat(F.lit("size:"), F.col("p_size").cast("string"))).alias("description"))
    first, last = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    texts = F.array(F.concat(F.lit("Apply "), "p_name", F.lit("s")), F.concat(F.lit("plan "), last), F.substring("p_name", 2, 3), F.concat(last, F.lit(" "), first), F.concat_ws(" ", F.col("p_name"), F.col("p_partkey").cast("string")), F.concat(last, F.lit("-small  brand#1")))
    queries = part.groupBy("p_name").agg(F.min("p_partkey").alias("p_partkey")).select("p_partkey", F.posexplode(texts).alias("k", "text"))
    return entries, queries.select(F.concat_ws(":", F.col("p_partkey").cast("string"), F.col("k").cast("string")).alias("query"), "text")


def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best twelve steps of every query, with the features that rank them."""
    return ranking.ranked(*_catalogue(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


_PARAGRAPHS = """
p AS (SELECT doc_id, lang, source, CAST(generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS BIGINT) AS ord,
             unnest(string_split(coalesce(text, ''), chr(10))) AS text FROM documents)"""
_TOKENS = r"""
k AS (SELECT page_id AS doc_id, CAST(generate_subscripts(regexp_extract_all(html, '<[^>]+>[^<]*'), 1) AS BIGINT) AS ord,
             unnest(regexp_extract_all(html, '<[^>]+>[^<]*')) AS token FROM pages),
t AS (SELECT doc_id, ord, regexp_extract(token, '^</?([A-Za-z0-9!]+)', 1) AS tag, starts_with(token, '</') AS is_close,
             regexp_extract(token, '^<[^ >]+([^>]*)>', 1) AS attrs, regexp_extract(token, '^<[^>]+>([^<]*)$', 1) AS text FROM k)"""
_PAGES = _TOKENS + """,
bal AS (SELECT *, count(*) FILTER (NOT is_close) OVER w AS o, count(*) FILTER (is_close) OVER w AS c FROM t WHERE tag IN ('article', 'h1', 'p', 'b', 'br', 'a', 'li', 'nav', 'footer', 'script', 'style') WINDOW w AS (PARTITION BY doc_id, tag ORDER BY ord)),
e AS (SELECT a.*, (SELECT min(b.ord) FROM bal b WHERE b.doc_id = a.doc_id AND b.tag = a.tag AND b.is_close AND b.ord > a.ord AND b.o - a.o = b.c - a.c - 1) AS "end" FROM bal a),
n AS (SELECT doc_id, ord, coalesce("end", ord) AS subtree_end, tag, text, regexp_extract(attrs, 'href="([^"]*)"', 1) AS href,
             CASE tag WHEN 'article' THEN 'body' WHEN 'h1' THEN 'heading' WHEN 'p' THEN 'paragraph' WHEN 'b' THEN 'run' WHEN 'br' THEN 'break'
                      WHEN 'a' THEN 'hyperlink' WHEN 'li' THEN 'list_paragraph' ELSE 'island' END AS kind
      FROM e WHERE NOT is_close)"""

QUERIES = {
    f.__name__: f
    for f in (
        query_paragraph_text, query_by_property, query_page, query_match_modes, query_subtree, query_public_props, has_ancestor_island,
        has_descendant_paragraph, kind_counts, property_counts, doc_statistics, reading_time, search_text, search_regex, page_tag_counts, ranked_search,
    )
}
ORACLES = {
    "query_paragraph_text": f"""WITH {_PARAGRAPHS}
SELECT doc_id, ord, 'paragraph' AS kind, 'block' AS category, substring(text, 1, 400) AS preview, length(text) > 400 AS truncated
FROM p WHERE lang = 'en' AND contains(lower(text), 'license')""",
    "query_by_property": """SELECT doc_id, CAST(0 AS BIGINT) AS ord, CAST(len(string_split(text, chr(10))) AS BIGINT) AS subtree_end
FROM documents WHERE lang = 'de' AND source = 'src0'""",
    "query_page": f"""WITH {_PARAGRAPHS}, h AS (SELECT doc_id, ord, text FROM p WHERE starts_with(text, 'The '))
SELECT doc_id, ord, text, (SELECT count(*) FROM h) AS matched,
       CASE WHEN 130 < (SELECT count(*) FROM h) THEN CAST(130 AS BIGINT) END AS next_offset
FROM h ORDER BY doc_id, ord LIMIT 80 OFFSET 50""",
    "query_match_modes": f"""WITH {_PARAGRAPHS}
SELECT count(*) FILTER (contains(lower(text), 'the.')) AS n_contains, count(*) FILTER (lower(text) = 'the.') AS n_equals,
       count(*) FILTER (starts_with(lower(text), 'the.')) AS n_startswith, count(*) FILTER (ends_with(lower(text), 'the.')) AS n_endswith FROM p""",
    "query_subtree": f"""WITH {_PARAGRAPHS}, s AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY ord) AS text FROM p WHERE text <> '' GROUP BY doc_id)
SELECT doc_id, sha256(text) AS text_sha256, CAST(length(text) AS BIGINT) AS chars, ends_with(text, '.') AS ends_with_stop FROM s""",
    "query_public_props": f"""WITH {_PAGES} SELECT doc_id, ord, substring(href, 1, 160) AS href, false AS has_name FROM n WHERE kind = 'hyperlink'""",
    "has_ancestor_island": f"""WITH {_PAGES}
SELECT doc_id, ord, href FROM n WHERE kind = 'hyperlink' AND EXISTS (
  SELECT 1 FROM n a WHERE a.tag IN ('nav', 'footer') AND a.doc_id = n.doc_id AND a.ord < n.ord AND n.ord <= a.subtree_end)""",
    "has_descendant_paragraph": f"""WITH {_PAGES}
SELECT doc_id, ord, kind, subtree_end FROM n WHERE kind IN ('body', 'island') AND EXISTS (
  SELECT 1 FROM n d WHERE d.kind = 'paragraph' AND d.doc_id = n.doc_id AND n.ord < d.ord AND d.ord <= n.subtree_end)""",
    "kind_counts": f"""WITH {_PARAGRAPHS}, {_PAGES}
SELECT 'documents' AS origin, 'document' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'documents', 'paragraph', count(*) FROM p
UNION ALL SELECT 'pages', kind, count(*) FROM n GROUP BY kind UNION ALL SELECT 'conversations', 'paragraph', count(*) FROM conversations""",
    "property_counts": f"""WITH {_PARAGRAPHS}, v AS (
  SELECT 'lang' AS name, lang AS value FROM p UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents)
SELECT name, count(*) AS occurrences, count(DISTINCT value) AS distinct_values FROM v GROUP BY name""",
    "doc_statistics": rf"""WITH {_PARAGRAPHS}
SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+'))) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS chars,
       count(*) FILTER (trim(text) <> '') AS paragraphs FROM p GROUP BY doc_id""",
    "reading_time": rf"""WITH {_PARAGRAPHS}, s AS (SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+'))) AS BIGINT) AS words FROM p GROUP BY doc_id)
SELECT doc_id, words, round_even(words / 200.0, 1) AS minutes, CAST(round_even(words * 60.0 / 200.0, 0) AS BIGINT) AS seconds FROM s""",
    "search_text": f"""WITH {_PARAGRAPHS}, a AS (
  SELECT 'document' AS origin, doc_id, ord, text FROM p UNION ALL SELECT 'conversation', conv_id, CAST(turn + 1 AS BIGINT), text FROM conversations)
SELECT origin, doc_id, ord, substring(text, 1, 300) AS text FROM a WHERE trim(text) <> '' AND contains(lower(text), 'license')""",
    "search_regex": f"""WITH {_PARAGRAPHS}, m AS (SELECT doc_id, ord, regexp_extract_all(text, '[a-z0-9]+@[a-z0-9]+[.][a-z.]+') AS f FROM p)
SELECT doc_id, ord, CAST(generate_subscripts(f, 1) - 1 AS BIGINT) AS match_no, unnest(f) AS match FROM m""",
    "page_tag_counts": f"""WITH {_TOKENS} SELECT tag, count(*) FILTER (NOT is_close) AS opened, count(*) FILTER (is_close) AS closed FROM t GROUP BY tag""",
    "ranked_search": r"""WITH b AS (SELECT *, replace(p_name, ' ', '_') || '_' || p_partkey AS base FROM part),
en AS (SELECT unnest(list_filter(['plan_' || base, CASE WHEN p_partkey % 2 = 0 THEN 'apply_' || base END, CASE WHEN p_partkey % 5 = 0 THEN 'plan_' || base || '_apply' END, CASE WHEN p_partkey % 7 = 0 THEN base || '.info' END], lambda x: x IS NOT NULL)) AS name,
              concat_ws(' ', p_type, p_brand, CASE WHEN p_partkey % 3 = 0 THEN p_name END, 'size:' || p_size) AS description FROM b),
nm AS (SELECT p_name, min(p_partkey) AS k FROM part GROUP BY p_name),
qt AS (SELECT k, unnest(range(6)) AS i, unnest(['Apply ' || p_name || 's', 'plan ' || string_split(p_name, ' ')[-1], substring(p_name, 2, 3), string_split(p_name, ' ')[-1] || ' ' || string_split(p_name, ' ')[1], p_name || ' ' || k, string_split(p_name, ' ')[-1] || '-small  brand#1']) AS text FROM nm),
q AS (SELECT k || ':' || i AS query, list_filter(regexp_split_to_array(lower(text), '[ \-_/.:]+'), lambda x: x <> '') AS ts FROM qt),
e AS (SELECT name, list_filter(regexp_split_to_array(lower(name), '[ \-_/.:]+'), lambda x: x <> '') AS ns, lower(array_to_string(list_filter(regexp_split_to_array(description, '[ \-_/.:]+'), lambda x: x <> ''), ' ')) AS d,
  starts_with(name, 'plan_') AND (('apply_' || substring(name, 6)) IN (SELECT name FROM en) OR (ends_with(name, '_apply') AND ('apply_' || substring(name, 6, length(name) - 11)) IN (SELECT name FROM en))) AS plans,
  starts_with(name, 'apply_') AND (('plan_' || substring(name, 7)) IN (SELECT name FROM en) OR ('plan_' || substring(name, 7) || '_apply') IN (SELECT name FROM en)) AS applies FROM en),
h AS (SELECT *, list_transform(ts, lambda t: list_transform(ns, lambda n: n = t OR n = t || 's' OR t = n || 's' OR (t LIKE '%y' AND n = left(t, -1) || 'ies') OR (n LIKE '%y' AND t = left(n, -1) || 'ies'))) AS m,
      list_contains(ts, 'apply') AND NOT list_contains(ts, 'plan') AS ex FROM e CROSS JOIN q),
p1 AS (SELECT *, coalesce(list_position(m[1], true), 0) AS a FROM h), p2 AS (SELECT *, CASE WHEN a > 0 AND len(ts) > 1 THEN coalesce(list_position(m[2][a + 1:], true), 0) + CASE WHEN list_position(m[2][a + 1:], true) > 0 THEN a ELSE 0 END ELSE 0 END AS b FROM p1),
p3 AS (SELECT *, CASE WHEN b > 0 AND len(ts) > 2 THEN coalesce(list_position(m[3][b + 1:], true), 0) + CASE WHEN list_position(m[3][b + 1:], true) > 0 THEN b ELSE 0 END ELSE 0 END AS c FROM p2),
f AS (SELECT query, name, CAST(array_to_string(ns, ' ') = array_to_string(ts, ' ') AS INTEGER) AS exact, CAST(ex AND applies AS INTEGER) AS explicit, CAST(contains(array_to_string(ns, ' '), array_to_string(ts, ' ')) AS INTEGER) AS phrase,
  CAST(len(list_filter(m, lambda x: list_contains(x, true))) AS INTEGER) AS name_hits, CAST(NOT ex AND plans AS INTEGER) AS safety,
  CAST(CASE WHEN (CASE WHEN a > 0 THEN 1 ELSE 0 END + CASE WHEN b > 0 THEN 1 ELSE 0 END + CASE WHEN c > 0 THEN 1 ELSE 0 END) < len(ts) THEN 10000 + len(ns) - (CASE WHEN a > 0 THEN 1 ELSE 0 END + CASE WHEN b > 0 THEN 1 ELSE 0 END + CASE WHEN c > 0 THEN 1 ELSE 0 END)
       ELSE (greatest(a, b, c) - a + 1 - len(ts)) * 100 + abs(len(ns) - len(ts)) END AS INTEGER) AS distance, CAST(len(list_filter(ts, lambda t: contains(d, t))) AS INTEGER) AS description_hits FROM p3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY exact DESC, explicit DESC, phrase DESC, name_hits DESC, safety DESC, distance, description_hits DESC, name) AS "rank" FROM f WHERE exact + phrase + name_hits + description_hits > 0) WHERE "rank" <= 12""",
}
