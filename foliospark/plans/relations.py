"""Queries of joins, graphs and references over the star schema's keys and the pages' links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.operators import graph as g
from foliospark.sources import table
from foliospark.sources.projectors import page_nodes


def _node(kind, key):
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def _edges(spark, sf_dir):
    """Foreign keys as dependency edges: order to customer, customer and supplier to nation, nation to region."""
    specs = [
        ("orders", "PlacedBy", "order", "o_orderkey", "customer", "o_custkey"), ("customer", "LivesIn", "customer", "c_custkey", "nation", "c_nationkey"),
        ("supplier", "BasedIn", "supplier", "s_suppkey", "nation", "s_nationkey"), ("nation", "PartOf", "nation", "n_nationkey", "region", "n_regionkey"),
    ]
    return g.union_edges(*[table(spark, sf_dir, t).select(F.lit(kind).alias("kind"), _node(a, ka).alias("src"), _node(b, kb).alias("dst")) for t, kind, a, ka, b, kb in specs])


def edge_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges, sources and targets by kind."""
    return _edges(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def node_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming and outgoing edges of every node."""
    return g.degree(_edges(spark, sf_dir))


def impact_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges within three steps against their direction from one region: what depends on it."""
    start = spark.sql("SELECT 'region:1' AS node")
    return g.impact(_edges(spark, sf_dir), start, "incoming", 3)


def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything reached from the orders of the first day of a year, and in how many steps, without a bound."""
    start = table(spark, sf_dir, "orders").where("o_orderdate >= '1995-01-01' and o_orderdate < '1995-01-02'").select(_node("order", "o_orderkey").alias("node"))
    return g.closure(_edges(spark, sf_dir), start).where("step > 0")


def inheritance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots and depths of chains: each part is based on the part with half its key."""
    key = F.col("p_partkey")
    links = table(spark, sf_dir, "part").select(key.alias("style"), F.when(key > 1, F.floor(key / 2)).alias("based_on"))
    return g.chain(links, "style", "based_on")


def style_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains over suppliers that end at a root, at a parent without a row, or never."""
    suppliers = table(spark, sf_dir, "supplier")
    key, n = F.col("s_suppkey"), suppliers.agg((F.max("s_suppkey") + 1).alias("n"))
    up = F.when(key % 5 == 0, F.lit(None)).when(key % 7 == 0, key + 100_000).otherwise((key * 3 + 1) % F.col("n"))
    return g.chain(suppliers.join(F.broadcast(n)).select(key.alias("style"), up.alias("based_on")), "style", "based_on")


def adjacency_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second to fourth of each node's incoming edges, sorted, and how many there are."""
    turned = _edges(spark, sf_dir).select("kind", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return g.adjacency(turned, offset=1, limit=3)


def _graph(spark, sf_dir):
    """The nodes of the foreign keys without every fiftieth customer, with nation 3 twice and parts that nothing refers to, and the edges."""
    specs = [("region", "region", "r_regionkey"), ("nation", "nation", "n_nationkey"), ("customer", "customer", "c_custkey"), ("supplier", "supplier", "s_suppkey"), ("orders", "order", "o_orderkey"), ("part", "part", "p_partkey")]
    nodes = g.union_edges(*[table(spark, sf_dir, t).select(_node(kind, key).alias("node"), F.lit(kind).alias("kind"), F.col(key).alias("key")) for t, kind, key in specs])
    nodes = nodes.where("not (kind = 'customer' and key % 50 = 7)")
    return nodes.unionByName(nodes.where("kind = 'nation' and key = 3")).drop("key"), _edges(spark, sf_dir)


def dependency_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of every view of the graph, by kinds, by a node in both directions, of what isn't resolved, of an impact and of issues."""
    nodes, edges = _graph(spark, sf_dir)
    views = {
        "nodes": g.view(nodes, edges, "nodes", node_kind="nation", offset=5, limit=10), "node": g.view(nodes, edges, "nodes", node="nation:3"), "incoming": g.view(nodes, edges, "edges", node="nation:3", direction="incoming", limit=20),
        "outgoing": g.view(nodes, edges, "edges", node="nation:3", direction="outgoing"), "kind": g.view(nodes, edges, "edges", edge_kind="BasedIn", offset=3), "unresolved": g.view(nodes, edges, "unresolved", limit=100),
        "missing": g.view(nodes, edges, "unresolved", node="order:1", direction="outgoing"), "impact": g.view(nodes, edges, "impact", node="nation:4", direction="both", depth=2, limit=50), "issues": g.view(nodes, edges, "issues", limit=40),
        "customers": g.view(nodes, edges, "issues", node_kind="nation"),
    }
    none = lambda kind: F.lit(None).cast(kind)
    wide = {"kind": "string", "node": "string", "src": "string", "dst": "string", "resolved": "boolean", "step": "int", "code": "string", "severity": "string", "n": "long"}
    each = [v.select(F.lit(name).alias("view"), *[F.col(c) if c in v.columns else none(t).alias(c) for c, t in wide.items()], "matched", "next_offset") for name, v in views.items()]
    return g.union_edges(*each)


def unresolved_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer, moved by twenty, doesn't exist: references whose target is missing."""
    refs = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") + 20).alias("ref"))
    return g.unresolved(refs, "ref", table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


def unique_key_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels resolved only where one text has the document's digest: copies are ambiguous."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("tag"))
    cited = table(spark, sf_dir, "labels").select("doc_id").join(docs, "doc_id")
    return g.unique_key_join(cited, "tag", docs.select("tag"), "tag").select("doc_id", "candidates", "status")


def note_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and their references in both directions: documents and labels, matched or missing on either side."""
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("note"))
    b = table(spark, sf_dir, "labels").select((F.col("doc_id") + 50).alias("ref"))
    both = a.join(b, F.col("note") == F.col("ref"), "full")
    status = F.when(F.col("ref").isNull(), "Unreferenced").when(F.col("note").isNull(), "Dangling").otherwise("Complete")
    return both.select("note", "ref", status.alias("status"))


def unused_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, moved by ten, that no order is placed by."""
    owners = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 10).alias("owner"), "c_name")
    return owners.join(table(spark, sf_dir, "orders"), F.col("owner") == F.col("o_custkey"), "left_anti")


def comment_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies by the turn they answer: only replies to a root count, as in a thread of depth one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role")
    roots = turns.where("role = 'user'").select("conv_id", F.col("turn").alias("root"))
    replies = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("root"), F.col("turn").alias("reply"))
    return roots.join(replies, ["conv_id", "root"], "left").groupBy("conv_id").agg(F.count("*").alias("threads"), F.count("reply").alias("replies"))


def figure_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors (figures) and the purchases and sign-ups (captions) of the same user within two events, with scores and status.

    A caption has a style where its value is over 50 and a sequence where its id isn't divisible by 4; sign-ups say figure.
    Candidates are looked up by user and exact place, so a busy user costs no more than four pairs a figure.
    """
    events = table(spark, sf_dir, "events")
    numbered = events.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")))
    figures = numbered.where("event_type = 'error'").select("user_id", F.col("event_id").alias("figure"), F.explode(F.array(*map(F.lit, (-2, -1, 1, 2)))).alias("distance"), "place")
    figures = figures.withColumn("place", F.col("place") + F.col("distance"))
    captions = numbered.where("event_type in ('purchase', 'signup')").select(
        "user_id", "place", F.col("event_id").alias("caption"), (F.col("value") > 50).alias("style"), (F.col("event_id") % 4 != 0).alias("sequence"), (F.col("event_type") == "signup").alias("says")
    )
    score = g.figure_score(F.col("distance"), F.col("style"), F.col("sequence"), F.col("says"))
    pairs = figures.join(captions, ["user_id", "place"]).select("figure", "caption", "distance", score.alias("score"))
    return g.associate(pairs, "figure", "caption", "score")


def external_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets of pages by mode, with how many pages hold them."""
    links = page_nodes(table(spark, sf_dir, "pages")).where("kind = 'hyperlink'").select("doc_id", F.element_at("props", F.lit("href")).alias("href"))
    mode = F.when(F.col("href") == "", "Invalid").when(F.regexp_like("href", F.lit("^[a-z]+:")), "External").otherwise("Internal")
    return links.groupBy("href", mode.alias("mode")).agg(F.count("*").alias("links"), F.countDistinct("doc_id").alias("pages"))


_E = """e AS (SELECT 'PlacedBy' AS kind, 'order:' || o_orderkey AS src, 'customer:' || o_custkey AS dst FROM orders
UNION ALL SELECT 'LivesIn', 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer
UNION ALL SELECT 'BasedIn', 'supplier:' || s_suppkey, 'nation:' || s_nationkey FROM supplier
UNION ALL SELECT 'PartOf', 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation)"""

QUERIES = {
    f.__name__: f
    for f in (
        edge_kind_counts, node_degree, impact_edges, reachability, inheritance_chain, unresolved_refs, unique_key_citations, note_full_outer,
        unused_relationships, comment_threads, figure_captions, external_links, style_cycles, adjacency_page, dependency_views,
    )
}
ORACLES = {
    "edge_kind_counts": f"WITH {_E} SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM e GROUP BY kind",
    "node_degree": f"""WITH {_E}, x AS (SELECT src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT dst, 0, 1 FROM e)
SELECT node, CAST(sum(o) AS BIGINT) AS outgoing, CAST(sum(i) AS BIGINT) AS incoming FROM x GROUP BY node""",
    "impact_edges": f"""WITH {_E},
s1 AS (SELECT * FROM e WHERE dst = 'region:1'), s2 AS (SELECT * FROM e WHERE dst IN (SELECT src FROM s1)), s3 AS (SELECT * FROM e WHERE dst IN (SELECT src FROM s2))
SELECT kind, src, dst, min(step) AS step FROM (SELECT *, 1 AS step FROM s1 UNION ALL SELECT *, 2 FROM s2 UNION ALL SELECT *, 3 FROM s3) GROUP BY kind, src, dst""",
    "reachability": f"""WITH {_E},
s0 AS (SELECT DISTINCT 'order:' || o_orderkey AS node FROM orders WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1995-01-02'),
s1 AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (SELECT node FROM s0)), s2 AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (SELECT node FROM s1)),
s3 AS (SELECT DISTINCT dst AS node FROM e WHERE src IN (SELECT node FROM s2))
SELECT node, min(step) AS step FROM (SELECT node, 1 AS step FROM s1 UNION ALL SELECT node, 2 FROM s2 UNION ALL SELECT node, 3 FROM s3) GROUP BY node""",
    "inheritance_chain": """WITH RECURSIVE c AS (SELECT p_partkey AS node, p_partkey AS spot, CAST(0 AS BIGINT) AS depth FROM part
UNION ALL SELECT node, CAST(floor(spot / 2) AS BIGINT), depth + 1 FROM c WHERE spot > 1) SELECT node, min(spot) AS root, max(depth) AS depth, 'Resolved' AS status FROM c GROUP BY node""",
    "style_cycles": """WITH RECURSIVE l AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 7 = 0 THEN s_suppkey + 100000 ELSE (s_suppkey * 3 + 1) % (SELECT max(s_suppkey) + 1 FROM supplier) END AS up FROM supplier),
c AS (SELECT node, node AS spot, CAST(0 AS BIGINT) AS depth FROM l UNION ALL SELECT c.node, l.up, c.depth + 1 FROM c JOIN l ON l.node = c.spot WHERE l.up IS NOT NULL AND c.depth < 1500),
e AS (SELECT node, max_by(spot, depth) AS spot, max(depth) AS depth FROM c GROUP BY node)
SELECT e.node, CASE WHEN depth < 1500 THEN spot END AS root, CASE WHEN depth < 1500 THEN depth END AS depth,
       CASE WHEN depth >= 1500 THEN 'Cycle' WHEN t.node IS NULL THEN 'Missing' ELSE 'Resolved' END AS status FROM e LEFT JOIN l t ON t.node = e.spot""",
    "adjacency_page": f"""WITH {_E}, p AS (SELECT src AS node, count(*) OVER (PARTITION BY src) AS outgoing, row_number() OVER (PARTITION BY src ORDER BY kind, dst) - 1 AS place, kind, dst
FROM (SELECT kind, dst AS src, src AS dst FROM e)) SELECT * FROM p WHERE place BETWEEN 1 AND 3""",
    "unresolved_refs": "SELECT o_orderkey, o_custkey + 20 AS ref FROM orders WHERE o_custkey + 20 NOT IN (SELECT c_custkey FROM customer)",
    "unique_key_citations": """WITH n AS (SELECT text, count(*) AS candidates FROM documents GROUP BY text)
SELECT l.doc_id, candidates, CASE WHEN candidates = 1 THEN 'Resolved' ELSE 'Ambiguous' END AS status FROM labels l JOIN documents d USING (doc_id) JOIN n ON n.text = d.text""",
    "note_full_outer": """WITH a AS (SELECT doc_id AS note FROM documents), b AS (SELECT doc_id + 50 AS ref FROM labels)
SELECT note, ref, CASE WHEN ref IS NULL THEN 'Unreferenced' WHEN note IS NULL THEN 'Dangling' ELSE 'Complete' END AS status FROM a FULL JOIN b ON note = ref""",
    "unused_relationships": "SELECT c_custkey + 10 AS owner, c_name FROM customer WHERE c_custkey + 10 NOT IN (SELECT o_custkey FROM orders)",
    "comment_threads": """WITH r AS (SELECT conv_id, turn AS root FROM conversations WHERE role = 'user'), p AS (SELECT conv_id, turn - 1 AS root, turn AS reply FROM conversations WHERE role = 'assistant')
SELECT conv_id, count(*) AS threads, count(reply) AS replies FROM r LEFT JOIN p USING (conv_id, root) GROUP BY conv_id""",
    "figure_captions": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events),
p AS (SELECT f.event_id AS figure, c.event_id AS caption, c.place - f.place AS d, c.value > 50 AS style, c.event_id % 4 <> 0 AS seq, c.event_type = 'signup' AS says
      FROM n f JOIN n c ON f.user_id = c.user_id AND c.place - f.place IN (-2, -1, 1, 2) WHERE f.event_type = 'error' AND c.event_type IN ('purchase', 'signup')),
s AS (SELECT figure, caption, CAST(d AS INTEGER) AS distance, greatest(0, least(100, CASE d WHEN 1 THEN 90 WHEN -1 THEN 85 WHEN 2 THEN 68 ELSE 63 END
        + CASE WHEN style AND seq THEN 5 WHEN NOT seq THEN -15 ELSE 0 END + CASE WHEN says THEN 3 ELSE 0 END)) AS score FROM p),
b AS (SELECT *, max(score) OVER (PARTITION BY figure) AS bf, max(score) OVER (PARTITION BY caption) AS bc FROM s),
t AS (SELECT *, sum(CASE WHEN score = bf THEN 1 ELSE 0 END) OVER (PARTITION BY figure) AS tf, sum(CASE WHEN score = bc THEN 1 ELSE 0 END) OVER (PARTITION BY caption) AS tc FROM b)
SELECT figure, caption, distance, score, CASE WHEN score = bf AND tf = 1 AND score = bc AND tc = 1 AND score >= 70 THEN 'Selected'
  WHEN (score = bf AND tf > 1) OR (score = bc AND tc > 1) THEN 'Ambiguous' ELSE 'Candidate' END AS status FROM t""",
    "external_links": """WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages)
SELECT href, CASE WHEN href = '' THEN 'Invalid' WHEN regexp_matches(href, '^[a-z]+:') THEN 'External' ELSE 'Internal' END AS mode,
       count(*) AS links, count(DISTINCT page_id) AS pages FROM a GROUP BY href""",
    "dependency_views": f"""WITH {_E},
nk AS (SELECT 'region:' || r_regionkey AS node, 'region' AS kind FROM region UNION ALL SELECT 'nation:' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 'customer:' || c_custkey, 'customer' FROM customer WHERE c_custkey % 50 <> 7
  UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier' FROM supplier UNION ALL SELECT 'order:' || o_orderkey, 'order' FROM orders UNION ALL SELECT 'part:' || p_partkey, 'part' FROM part),
nd AS (SELECT * FROM nk UNION ALL SELECT * FROM nk WHERE node = 'nation:3'), re AS (SELECT e.*, dst IN (SELECT node FROM nd) AS resolved FROM e),
n1 AS (SELECT src AS x FROM e WHERE dst = 'nation:4' UNION SELECT dst FROM e WHERE src = 'nation:4' UNION SELECT 'nation:4'),
iss AS (SELECT 'DUPLICATE_NODE' AS code, 'Error' AS severity, node, count(*) AS n FROM nd GROUP BY node HAVING count(*) > 1 UNION ALL SELECT 'TARGET_MISSING', 'Warning', dst, count(*) FROM re WHERE NOT resolved GROUP BY dst
  UNION ALL SELECT DISTINCT 'NODE_UNCONNECTED', 'Info', node, 1 FROM nd WHERE node NOT IN (SELECT src FROM e) AND node NOT IN (SELECT dst FROM e))
SELECT * FROM (SELECT 'nodes' AS view, kind, node, CAST(NULL AS VARCHAR) AS src, CAST(NULL AS VARCHAR) AS dst, CAST(NULL AS BOOLEAN) AS resolved, CAST(NULL AS INTEGER) AS step, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS BIGINT) AS n, count(*) OVER () AS matched, CASE WHEN 15 < count(*) OVER () THEN CAST(15 AS BIGINT) END AS next_offset FROM (SELECT * FROM nd WHERE kind = 'nation') ORDER BY kind, node LIMIT 10 OFFSET 5)
UNION ALL SELECT * FROM (SELECT 'node' AS view, kind, node, CAST(NULL AS VARCHAR) AS src, CAST(NULL AS VARCHAR) AS dst, CAST(NULL AS BOOLEAN) AS resolved, CAST(NULL AS INTEGER) AS step, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS BIGINT) AS n, count(*) OVER () AS matched, CASE WHEN 30 < count(*) OVER () THEN CAST(30 AS BIGINT) END AS next_offset FROM (SELECT * FROM nd WHERE node = 'nation:3') ORDER BY kind, node LIMIT 30 OFFSET 0)
UNION ALL SELECT * FROM (SELECT 'incoming' AS view, kind, CAST(NULL AS VARCHAR) AS node, src, dst, resolved, CAST(NULL AS INTEGER) AS step, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS BIGINT) AS n, count(*) OVER () AS matched, CASE WHEN 20 < count(*) OVER () THEN CAST(20 AS BIGINT) END AS next_offset FROM (SELECT * FROM re WHERE dst = 'nation:3') ORDER BY kind, src, dst LIMIT 20 OFFSET 0)
UNION ALL SELECT * FROM (SELECT 'outgoing' AS view, kind, CAST(NULL AS VARCHAR) AS node, src, dst, resolved, CAST(NULL AS INTEGER) AS step, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS BIGINT) AS n, count(*) OVER () AS matched, CASE WHEN 30 < count(*) OVER () THEN CAST(30 AS BIGINT) END AS next_offset FROM (SELECT * FROM re WHERE src = 'nation:3') ORDER BY kind, src, dst LIMIT 30 OFFSET 0)
UNION ALL SELECT * FROM (SELECT 'kind' AS view, kind, CAST(NULL AS VARCHAR) AS node, src, dst, resolved, CAST(NULL AS INTEGER) AS step, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS BIGINT) AS n, count(*) OVER () AS matched, CASE WHEN 33 < count(*) OVER () THEN CAST(33 AS BIGINT) END AS next_offset FROM (SELECT * FROM re WHERE kind = 'BasedIn') ORDER BY kind, src, dst LIMIT 30 OFFSET 3)
UNION ALL SELECT * FROM (SELECT 'unresolved' AS view, kind, CAST(NULL AS VARCHAR) AS node, src, dst, resolved, CAST(NULL AS INTEGER) AS step, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS BIGINT) AS n, count(*) OVER () AS matched, CASE WHEN 100 < count(*) OVER () THEN CAST(100 AS BIGINT) END AS next_offset FROM (SELECT * FROM re WHERE NOT resolved) ORDER BY kind, src, dst LIMIT 100 OFFSET 0)
UNION ALL SELECT * FROM (SELECT 'missing' AS view, kind, CAST(NULL AS VARCHAR) AS node, src, dst, resolved, CAST(NULL AS INTEGER) AS step, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS BIGINT) AS n, count(*) OVER () AS matched, CASE WHEN 30 < count(*) OVER () THEN CAST(30 AS BIGINT) END AS next_offset FROM (SELECT * FROM re WHERE NOT resolved AND src = 'order:1') ORDER BY kind, src, dst LIMIT 30 OFFSET 0)
UNION ALL SELECT * FROM (SELECT 'impact' AS view, kind, CAST(NULL AS VARCHAR) AS node, src, dst, CAST(NULL AS BOOLEAN) AS resolved, step, CAST(NULL AS VARCHAR) AS code, CAST(NULL AS VARCHAR) AS severity, CAST(NULL AS BIGINT) AS n, count(*) OVER () AS matched, CASE WHEN 50 < count(*) OVER () THEN CAST(50 AS BIGINT) END AS next_offset FROM (SELECT kind, src, dst, min(step) AS step FROM (SELECT *, 1 AS step FROM e WHERE src = 'nation:4' OR dst = 'nation:4' UNION ALL SELECT *, 2 FROM e WHERE src IN (SELECT x FROM n1) OR dst IN (SELECT x FROM n1)) GROUP BY ALL) ORDER BY step, kind, src, dst LIMIT 50 OFFSET 0)
UNION ALL SELECT * FROM (SELECT 'issues' AS view, CAST(NULL AS VARCHAR) AS kind, node, CAST(NULL AS VARCHAR) AS src, CAST(NULL AS VARCHAR) AS dst, CAST(NULL AS BOOLEAN) AS resolved, CAST(NULL AS INTEGER) AS step, code, severity, n, count(*) OVER () AS matched, CASE WHEN 40 < count(*) OVER () THEN CAST(40 AS BIGINT) END AS next_offset FROM (SELECT * FROM iss) ORDER BY code, node LIMIT 40 OFFSET 0)
UNION ALL SELECT * FROM (SELECT 'customers' AS view, CAST(NULL AS VARCHAR) AS kind, node, CAST(NULL AS VARCHAR) AS src, CAST(NULL AS VARCHAR) AS dst, CAST(NULL AS BOOLEAN) AS resolved, CAST(NULL AS INTEGER) AS step, code, severity, n, count(*) OVER () AS matched, CASE WHEN 30 < count(*) OVER () THEN CAST(30 AS BIGINT) END AS next_offset FROM (SELECT * FROM iss WHERE node LIKE 'nation:%') ORDER BY code, node LIMIT 30 OFFSET 0)""",
}
