"""The node query: kinds, properties, ancestors, descendants, text, projection and paging.

Predicates are conjunctive; each takes nodes and returns nodes, so a query is a
chain of them and Catalyst sees one plan.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Properties that a projection leaves out unless asked for.
PRIVATE_PROPS = ("anchor", "author", "date", "guid", "initials", "instruction", "name")
CATEGORIES = {
    "document": "document", "body": "container", "paragraph": "block", "heading": "block", "list_paragraph": "block",
    "hyperlink": "reference", "island": "extension", "run": "inline", "break": "inline",
}
BLOCKS = tuple(k for k, c in CATEGORIES.items() if c == "block")


def of_kinds(nodes: DataFrame, kinds: list[str] | None) -> DataFrame:
    """Nodes of the given kinds; None is all, an empty list is an error."""
    if kinds is None:
        return nodes
    if not 1 <= len(kinds) <= 64:
        raise ValueError("kinds takes 1 to 64 values")
    return nodes.where(F.col("kind").isin(kinds))


def with_props(nodes: DataFrame, props: dict[str, str]) -> DataFrame:
    """Nodes that have every property with exactly its value; a missing key never matches."""
    if len(props) > 16:
        raise ValueError("props takes at most 16 entries")
    for k, v in props.items():
        nodes = nodes.where(F.try_element_at("props", F.lit(k)) == v)
    return nodes


def _marked(nodes: DataFrame, others: DataFrame, first: int) -> tuple[DataFrame, list[str]]:
    """Nodes and, as rows of their own, the intervals of others; at equal places those come first (-1) or last (1)."""
    marks = others.select(F.col("doc_id").alias("doc_id"), F.col("ord").alias("ord"), F.col("ord").alias("_o"), F.col("subtree_end").alias("_e"), F.lit(first).alias("_side"))
    return nodes.withColumn("_side", F.lit(0)).unionByName(marks, allowMissingColumns=True), nodes.columns


def has_ancestor(nodes: DataFrame, ancestors: DataFrame, or_self: bool = False) -> DataFrame:
    """Nodes with a proper ancestor among ``ancestors`` (with ``or_self``, or there themselves): of those that begin before the node, one reaches it.

    One sort by place and a running maximum, so the work follows the nodes and not their pairs.
    """
    rows, columns = _marked(nodes, ancestors, -1 if or_self else 1)
    reach = F.max("_e").over(W.partitionBy("doc_id").orderBy("ord", "_side").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_reach", reach).where("_side = 0 and _reach >= ord").select(*columns)


def has_descendant(nodes: DataFrame, descendants: DataFrame, or_self: bool = False) -> DataFrame:
    """Nodes with a proper descendant among ``descendants`` (with ``or_self``, or there themselves): the next one behind the node begins inside it."""
    rows, columns = _marked(nodes, descendants, 1 if or_self else -1)
    following = F.min("_o").over(W.partitionBy("doc_id").orderBy(F.desc("ord"), F.desc("_side")).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("_next", following).where("_side = 0 and _next <= subtree_end").select(*columns)


def within_node(nodes: DataFrame, doc_id, ord_: int) -> DataFrame:
    """A node's subtree, the node itself included; an unknown node is an error."""
    top = nodes.where((F.col("doc_id") == doc_id) & (F.col("ord") == ord_)).select("subtree_end").first()
    if top is None:
        raise ValueError(f"document {doc_id} has no node {ord_}")
    return nodes.where((F.col("doc_id") == doc_id) & F.col("ord").between(ord_, top["subtree_end"]))


def _fold(ords, ends):
    """(parents, depths) of intervals in ascending order: a stack of those that are open, and how many have ended."""
    parents, depths, stack, ended = [], [], [], []
    for at, end in zip(ords, ends):
        while stack and stack[-1][1] < at:
            stack.pop()
        while ended and ended[0] < at:
            heapq.heappop(ended)
        parents.append(stack[-1][0] if stack else None)
        depths.append(len(ended))
        if end > at:
            stack.append((at, end))
            heapq.heappush(ended, end)
    return parents, depths


def with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with ``parent_ord``, the nearest node that encloses them (null for none), and ``depth``, how many do.

    One sort of a document's nodes and a fold over them; where elements overlap without nesting, the one that began last counts as nearest.
    """
    rows = nodes.drop("parent_ord", "depth")
    schema = T.StructType([*rows.schema.fields, T.StructField("parent_ord", T.LongType()), T.StructField("depth", T.LongType())])

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by([("ord", "ascending")])
        parents, depths = _fold(table.column("ord").to_pylist(), table.column("subtree_end").to_pylist())
        return table.append_column("parent_ord", pa.array(parents, pa.int64())).append_column("depth", pa.array(depths, pa.int64()))

    return rows.groupBy("doc_id").applyInArrow(fold, schema)


def _block_break(kind: Column, before: Column) -> Column:
    """A line feed before a block that has text before it."""
    return F.when(kind.isin(*BLOCKS) & before, "\n").otherwise("")


def node_texts(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """(doc_id, ord, text) of each top node: the texts of its subtree in order, with a line feed before each block that has text before it; tops without any are left out.

    Every piece stands once in its document's whole text; a top's text is the stretch of it that its interval names.
    """
    pieces = nodes.where("text is not null and text <> ''").select("doc_id", "ord", F.concat(_block_break(F.col("kind"), F.lit(True)), "text").alias("piece"))
    bounds = F.array(F.struct(F.col("ord").alias("at"), F.lit(-1).alias("side")), F.struct(F.col("subtree_end").alias("at"), F.lit(1).alias("side")))
    marks = tops.select("doc_id", "ord", "subtree_end").distinct().select("doc_id", F.col("ord").alias("top"), F.inline(bounds))
    sizes = pieces.select("doc_id", F.col("ord").alias("at"), F.lit(0).alias("side"), F.length("piece").alias("size"))
    upto = F.sum("size").over(W.partitionBy("doc_id").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0))
    spots = sizes.unionByName(marks, allowMissingColumns=True).withColumn("upto", F.coalesce(upto, F.lit(0))).where("side <> 0")
    spots = spots.groupBy("doc_id", "top").agg(F.min("upto").alias("a"), F.max("upto").alias("b")).where("b > a")
    wanted = spots.groupBy("doc_id").agg(F.collect_list(F.struct("top", "a", "b")).alias("tops"))
    whole = pieces.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "piece"))), lambda x: x["piece"]), "").alias("whole"))
    each = wanted.join(whole, "doc_id").select("doc_id", F.inline(F.transform("tops", lambda x: F.struct(x["top"].alias("ord"), F.substring("whole", x["a"].cast("int") + 1, (x["b"] - x["a"]).cast("int")).alias("text")))))
    return each.withColumn("text", F.regexp_replace("text", "^\n", ""))


def text_matches(text: Column, value: str, mode: str = "contains", ignore_case: bool = True) -> Column:
    """contains, equals, startswith or endswith, over the lower-cased text by default."""
    t, v = (F.lower(text), F.lit(value.lower())) if ignore_case else (text, F.lit(value))
    return {"contains": F.contains(t, v), "equals": t == v, "startswith": F.startswith(t, v), "endswith": F.endswith(t, v)}[mode]


def subtree_text(nodes: DataFrame) -> DataFrame:
    """Per document its paragraphs' texts in order, a line feed before each but the first that has text before it."""
    parts = nodes.where(F.col("text").isNotNull() & (F.col("text") != "")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("ts"))
    return parts.select("doc_id", F.array_join(F.transform("ts", lambda t: t["text"]), "\n").alias("text"))


def preview(nodes: DataFrame, most: int = 400) -> DataFrame:
    """The default projection: place, kind, category, and the text cut to ``most`` characters."""
    category = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    return nodes.select(
        "doc_id", "ord", "kind", F.coalesce(F.try_element_at(category, F.col("kind")), F.lit("inline")).alias("category"),
        F.substring("text", 1, most).alias("preview"), (F.length("text") > most).alias("truncated"),
    )


def public_props(nodes: DataFrame, most: int = 160) -> DataFrame:
    """Nodes without private properties and with property values cut to ``most`` characters."""
    shown = F.map_filter("props", lambda k, v: ~k.isin(list(PRIVATE_PROPS)))
    return nodes.withColumn("props", F.transform_values(shown, lambda k, v: F.substring(v, 1, most)))


def page(rows: DataFrame, order: list, offset: int = 0, limit: int = 80) -> DataFrame:
    """One page of an ordered result, with ``matched`` and ``next_offset`` on each row.

    The page is a top-k (``offset + limit`` rows at most leave the executors);
    the count of all matches is a separate aggregation.
    """
    if offset < 0 or not 1 <= limit <= 200:
        raise ValueError("offset must be 0 or more, limit 1 to 200")
    matched = rows.count()
    after = offset + limit if offset + limit < matched else None
    return rows.orderBy(*order).offset(offset).limit(limit).withColumns({
        "matched": F.lit(matched).cast("long"), "next_offset": F.lit(after).cast("long"),
    })


def search_regex(nodes: DataFrame, pattern: str, most: int = 300) -> DataFrame:
    """Case-sensitive matches of a pattern by node, with the text cut to ``most`` characters."""
    found = F.regexp_extract_all("text", F.lit(pattern), 0)
    return nodes.withColumn("matches", found).where(F.size("matches") > 0).select(
        "doc_id", "ord", F.substring("text", 1, most).alias("text"), F.posexplode("matches").alias("match_no", "match")
    )
