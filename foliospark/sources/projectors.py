"""Projectors: documents, pages and conversations as one ordered node model.

A node has ``doc_id``, its place ``ord`` in reading order (0 is the document),
``subtree_end`` (the last place below it), ``kind``, ``parent_ord``, ``text`` and a
map ``props``. A descendant of a node is one whose place lies in
``(ord, subtree_end]``, so ancestor and descendant tests are interval joins.
All projectors are one narrow pass over their table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliospark.operators.query import with_parents

NODE_COLUMNS = ("doc_id", "ord", "subtree_end", "kind", "parent_ord", "text", "props")
#: Elements of a page that become nodes, with their kinds.
PAGE_KINDS = {
    "article": "body", "h1": "heading", "p": "paragraph", "b": "run", "br": "break", "a": "hyperlink", "li": "list_paragraph",
    "nav": "island", "footer": "island", "script": "island", "style": "island",
}


def document_nodes(docs: DataFrame) -> DataFrame:
    """A document node and one paragraph node per line of its text."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    props = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))

    def node(at, end, kind, parent, text, with_props):
        return F.struct(
            at.cast("long").alias("ord"), end.cast("long").alias("subtree_end"), F.lit(kind).alias("kind"), parent.cast("long").alias("parent_ord"),
            text.alias("text"), with_props.alias("props"),
        )

    none = F.lit(None).cast("string")
    top = F.array(node(F.lit(0), F.size("lines"), "document", F.lit(None), none, props))
    below = F.transform("lines", lambda t, i: node(i + 1, i + 1, "paragraph", F.lit(0), t, F.create_map(F.lit("lang"), F.col("lang"))))
    return docs.withColumn("lines", lines).select("doc_id", F.inline(F.concat(top, below))).select(*NODE_COLUMNS)


def page_tokens(pages: DataFrame) -> DataFrame:
    """The tags of pages in order: doc_id, ord (from 1), tag, is_close, attrs, and the text behind the tag."""
    token = F.posexplode(F.expr(r"regexp_extract_all(html, '<[^>]+>[^<]*', 0)")).alias("i", "token")
    return pages.select(F.col("page_id").alias("doc_id"), token).select(
        "doc_id", (F.col("i") + 1).cast("long").alias("ord"),
        F.regexp_extract("token", "^</?([A-Za-z0-9!]+)", 1).alias("tag"), F.startswith("token", F.lit("</")).alias("is_close"),
        F.regexp_extract("token", "^<[^ >]+([^>]*)>", 1).alias("attrs"), F.regexp_extract("token", "^<[^>]+>([^<]*)$", 1).alias("text"),
    )


def balanced(tokens: DataFrame) -> DataFrame:
    """Opening tags with ``end``: the place of the closing tag that balances them (null for none), and ``level``, how many tags of the name are open.

    A tag's level is the running sum of its opens and closes. An open and its close stand next to each other among the tags of
    one name and level, whatever was never opened or never closed before.
    """
    by_tag = W.partitionBy("doc_id", "tag").orderBy("ord").rowsBetween(W.unboundedPreceding, 0)
    level = F.sum(F.when(F.col("is_close"), -1).otherwise(1)).over(by_tag) + F.col("is_close").cast("int")
    ends = F.lead("ord").over(W.partitionBy("doc_id", "tag", "level").orderBy("ord"))
    return tokens.withColumn("level", level).withColumn("end", ends).where(~F.col("is_close"))


def page_nodes(pages: DataFrame) -> DataFrame:
    """Nodes of pages: elements of ``PAGE_KINDS``; an element ends at the closing tag that balances it, or at its start where none does."""
    tags = list(PAGE_KINDS)
    kinds = F.create_map(*[F.lit(x) for kv in PAGE_KINDS.items() for x in kv])
    return balanced(page_tokens(pages).where(F.col("tag").isin(tags))).select(
        "doc_id", "ord", F.coalesce("end", "ord").alias("subtree_end"), F.element_at(kinds, F.col("tag")).alias("kind"), F.lit(0).cast("long").alias("parent_ord"),
        "text", F.create_map(F.lit("tag"), F.col("tag"), F.lit("href"), F.regexp_extract("attrs", 'href="([^"]*)"', 1)).alias("props"),
    )


_ATTRIBUTE = r"""([^\s=>"'/]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def page_tree(pages: DataFrame) -> DataFrame:
    """The whole element trees of pages: (doc_id, ord, subtree_end, tag, attrs, value, parent_ord, depth).

    Elements have even places and attributes as (name, value) in order; the texts between tags are nodes of the tag ``#text`` at odd places, with
    blank ones left out. Comments and declarations are no nodes.
    """
    tokens = page_tokens(pages).where(~F.startswith("tag", F.lit("!")) & (F.col("tag") != "")).withColumn("ord", 2 * F.col("ord")).withColumn("tag", F.lower("tag"))
    pick = lambda k: F.regexp_extract_all("attrs", F.lit(_ATTRIBUTE), k)
    attrs = F.zip_with(pick(1), pick(2), lambda n, v: F.struct(n.alias("name"), F.regexp_replace(v, "^[\"']|[\"']$", "").alias("value")))
    end = F.coalesce("end", "ord").alias("subtree_end")
    none = F.array().cast("array<struct<name:string,value:string>>").alias("attrs")
    elements = balanced(tokens).select("doc_id", "ord", end, "tag", attrs.alias("attrs"), F.lit(None).cast("string").alias("value"))
    texts = page_tokens(pages).where(F.trim(F.translate("text", "\t\r\n", "   ")) != "").select("doc_id", (2 * F.col("ord") + 1).alias("ord"), (2 * F.col("ord") + 1).alias("subtree_end"), F.lit("#text").alias("tag"), none, F.col("text").alias("value"))
    return with_parents(elements.unionByName(texts))


def conversation_nodes(chats: DataFrame) -> DataFrame:
    """One paragraph node per turn, with its role as a property."""
    return chats.select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("long").alias("ord"), (F.col("turn") + 1).cast("long").alias("subtree_end"),
        F.lit("paragraph").alias("kind"), F.lit(0).cast("long").alias("parent_ord"), "text", F.create_map(F.lit("role"), F.col("role")).alias("props"),
    )
