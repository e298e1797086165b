"""Nesting of page elements: balanced tags, ancestors, descendants, parents and subtree texts on pages made by hand and against plain loops."""

import random
import time

import pytest
from pyspark.sql import functions as F

from foliospark.operators import query
from foliospark.sources.projectors import balanced, page_nodes, page_tokens


def spans(spark, html):
    """{place: (tag, end)} of a page's elements."""
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    return {r["ord"]: (r["tag"], r["end"]) for r in balanced(page_tokens(pages)).collect()}


@pytest.mark.parametrize("html,want", [
    ("<li>a<li>b</li>c</li>", {1: ("li", 4), 2: ("li", 3)}),
    ("<p>a</p><p>b</p>", {1: ("p", 2), 3: ("p", 4)}),
    ("</p>x<p>a</p></p><p>b</p>", {2: ("p", 3), 5: ("p", 6)}),
    ("<p>a<p>b</p>", {1: ("p", None), 2: ("p", 3)}),
    ("<ul><li>a<ul><li>b</li></ul></li><li>c</li></ul>", {1: ("ul", 10), 2: ("li", 7), 3: ("ul", 6), 4: ("li", 5), 8: ("li", 9)}),
    ("<b>x<i>y</b>z</i>", {1: ("b", 3), 2: ("i", 4)}),
    ("<br>a<br>b", {1: ("br", None), 2: ("br", None)}),
    ("no tags", {}),
])
def test_elements_end_where_their_tags_balance(spark, html, want):
    assert spans(spark, html) == want


def random_nodes(rng, n):
    """(ord, end) of some elements, mostly nested, now and then overlapping."""
    out = []
    for at in range(n):
        out.append((at, at + rng.choice([0, 0, 0, 1, 3, 10, n])))
    return out


def test_relations_equal_plain_loops(spark):
    rng = random.Random(3)
    rows = [(d, a, min(e, 59), rng.choice(["body", "paragraph", "run"]), rng.choice([None, "", f"t{a}"])) for d in range(6) for a, e in random_nodes(rng, 60)]
    nodes = spark.createDataFrame(rows, "doc_id long, ord long, subtree_end long, kind string, text string")
    some = nodes.where("ord % 7 = 0")
    by = {d: [r for r in rows if r[0] == d] for d in range(6)}
    got = lambda df: sorted((r.doc_id, r.ord) for r in df.collect())
    assert got(query.has_ancestor(nodes, some)) == sorted((d, r[1]) for d in by for r in by[d] if any(o[1] % 7 == 0 and o[1] < r[1] <= o[2] for o in by[d]))
    assert got(query.has_descendant(nodes, some)) == sorted((d, r[1]) for d in by for r in by[d] if any(o[1] % 7 == 0 and r[1] < o[1] <= r[2] for o in by[d]))
    around = {(d, r[1]): [o[1] for o in by[d] if o[1] < r[1] <= o[2]] for d in by for r in by[d]}
    assert {(r.doc_id, r.ord): (r.parent_ord, r.depth) for r in query.with_parents(nodes).collect()} == {k: (max(v, default=None), len(v)) for k, v in around.items()}
    texts = {}
    for d in by:
        for top in by[d]:
            text = ""
            for r in by[d]:
                if top[1] <= r[1] <= top[2] and r[4]:
                    text += ("\n" if text and r[3] == "paragraph" else "") + r[4]
            if text:
                texts[d, top[1]] = text
    assert {(r.doc_id, r.ord): r.text for r in query.node_texts(nodes, nodes).collect()} == texts


def test_a_page_of_many_elements_takes_seconds(spark):
    html = "<article>" + "<li><p>a</p><li>b</li></li>" * 25_000 + "</article>"
    pages = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    began = time.time()
    nodes = query.with_parents(page_nodes(pages))
    assert [tuple(r) for r in nodes.groupBy("depth").agg(F.count("*")).orderBy("depth").collect()] == [(0, 1), (1, 25_000), (2, 50_000)]
    assert query.has_ancestor(nodes, nodes.where("kind = 'body'")).count() == 75_000
    assert query.has_descendant(nodes, nodes.where("kind = 'paragraph'")).count() == 25_001
    assert query.node_texts(nodes, nodes).count() == 75_001
    assert time.time() - began < 90
