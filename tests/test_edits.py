"""Bindings by path against plain steps, and transactions: what refuses a batch, splices against slices, and exact inverses."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import bindings as b
from foliospark.operators import transactions as t

NODES, COMMANDS = "doc_id long, ord int, text string", "doc_id long, command int, ord int, start int, end int, expected string, replacement string"


@pytest.mark.parametrize("value,want", [
    ("{A6C895A1-6B29-470C-84D7-6D14B798EAE7}", "a6c895a1-6b29-470c-84d7-6d14b798eae7"), (" (a6c895a1-6b29-470c-84d7-6d14b798eae7) ", "a6c895a1-6b29-470c-84d7-6d14b798eae7"), ("a6c895a16b29470c84d76d14b798eae7", "a6c895a1-6b29-470c-84d7-6d14b798eae7"),
    ("{a6c895a1-6b29-470c-84d7-6d14b798eae7", None), ("x", None), ("", None), (None, None),
])
def test_guids(spark, value, want):
    assert spark.createDataFrame([(value,)], "v string").select(b.normal_guid(F.col("v")).alias("g")).first().g == want


def test_paths_follow_names_and_places(spark):
    rng = random.Random(9)
    elements, kids = [], {}
    for node in range(400):
        parent = None if node == 0 else rng.randrange((node + 5) // 6)
        name = "root" if node == 0 else rng.choice("abc")
        elements.append((1, 1, node, parent, node, rng.choice(["", "u"]) if node else "", name))
        kids.setdefault(parent, []).append(node)
    by = {e[2]: e for e in elements}

    def follow(steps):
        at = [None]
        for ns, name, place in steps:
            following = []
            for parent in at:
                found = [k for k in kids.get(parent, []) if (by[k][5], by[k][6]) == (ns, name)]
                following += found if place is None else found[place - 1: place]
            at = following
        return sorted(at)

    wanted, want = [], {}
    for k in range(150):
        steps = [("", "root", rng.choice([None, 1]))] + [(rng.choice(["", "u"]), rng.choice("abc"), rng.choice([None, None, 1, 2, 3])) for _ in range(rng.randint(0, 5))]
        path = "".join(f"/{'p:' if ns else ''}{name}{f'[{place}]' if place else ''}" for ns, name, place in steps)
        wanted.append((1, k, "{A6C895A1-6B29-470C-84D7-6D14B798EAE7}", "xmlns:p='u'", path))
        want[k] = follow(steps)
    resolved, targets = b.resolve(
        spark.createDataFrame(wanted, "doc_id long, binding int, store_id string, mappings string, path string"), spark.createDataFrame([(1, 1, "a6c895a1-6b29-470c-84d7-6d14b798eae7", True)], "doc_id long, store int, item_id string, readable boolean"),
        spark.createDataFrame(elements, "doc_id long, store int, node long, parent long, ord long, namespace string, name string"),
    )
    got = {k: [] for k in want}
    for r in targets.collect():
        got[r.binding].append(r.node)
    assert {k: sorted(v) for k, v in got.items()} == want
    assert {r.binding: (r.status, r.n_targets) for r in resolved.collect()} == {k: ("Resolved" if v else "TargetMissing", len(v)) for k, v in want.items()}
    assert any(len(v) > 1 for v in want.values())


@pytest.mark.parametrize("path,fault", [
    ("/a", None), ("/a[1]/b", None), ("a", "XPathUnsupported"), ("/", "XPathUnsupported"), ("/a//b", "XPathUnsupported"), ("/a/", "XPathInvalid"), ("/a[0]", "XPathUnsupported"), ("/a[x]", "XPathUnsupported"), ("/a[1][2]", "XPathUnsupported"),
    ("/a[1]b", "XPathUnsupported"), ("/:a", "XPathInvalid"), ("/p:", "XPathInvalid"), ("/p:q:r", "XPathInvalid"), ("/z:a", "XPathInvalid"), ("/p:a", None), ("/1a", "XPathUnsupported"), ("/a/@b", "XPathUnsupported"), ("/z:a/1b", "XPathInvalid"), ("/1b/z:a", "XPathUnsupported"),
])
def test_faults_of_paths(spark, path, fault):
    row = spark.createDataFrame([(path, {"p": "u"})], "path string, known map<string,string>").select(b.path_steps(F.col("path"), F.col("known")).alias("s")).first()
    assert next((s.fault for s in row.s if s.fault), None) == fault


def test_no_bindings_and_no_stores(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    stores, elements = none("doc_id long, store int, item_id string, readable boolean"), none("doc_id long, store int, node long, parent long, ord long, namespace string, name string")
    schema = "doc_id long, binding int, store_id string, mappings string, path string"
    assert b.resolve(none(schema), stores, elements)[0].collect() == []
    resolved, targets = b.resolve(spark.createDataFrame([(1, 1, "a6c895a16b29470c84d76d14b798eae7", None, "/a")], schema), stores, elements)
    assert [r.status for r in resolved.collect()] == ["StoreMissing"] and targets.collect() == []


@pytest.mark.parametrize("edits,problem", [
    ([(0, 0, 3, "abc", "x")], None), ([(0, None, None, "abcdef", "x")], None), ([(0, 0, 3, "abX", "x")], "TextMismatch"), ([(0, 0, 9, "abcdef", "x")], "OutOfRange"), ([(0, 3, 2, "", "x")], "OutOfRange"), ([(0, -1, 2, "", "x")], "OutOfRange"), ([(7, 0, 0, "", "x")], "NodeMissing"),
    ([(0, 0, 3, "abc", "x"), (0, 0, 3, "abc", "y")], "DuplicateTarget"), ([(0, 0, 3, "abc", "x"), (0, 2, 4, "cd", "y")], "Overlap"), ([(0, 0, 6, "abcdef", "x"), (0, 1, 2, "b", "y"), (0, 4, 5, "e", "y")], "Overlap"),
    ([(0, 0, 3, "abc", "x"), (0, 3, 6, "def", "y")], None), ([(0, 3, 3, "", "x"), (0, 3, 6, "def", "y")], None), ([(2, 0, 1, "r", "x")], "InRevision"), ([(1, None, None, "", "x")], None), ([(0, 0, 3, "abc", "x"), (7, 0, 0, "", "x")], "NodeMissing"),
])
def test_one_fault_refuses_the_batch(spark, edits, problem):
    nodes = spark.createDataFrame([(1, 0, "abcdef", False), (1, 1, None, False), (1, 2, "rev", True)], NODES + ", in_revision boolean")
    plan = t.checked(nodes, spark.createDataFrame([(1, k, *e) for k, e in enumerate(edits)], COMMANDS))
    row = t.outcomes(plan).first()
    assert (row.outcome, row.problems) == (("Applied", "") if problem is None else ("Refused", problem))
    after = {r.ord: r.text for r in t.applied(nodes, plan).collect()}
    if problem:
        assert after == {0: "abcdef", 1: None, 2: "rev"}


def test_limits_and_bases(spark):
    nodes = spark.createDataFrame([(1, 0, "abc"), (2, 0, "abc")], NODES)
    commands = spark.createDataFrame([(d, k, 0, k, k + 1, "abc"[k], "xx") for d in (1, 2) for k in range(3)], COMMANDS)
    of = lambda **most: {r.problems for r in t.outcomes(t.checked(nodes, commands, **most)).collect()}
    assert of() == {""} and of(most_commands=2) == {"LimitExceeded"} and of(most_chars=5) == {"LimitExceeded"} and of(most_chars=6) == {""}
    bases = t.fingerprints(nodes).withColumn("base", F.when(F.col("doc_id") == 1, F.col("base")).otherwise("other"))
    assert {r.doc_id: r.problems for r in t.outcomes(t.checked(nodes, commands, bases)).collect()} == {1: "", 2: "BaseMismatch"}
    assert len({r.plan_id for r in t.outcomes(t.checked(nodes, commands)).collect()}) == 1


def test_random_batches_and_their_inverses(spark):
    rng = random.Random(10)
    texts = {(d, o): "".join(rng.choice("abé𝄞 ") for _ in range(rng.randint(0, 30))) for d in range(30) for o in range(3)}
    rows, want = [], dict(texts)
    for (d, o), text in texts.items():
        cuts = sorted(rng.sample(range(len(text) + 1), min(len(text) + 1, 2 * rng.randint(0, 3))))
        edits = [(a, e, rng.choice(["", "X", "long new", "ß𝄞"])) for a, e in zip(cuts[::2], cuts[1::2])]
        rows += [(d, len(rows), o, a, e, text[a:e], new) for a, e, new in edits]
        for a, e, new in reversed(edits):
            want[d, o] = want[d, o][:a] + new + want[d, o][e:]
    nodes = spark.createDataFrame([(d, o, x) for (d, o), x in texts.items()], NODES)
    plan = t.checked(nodes, spark.createDataFrame(rows, COMMANDS)).cache()
    after = t.applied(nodes, plan).cache()
    assert {(r.doc_id, r.ord): r.text for r in after.collect()} == want != texts
    undo = t.checked(after, t.inverse(plan), t.fingerprints(after))
    assert {(r.doc_id, r.ord): r.text for r in t.applied(after, undo).collect()} == texts
    changed = after.withColumn("text", F.when((F.col("doc_id") == 3) & (F.col("ord") == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    assert {r.doc_id for r in t.outcomes(t.checked(changed, t.inverse(plan), t.fingerprints(after))).where("outcome = 'Refused'").collect()} == {3}
