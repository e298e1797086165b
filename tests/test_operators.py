"""Operators on small hand-made rows, against plain Python."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import numerals
from foliospark.operators import diff, graph, numbering, ordered, protect, query, semantic, template


def test_outline_parent_is_stack_parent(spark):
    random.seed(1)
    rows = [(d, i, random.randint(1, 9)) for d in range(5) for i in range(60)]
    got = {(r.doc_id, r.ord): r.parent_ord for r in ordered.outline(spark.createDataFrame(rows, "doc_id int, ord int, level int")).collect()}
    for d in range(5):
        stack = []
        for _, i, level in [r for r in rows if r[0] == d]:
            while stack and stack[-1][1] >= level:
                stack.pop()
            assert got[d, i] == (stack[-1][0] if stack else None)
            stack.append((i, level))


def test_list_counters_are_the_state_machine(spark):
    random.seed(2)
    rows = [(d, i, random.randint(1, 5)) for d in range(4) for i in range(80)]
    got = {(r.doc_id, r.ord): r.counter for r in ordered.list_counters(spark.createDataFrame(rows, "doc_id int, ord int, level int")).collect()}
    for d in range(4):
        counts = {}
        for _, i, level in [r for r in rows if r[0] == d]:
            counts = {k: v for k, v in counts.items() if k <= level}
            counts[level] = counts.get(level, 0) + 1
            assert got[d, i] == counts[level]


def _machine(rows, lists):
    """Counters by a state of nine levels per list, in order of the rows."""
    state, section, out = {}, 0, {}
    for ord_, num, level, is_break in rows:
        if is_break:
            for n, s in state.items():
                if lists[n]["by_section"]:
                    s.clear()
        s, d = state.setdefault(num, {}), lists[num]
        start, rule = d["starts"][level], d["restarts"][level]
        exact = start is not None and start >= 0 and (rule is None or rule == 0 or (1 <= rule <= 7 and rule <= level))
        if exact:
            s[level] = s[level] + 1 if level in s else start
        out[ord_] = s.get(level) if exact else None
        for deeper in range(level + 1, 9):
            rule = d["restarts"][deeper]
            if rule != 0 and level <= (deeper - 1 if rule is None else min(rule, deeper) - 1):
                s.pop(deeper, None)
    return out


def test_numbering_is_the_state_machine(spark):
    random.seed(18)
    pick = lambda *xs: [random.choice(xs) for _ in range(9)]
    lists = {n: {"starts": pick(1, 1, 0, 5, None, -2), "restarts": pick(None, None, 0, 1, 2, 9), "by_section": n % 2 == 0} for n in range(6)}
    rows = [(i, random.randrange(6), random.randrange(9), random.random() < 0.1) for i in range(600)]
    defs = spark.createDataFrame(
        [(n, d["starts"], d["restarts"], ["decimal"] * 9, ["%1"] * 9, [False] * 9, d["by_section"]) for n, d in lists.items()],
        "num_id int, starts array<int>, restarts array<int>, formats array<string>, texts array<string>, legal array<boolean>, by_section boolean",
    )
    items = spark.createDataFrame([(0, *r) for r in rows], "doc_id int, ord int, num_id int, level int, is_break boolean")
    assert {r.ord: r.counter for r in numbering.numbered(items, defs).collect()} == _machine(rows, lists)


def test_labels_of_levels(spark):
    texts = ["%1", "%1.%2", "%3", "Legal %1.%2.%3.%4", "%9", None, "", "x" * 32, "%1"]
    defs = spark.createDataFrame(
        [(0, [1] * 9, [None] * 9, ["upperRoman", "lowerLetter", "none", "decimalZero", "chicago", *["decimal"] * 4], texts, [False, False, False, True, *[False] * 5], False)],
        "num_id int, starts array<int>, restarts array<int>, formats array<string>, texts array<string>, legal array<boolean>, by_section boolean",
    )
    items = spark.createDataFrame([(0, i, 0, k, False) for i, k in enumerate([0, 1, 1, 2, 3, 4, 5, 6, 7, 8])], "doc_id int, ord int, num_id int, level int, is_break boolean")
    got = [(r.label, r.label_status) for r in numbering.numbered(items, defs).orderBy("ord").collect()]
    assert got == [
        ("I", "Exact"), ("I.a", "Exact"), ("I.b", "Exact"), ("", "Exact"), ("Legal 1.2.1.1", "Exact"), (None, "InvalidLevelText"), (None, "MissingLevelText"), ("", "Hidden"), (None, "LengthLimitExceeded"), ("I", "Exact"),
    ]


@pytest.mark.parametrize(("n", "roman", "letters"), [(1, "I", "A"), (4, "IV", "D"), (26, "XXVI", "Z"), (27, "XXVII", "AA"), (702, "DCCII", "ZZ"), (703, "DCCIII", "AAA"), (3999, "MMMCMXCIX", "EWU"), (4000, None, "EWV")])
def test_numerals(spark, n, roman, letters):
    row = spark.range(1).select(numerals.roman(F.lit(n)).alias("r"), numerals.letters(F.lit(n)).alias("l")).first()
    assert (row.r, row.l) == (roman, letters)


def test_query_predicates(spark):
    nodes = spark.createDataFrame(
        [(1, 0, 5, "body", None), (1, 1, 1, "paragraph", "Alpha"), (1, 2, 4, "list", None), (1, 3, 3, "paragraph", "beta"), (2, 1, 1, "paragraph", None)],
        "doc_id int, ord int, subtree_end int, kind string, text string",
    ).withColumn("props", F.create_map(F.lit("k"), F.col("kind")))
    ids = lambda df: sorted((r.doc_id, r.ord) for r in df.collect())
    assert ids(query.has_ancestor(nodes, nodes.where("kind = 'list'"))) == [(1, 3)]
    assert ids(query.has_descendant(nodes, nodes.where("text = 'beta'"))) == [(1, 0), (1, 2)]
    assert ids(query.with_props(nodes, {"k": "list", "other": "x"})) == []
    assert ids(nodes.where(query.text_matches(F.col("text"), "ALPHA", "equals"))) == [(1, 1)]
    with pytest.raises(ValueError):
        query.of_kinds(nodes, [])
    page = query.page(nodes, ["doc_id", "ord"], 1, 2).collect()
    assert [(r.ord, r.matched, r.next_offset) for r in page] == [(1, 5, 3), (2, 5, 3)]


def test_merge_and_patch(spark):
    df = lambda d: spark.createDataFrame(list(d.items()), "key int, value string")
    a, l, r = df({1: "a", 2: "b", 3: "c", 4: "d"}), df({1: "a", 2: "B", 3: "x", 5: "n"}), df({1: "a", 2: "b", 3: "y", 4: "d", 5: "m"})
    got = {x.key: (x.outcome, x.conflict, x.merged) for x in diff.three_way_merge(a, l, r, "key", "value").collect()}
    assert got == {
        1: ("Unchanged", None, "a"), 2: ("Left", None, "B"), 3: ("Conflict", "ModifiedDifferently", None), 4: ("Left", None, None), 5: ("Conflict", "AddedDifferently", None),
    }
    patch = diff.create_patch(a, l, "key", "value")
    there = diff.apply_patch(a, patch, "key", "value")
    back = diff.apply_patch(there.drop("failed"), diff.reverse_patch(patch), "key", "value")
    assert sorted((x.key, x.value) for x in back.collect()) == sorted((x.key, x.value) for x in a.collect())
    assert diff.apply_patch(r, patch, "key", "value").where("failed").count() == 2


def _opcodes(base, revised):
    """Changes of two texts by the standard library's matcher, for texts where a longest common subsequence is unique."""
    a, b, out = base.split("\n"), revised.split("\n"), []
    for tag, a0, a1, b0, b1 in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag == "replace" and a1 - a0 == b1 - b0 == 1:
            out.append(("modified", a0, b0))
        elif tag != "equal":
            out += [("deleted", i, None) for i in range(a0, a1)] + [("inserted", None, j) for j in range(b0, b1)]
    return sorted(out, key=str)


def test_compare_documents(spark):
    base, revised = "one\ntwo here\nthree\nfour\nx", "zero\none\ntwo there\nthree\nfive\nsix\nx"
    random.seed(14)
    pairs = [(7, base, revised), (8, base, base), (9, "", ""), (10, None, "a\nb"), (11, "a", None)]
    for i in range(40):
        a = [f"line {random.randint(0, 400)} of text" for _ in range(random.randint(1, 30))]
        b = [x for x in a if random.random() < 0.8]
        b.insert(random.randint(0, len(b)), f"new {i}")
        pairs.append((100 + i, "\n".join(dict.fromkeys(a)), "\n".join(dict.fromkeys(b))))
    frame = spark.createDataFrame(pairs, "doc_id long, base string, revised string")
    rows = diff.compare_documents(frame).collect()
    got = sorted(((r.change, r.base_ord, r.revised_ord, r.n_spans) for r in rows if r.doc_id == 7), key=str)
    assert got == sorted([("inserted", None, 0, 1), ("modified", 1, 2, 1), ("deleted", 3, None, 1), ("inserted", None, 4, 1), ("inserted", None, 5, 1)], key=str)
    for doc, a, b in pairs[5:]:
        assert sorted(((r.change, r.base_ord, r.revised_ord) for r in rows if r.doc_id == doc), key=str) == _opcodes(a, b)
    assert not [r for r in rows if r.doc_id in (8, 9)] and {(r.doc_id, r.change) for r in rows if r.doc_id in (10, 11)} == {(10, "inserted"), (11, "deleted")}
    text = {r.doc_id: r.text for r in diff.diff_text(diff.compare_documents(frame), diff.side_lines(frame)).collect()}
    assert text[11] == "1. DELETION: a" and text[7].split("\n")[1] == "2. REPLACEMENT: two here -> two there"


def test_common_sequence_is_longest():
    random.seed(15)
    for _ in range(200):
        a, b = ([random.choice("abcd") for _ in range(random.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = diff.common_sequence(a, b)
        assert len(got) == best[-1][-1] and all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))


def test_longest_increasing_is_longest():
    random.seed(3)
    for _ in range(200):
        v = [random.randint(0, 12) for _ in range(random.randint(0, 12))]
        got = diff.longest_increasing(v)
        assert all(v[a] < v[b] for a, b in zip(got, got[1:]))
        best = [1] * len(v)
        for i in range(len(v)):
            best[i] = 1 + max((best[j] for j in range(i) if v[j] < v[i]), default=0)
        assert len(got) == max(best, default=0)


def _greedy(ours, theirs):
    """The stated rule in plain words: in order, the best free heading of at least 0.7, the earliest among equals."""
    free, out = dict(enumerate(theirs)), []
    for h, b in ours:
        rated = [(-(1.0 if h == o else difflib.SequenceMatcher(None, h, o).ratio() if h and o else 0.0), j) for j, (o, _) in free.items()]
        worse, j = min((r for r in rated if r[0] <= -0.7), default=(None, None))
        if j is None:
            out.append(("DELETED", h, None))
        else:
            o, body = free.pop(j)
            out.append(("RENAMED" if worse > -1 else "MATCHED" if b == body else "CHANGED", h, o))
    return out + [("ADDED", None, o) for o, _ in free.values()]


def test_clause_alignment(spark):
    random.seed(16)
    cases = [([("Term", "x"), ("Price", "y"), ("Law", "z")], [("Price", "y2"), ("Terms", "x"), ("New", "n")])]
    some = ["Term", "Terms", "Term of use", "Price", "Prices", "", "Law", "Laws", "Payment", "Payments due"]
    for _ in range(40):
        cases.append(tuple([(random.choice(some), random.choice("ab")) for _ in range(random.randint(0, 7))] for _ in range(2)))
    kind = "doc_id long, ours array<struct<heading:string,body:string>>, theirs array<struct<heading:string,body:string>>"
    rows = diff.compare_clauses(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], kind)).collect()
    for i, (a, b) in enumerate(cases):
        assert sorted(((r.kind, r.heading, r.other_heading) for r in rows if r.doc_id == i), key=str) == sorted(_greedy(a, b), key=str)
    assert [r.reordered for r in rows if r.doc_id == 0 and r.kind == "CHANGED"] == [True]


def test_graph_impact_and_chain(spark):
    edges = spark.createDataFrame([("k", a, b) for a, b in ["ab", "bc", "cd", "de", "xb"]], "kind string, src string, dst string")
    start = spark.createDataFrame([("a",)], "node string")
    assert sorted((r.src, r.dst, r.step) for r in graph.impact(edges, start, "outgoing", 3).collect()) == [("a", "b", 1), ("b", "c", 2), ("c", "d", 3)]
    assert {r.src for r in graph.impact(edges, start, "both", 2).collect()} == {"a", "b", "x"}


def test_chains_of_any_length_cycles_and_missing_parents(spark):
    links = [(1, None), *[(i, i - 1) for i in range(2, 1001)], (2000, 2001), (2001, 2002), (2002, 2000), (2003, 2000), (3000, 3000), (4000, 4999), (4001, 4000)]
    chain = {r.node: (r.root, r.depth, r.status) for r in graph.chain(spark.createDataFrame(links, "c int, p int"), "c", "p").collect()}
    assert all(chain[i] == (1, i - 1, "Resolved") for i in range(1, 1001))
    assert all(chain[i] == (None, None, "Cycle") for i in (2000, 2001, 2002, 2003, 3000))
    assert chain[4000] == (4999, 1, "Missing") and chain[4001] == (4999, 2, "Missing") and len(chain) == len(links)


def test_closure_and_adjacency(spark):
    edges = spark.createDataFrame([("k", i, i + 1) for i in range(12)] + [("k", 5, 2), ("j", 3, 9)], "kind string, src int, dst int")
    assert {r.node: r.step for r in graph.closure(edges, spark.createDataFrame([(3,)], "node int")).collect()} == {3: 0, 4: 1, 9: 1, 5: 2, 10: 2, 6: 3, 2: 3, 11: 3, 7: 4, 12: 4, 8: 5}
    assert [(r.node, r.outgoing, r.kind, r.dst) for r in graph.adjacency(edges, offset=1, limit=1).orderBy("node").collect()] == [(3, 2, "k", 4), (5, 2, "k", 6)]


def test_figures_need_a_mutual_best_of_seventy(spark):
    rows = [("f1", "c1", 90), ("f1", "c2", 85), ("f2", "c2", 95), ("f3", "c3", 68), ("f4", "c4", 90), ("f4", "c5", 90), ("f5", "c6", 80), ("f6", "c6", 80)]
    got = {(r.f, r.c): r.status for r in graph.associate(spark.createDataFrame(rows, "f string, c string, s int"), "f", "c", "s").collect()}
    assert got == {("f1", "c1"): "Selected", ("f1", "c2"): "Candidate", ("f2", "c2"): "Selected", ("f3", "c3"): "Candidate", ("f4", "c4"): "Ambiguous", ("f4", "c5"): "Ambiguous", ("f5", "c6"): "Ambiguous", ("f6", "c6"): "Ambiguous"}
    score = lambda *x: spark.range(1).select(graph.figure_score(*map(F.lit, x))).first()[0]
    assert [score(0, True, True, True), score(1, False, True, False), score(-1, True, True, False), score(2, False, False, True), score(-2, False, False, False)] == [100, 90, 90, 56, 48]


def test_spans_merge_and_redact(spark):
    rows = spark.createDataFrame([(1, 0, "mail a@b.io or a@b.io, +1 (706) 555-3138"), (1, 1, "A@B.IO again"), (1, 2, "none"), (2, 0, "a@b.io2 is another"), (3, 0, None)], "id int, ord int, text string")
    spans = protect.merge_spans(protect.spans(rows, "id", "ord"), ["id", "ord"])
    assert sorted((r.id, r.ord, r.start, r.end) for r in spans.collect()) == [(1, 0, 6, 12), (1, 0, 16, 22), (1, 0, 24, 41), (1, 1, 1, 7), (2, 0, 1, 7)]
    found = lambda t, v: spark.range(1).select(protect.occurrences(F.lit(t), F.lit(v))).first()[0]
    assert found("aaabaa", "aa") == [1, 2, 5] and found("x.y x.y", "x.y") == [1, 5] and found("xay", "x.y") is None and found("q\\Eq", "\\E") == [2]
    assert rows.select(protect.redact(F.col("text"), "#").alias("t")).first().t == "mail # or #, #"
    assert [r[0] for r in spark.range(2).select(protect.bates(F.col("id") + 9999, "P", 4)).collect()] == ["P9999", "P10000"]


def test_templates(spark):
    with pytest.raises(ValueError):
        template.condition("IF a = b")
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, 7.0)], "id int, v double")
    assert [r.id for r in template.skip_records(rows, "SKIPIF v >= 7").collect()] == [1, 2]
    fields, cols = spark.createDataFrame([("A",), ("b",), ("c",), ("D",)], "field string"), spark.createDataFrame([("A",), ("B",), ("C",), ("c",), ("d",), ("dD",)], "name string")
    assert {r.field: r.status for r in template.bind_columns(fields, cols).collect()} == {"A": "ResolvedExact", "b": "ResolvedCaseInsensitive", "c": "ResolvedExact", "D": "ResolvedCaseInsensitive"}


def test_merge_islands(spark):
    cells = spark.createDataFrame([(1, r, s) for r, s in [(0, True), (1, False), (2, True), (5, False)]], "t int, row int, restart boolean")
    got = sorted((r.first_row, r.last_row, r.status) for r in ordered.merge_islands(cells, ["t"], "row", "restart").collect())
    assert got == [(0, 1, "CHAIN"), (2, 2, "CHAIN"), (5, 5, "ORPHAN_CONTINUATION")]


def test_semantic_differences(spark):
    base = ["alpha one", "beta two", "gamma three here", "eps five", "delta four", "x"]
    revised = ["delta four", "alpha one", "gamma three there", "eps five", "new line entirely", "x"]
    random.seed(5)
    cases = [(base, revised), (base, base), ([], ["a"]), (["", "a", ""], ["", "a", "", ""])]
    for _ in range(60):
        a = [random.choice("abcdefgh") * random.randint(1, 4) for _ in range(random.randint(1, 8))]
        b = [x for x in a if random.random() < 0.7] + [random.choice("xyz")]
        random.shuffle(b)
        cases.append((a, b))
    pairs = spark.createDataFrame([(i, "\n".join(a) if a else None, "\n".join(b)) for i, (a, b) in enumerate(cases)], "doc_id long, base string, revised string")
    rows = semantic.semantic_diff(pairs).collect()
    of = lambda i: sorted(((r.kind, r.base_ord, r.revised_ord) for r in rows if r.doc_id == i), key=str)
    assert of(0) == sorted([("Removed", 1, None), ("TextChanged", 2, 2), ("Moved", 4, 0), ("Added", None, 4)], key=str)
    assert of(1) == [] and of(2) == [("Added", None, 0)] and [k for k, *_ in of(3)] == ["Added"]
    for i, (a, b) in list(enumerate(cases))[3:]:
        kinds = [k for k, *_ in of(i)]
        assert kinds.count("Added") - kinds.count("Removed") == len(b) - len(a)


def test_similarity_in_plain_python():
    """Two thirds of shingle overlap, a fifth of the length ratio, the rest of common beginning and end; the alignment has the largest sum."""
    random.seed(17)
    grams = lambda t: {t[i: i + 3] for i in range(len(t) - 2)} or set(t)

    def plain(a, b):
        x, y, head = grams(a), grams(b), 0
        while head < min(len(a), len(b)) and a[head] == b[head]:
            head += 1
        tail = 0
        while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        return min(1, 0.67 * 2 * len(x & y) / (len(x) + len(y)) + 0.2 * min(len(a), len(b)) / max(len(a), len(b)) + 0.13 * (head + tail) / max(len(a), len(b)))

    for _ in range(150):
        a, b = (["".join(random.choice("abc ") for _ in range(random.randint(1, 14))) for _ in range(random.randint(1, 6))] for _ in range(2))
        b += [x[:-1] + "z" for x in a if random.random() < 0.5]
        got = {(i, j): v for i, j, v in semantic.similarities(a, b)}
        want = {(i, j): plain(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if grams(x) & grams(y) and plain(x, y) >= 0.56}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
        best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + got.get((i, j), 0))
        chain = semantic.best_chain([(i, j, v) for (i, j), v in got.items()], len(b))
        assert abs(sum(v for *_, v in chain) - best[-1][-1]) < 1e-9 and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(chain, chain[1:]))


def test_large_gaps_align_as_small_ones():
    """A block of new lines in a gap of repeated lines leaves all later pairs as they are."""
    a = [f"the line {i % 900} has some words of its own {i * i}" for i in range(1500)]
    b = a[:700] + [f"inserted {i} quite another thing" for i in range(100)] + [x + " more" for x in a[700:]]
    assert [(i, j) for i, j, _ in semantic.best_chain(semantic.similarities(a[:60], b[:60]), 60)] == [(i, i) for i in range(60)]
    pairs = semantic.best_chain(semantic.similarities(a[650:], b[650:]), len(b) - 650)
    assert [(i, j) for i, j, _ in pairs] == [(i, i) for i in range(50)] + [(i, i + 100) for i in range(50, 850)]


def test_semantic_diff_of_null_texts(spark):
    rows = semantic.semantic_diff(spark.createDataFrame([(1, None, "a\nb"), (2, "a", None), (3, None, None)], "doc_id long, base string, revised string")).collect()
    assert sorted((r.doc_id, r.kind) for r in rows) == [(1, "Added"), (1, "Added"), (2, "Removed")]


def test_texts_merge_line_by_line(spark):
    rows = [("a\nb\nc", "A\nb\nc", "a\nb\nC"), ("a\nb", "a\nx", "a\ny"), ("a", "a\nb", "a"), ("a", "z", "z"), ("", "", "")]
    got = spark.createDataFrame(rows, "a string, l string, r string").select(diff.merge_texts(F.col("a"), F.col("l"), F.col("r")).alias("m")).collect()
    assert [(r.m.outcome, r.m.text) for r in got] == [("TextMerged", "A\nb\nC"), ("Conflict", None), ("StructureConflict", None), ("TextMerged", "z"), ("TextMerged", "")]


def test_map_changes(spark):
    row = spark.sql("select map('a', '1', 'b', '2', 'n', cast(null as string)) as x, map('b', '3', 'c', '4', 'n', cast(null as string)) as y").select(diff.map_changes(F.col("x"), F.col("y")).alias("d")).first()
    assert [tuple(x) for x in row.d] == [("a", "Removed", "1", None), ("b", "Changed", "2", "3"), ("c", "Added", None, "4")]


def test_range_formulas(spark):
    cells = spark.createDataFrame([(1, r, c, float(10 * r + c)) for r in (1, 2, 3) for c in (1, 2)] + [(2, 1, 1, None)], "t int, r int, c int, v double")
    value = lambda name, ref: {x.t: x.result for x in template.range_formula(cells, name, ref, "t", "r", "c", "v").collect()}
    assert value("SUM", "A1:B2") == {1: 66.0, 2: None} and value("MAX", "B3:A2") == {1: 32.0, 2: None} and value("COUNT", "A1") == {1: 1, 2: 0}
    assert template.cell("AA10") == (10, 27)
    for bad in ("1A", "A0", "a1", "A1:"):
        with pytest.raises(ValueError):
            template.range_formula(cells, "SUM", bad if bad != "A1:" else "A1:x", "t", "r", "c", "v")


def test_subtrees_and_unknown_nodes(spark):
    rows = [(1, 0, 5, "body", "x"), (1, 1, 3, "paragraph", "a"), (1, 2, 2, "run", None), (1, 3, 3, "run", "b"), (1, 5, 5, "heading", "c"), (2, 0, 0, "heading", "z")]
    nodes = spark.createDataFrame(rows, "doc_id int, ord int, subtree_end int, kind string, text string")
    assert sorted(r.ord for r in query.within_node(nodes, 1, 1).collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        query.within_node(nodes, 1, 4)
    assert {(r.doc_id, r.ord): (r.parent_ord, r.depth) for r in query.with_parents(nodes).collect()} == {(1, 0): (None, 0), (1, 1): (0, 1), (1, 2): (1, 2), (1, 3): (1, 2), (1, 5): (0, 1), (2, 0): (None, 0)}
    assert {(r.doc_id, r.ord): r.text for r in query.node_texts(nodes, nodes.where("ord < 2")).collect()} == {(1, 0): "x\nab\nc", (1, 1): "ab", (2, 0): "z"}


def test_changes_of_some_authors_are_accepted(spark):
    rows = spark.createDataFrame([("keep", None, "a"), ("ins", "x", "b"), ("del", "x", "c"), ("ins", "y", "d"), ("del", "y", "e")], "kind string, author string, text string")
    texts = lambda *a: [(r.text, r.kind) for r in diff.accept_changes(rows, *a).collect()]
    assert texts(True) == [("a", "keep"), ("b", "keep"), ("d", "keep")] and texts(False) == [("a", "keep"), ("c", "keep"), ("e", "keep")]
    assert texts(True, ["x"]) == [("a", "keep"), ("b", "keep"), ("d", "ins"), ("e", "del")]


def test_sections_are_written_as_folders(spark, tmp_path):
    from foliospark.sources.markup import write_sections

    rows = spark.createDataFrame([(1, 0, "intro", False), (1, 1, "Head", True), (1, 2, "text", False), (2, 0, "Head", True)], "doc_id int, ord int, text string, head boolean")
    write_sections(rows, F.col("head"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.section): r.n for r in back.groupBy("doc_id", "section").agg(F.count("*").alias("n")).collect()} == {(1, 0): 1, (1, 1): 2, (2, 1): 1}
