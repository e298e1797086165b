"""Personal data: base rules against the contract's expressions, candidates, the graph's scores against plain sums, and planted contexts."""

import hashlib
import math
import random
import re
import time

import pytest

pii = pytest.importorskip("foliospark.llm.pii")


def plain_base(text):
    """The base rules by the contract's own expressions."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_expressions():
    rng = random.Random(5)
    pieces = ["a", "b.c", "@", ".", "x.y", "-", "+", "1", "22", "255", "256", "4111 1111 1111 1111", "4111111111111111", "+1 (234) 555-7777", " ", "\n", "(", ")", "é", "192.168.0.1", "a@b.c", "0000", "%", "z9"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        assert pii.base_spans(text) == plain_base(text), text
    assert pii.base_spans("") == []


@pytest.mark.parametrize("text", ["a" * 400_000, "a@" * 200_000, "1 " * 200_000 + "x", "1." * 200_000, "1" * 400_000, "+1" * 200_000, "+1" + " " * 400_000, " at " * 100_000, "a.b" * 150_000 + "@", "a:" * 200_000, "*" * 400_000, "1.1.1." * 70_000 + "x"])
def test_long_runs_take_linear_work(text):
    def took(t):
        began = time.process_time()
        pii.read_text(t)
        return time.process_time() - began

    assert took(text) < 24 * took(text[: len(text) // 8]) + 1


def test_candidates_never_meet_base_spans_or_each_other():
    rng = random.Random(6)
    pieces = ["jane (at) mail (dot) org", "bob@local", "555-0199", "10.0.0.999", "4111-1111-1111-1112", "a@b.cd", "+1 (234) 555-7777", " ", " at ", "\n", "fe80::1:2", "word", "12", ".", ":", "*"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 9)))
        base = pii.base_spans(text)
        found = pii.candidates(text, base)
        reach = 0
        for a, b in found:
            assert a >= reach and b > a
            assert not any(s < b and a < e for s, _, e in base), text
            reach = b


def plain_graph(edges, rounds=pii.ROUNDS):
    """The scores of the docstring by dictionaries: ({(pattern, kind): confidence}, {instance: (kind, confidence)})."""
    known, sure = {}, {}
    by = {}
    for p, i, kind, could in edges:
        by.setdefault(p, []).append((i, kind, could))
    for _ in range(rounds):
        sure = {}
        for p, own in by.items():
            for k in range(4):
                seed = sum(kind == k for _, kind, _ in own)
                open_ = sum(kind == -1 and could >> k & 1 for _, kind, could in own)
                settled = [known[i][1] for i, kind, _ in own if kind == -1 and i in known and known[i][0] == k]
                gained = sum(settled)
                held = seed + gained
                if seed + len(settled) >= pii.SUPPORT and (c := held / (held + len(own) - seed - open_ + pii.DOUBT * (open_ - gained))) >= pii.SURE:
                    sure[p, k] = c
        wrong = {}
        for p, i, kind, could in edges:
            for k in range(4):
                if kind == -1 and could >> k & 1 and (p, k) in sure:
                    wrong[i, k] = wrong.get((i, k), 0.0) + math.log1p(-min(0.999, sure[p, k]))
        known = {}
        for (i, k), x in sorted(wrong.items(), key=lambda y: y[0][1]):
            if (c := 1 - math.exp(x)) >= pii.SURE and c > known.get(i, (0, 0.0))[1] + 1e-12:
                known[i] = (k, c)
    return sure, known


def test_rounds_of_the_graph_equal_plain_sums(spark):
    rng = random.Random(7)
    rows = set()
    instances = {f"i{n}": (rng.choice([-1, -1, 0, 1, 2, 3]), rng.choice([1, 2, 4, 8, 10, 12])) for n in range(120)}
    for p in range(40):
        liked = rng.choice([0, 1, 2, 3])
        for i, (kind, could) in instances.items():
            if rng.random() < (0.35 if kind == liked else 0.08 if kind == -1 and could >> liked & 1 else 0.01):
                rows.add((f"p{p}", i, kind, could if kind < 0 else 1 << kind))
    seen = spark.createDataFrame([([p], i.encode(), k, c) for p, i, k, c in rows], "patterns array<string>, instance binary, kind int, could int")
    patterns, known = pii.bootstrap(seen)
    want_patterns, want_known = plain_graph(sorted(rows))
    assert {(r["pattern"], r["kind"]): round(r["confidence"], 9) for r in patterns.collect()} == {k: round(v, 9) for k, v in want_patterns.items()}
    assert {r["instance"].decode(): (r["kind"], round(r["confidence"], 9)) for r in known.collect()} == {i: (k, round(c, 9)) for i, (k, c) in want_known.items()}
    assert want_known


def spans_of(df, text="text"):
    return {(r["doc_id"], pii.KINDS[s["kind"]], r[text][s["start"]: s["end"]]) for r in df.collect() for s in r["found"]}


def test_contexts_find_what_no_rule_names(spark):
    docs = [f"please call me at +1 ({200 + i}) 555-{7000 + i} tonight" for i in range(6)] + ["so call me at 555-0199 tonight", "you call me at 0171 5550123 tonight", "order number 555-0188 came", "they met me at 12:30 tonight"]
    docs += [f"write to mail: user{i}@host.example.org now" for i in range(5)] + ["write to mail: jane [at] host [dot] org now", "look at example.com now"]
    docs += [f"the server ip = 10.0.{i}.7 is down" for i in range(5)] + ["the server ip = fe80::1:2a is down", "the server ip = 10.0.300.7 is down"]
    # in the second round the number that was found supports a context of its own
    docs += ["reach us under 555-0199", "reach us under 0171 5550123", "reach us under +1 (999) 555-1212", "reach us under 555-0777"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("kind", pii.F.lit("own"))
    found = spans_of(pii.find_personal(df))
    new = {(k, t) for d, k, t in found if (d, k, t) not in {(i, pii.KINDS[k], x[a:b]) for i, x in enumerate(docs) for a, k, b in plain_base(x)}}
    assert new >= {("phone", "555-0199"), ("phone", "0171 5550123"), ("email", "jane [at] host [dot] org"), ("ip", "fe80::1:2a"), ("ip", "10.0.300.7"), ("phone", "555-0777")}
    assert not {t for _, t in new} & {"555-0188", "12:30", "look at example.com"}
    assert {(i, pii.KINDS[k], x[a:b]) for i, x in enumerate(docs) for a, k, b in plain_base(x)} <= found


def test_query_on_odd_rows(spark, odd_docs, clashing_docs, no_docs, folder):
    extra = [(20, "a@b.cd and 1.2.3.4, 4111 1111 1111 1111 or +1 (234) 555-7777", "en", "a", 60), (20, "a@b.cd", "en", "a", 6)]
    df = odd_docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long"))
    rows = pii.op12_pii(spark, folder(documents=df)).collect()
    want = []
    for r in df.collect():
        base = plain_base(r["text"] or "")
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        want.append((r["doc_id"], *[sum(k == x for _, x, _ in base) for k in range(4)], hashlib.sha256(line.encode()).hexdigest(), line))
    assert sorted([tuple(r) for r in rows], key=str) == sorted(want, key=str)
    assert pii.op12_pii(spark, folder(documents=no_docs)).collect() == []
    named = clashing_docs.withColumn("seen", pii.F.lit("own")).withColumn("_row", pii.F.lit("own")).withColumn("instance", pii.F.lit("own"))
    assert len(pii.find_personal(named).collect()) == named.count()
