"""Ranked search against plain loops over all entries and queries."""

import random
import re
import time

import pytest

from foliospark.operators import ranking


def tokens(text):
    return [t for t in re.split(r"[ \-_/.:]+", (text or "").lower()) if t]


def same(a, b):
    plural = lambda x, y: y == x + "s" or x.endswith("y") and y == x[:-1] + "ies"
    return a == b or plural(a, b) or plural(b, a)


def plain(entries, queries, most):
    names, out = {n for n, _ in entries}, []
    for query, text in queries:
        terms, rows = tokens(text), []
        if not terms:
            continue
        for name, description in entries:
            own, words = tokens(name), " ".join(tokens(description))
            explicit = "apply" in terms and "plan" not in terms
            plans = name.startswith("plan_") and ("apply_" + name[5:] in names or name.endswith("_apply") and "apply_" + name[5:-6] in names)
            applies = name.startswith("apply_") and ("plan_" + name[6:] in names or "plan_" + name[6:] + "_apply" in names)
            matched, spots = 0, []
            for i, t in enumerate(own):
                if matched < len(terms) and same(t, terms[matched]):
                    matched += 1
                    spots.append(i)
            far = 10_000 + len(own) - min(len(own), matched) if matched < len(terms) else (spots[-1] - spots[0] + 1 - len(terms)) * 100 + abs(len(own) - len(terms))
            row = (own == terms, explicit and applies, " ".join(terms) in " ".join(own), sum(any(same(t, q) for t in own) for q in terms), not explicit and plans, far, sum(q in words for q in terms))
            if row[0] or row[2] or row[3] or row[6]:
                rows.append(((-row[0], -row[1], -row[2], -row[3], -row[4], row[5], -row[6], name), name))
        out += [(query, k, name) for k, (_, name) in enumerate(sorted(rows)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("most", [12, 2])
def test_equals_plain_loops(spark, most):
    rng = random.Random(16)
    words = ["table", "tables", "entry", "entries", "es", "s", "apply", "plan", "read", "reader", "a", "ab", "abc", "Ünit"]
    entries = {}
    for _ in range(150):
        name = "_".join(rng.choice(words) for _ in range(rng.randint(1, 4)))
        entries.setdefault(rng.choice(["plan_", "apply_", "", ""]) + name + rng.choice(["", "", "_apply"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) if rng.random() < 0.9 else None)
    queries = [(k, rng.choice(["", " "]).join([rng.choice([" ", "-", "_", ".:"]).join(rng.choice([*words, "tab", "ntr", "ies", "nothing"]) for _ in range(rng.randint(1, 4)))])) for k in range(60)] + [(100, ""), (101, None), (102, "--"), (103, "table table")]
    got = ranking.ranked(spark.createDataFrame(list(entries.items()), "name string, description string"), spark.createDataFrame(queries, "query long, text string"), most)
    assert sorted((r["query"], r["rank"], r["name"]) for r in got.collect()) == plain(list(entries.items()), queries, most)


def test_bounds(spark):
    empty = spark.createDataFrame([], "name string, description string")
    asked = spark.createDataFrame([(1, "x")], "query long, text string")
    assert ranking.ranked(empty, asked).collect() == []
    for most in (0, 13):
        with pytest.raises(ValueError):
            ranking.ranked(empty, asked, most)


def test_many_entries_that_no_term_tells_apart(spark):
    from pyspark.sql import functions as F

    key = F.col("id").cast("string")
    entries = spark.range(60_000, numPartitions=4).select(F.concat(F.lit("plan_item_"), key).alias("name"), F.concat(F.lit("colour:"), (F.col("id") % 50).cast("string")).alias("description"))
    queries = spark.range(200).select(key.alias("query"), F.when(F.col("id") % 2 == 0, "plan item").otherwise(F.concat(F.lit("items "), key)).alias("text"))
    began = time.time()
    got = ranking.ranked(entries, queries).collect()
    assert time.time() - began < 90, "entries are compared by what the terms tell apart"
    found = {(r.query, r.rank): r.name for r in got}
    least = sorted(f"plan_item_{i}" for i in range(60_000))[:12]
    assert [found["0", k] for k in range(1, 13)] == [found["198", k] for k in range(1, 13)] == least and found["17", 1] == "plan_item_17" and len(got) == 2400
