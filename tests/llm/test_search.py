"""Ranked search against plain counting, on odd rows, in blocks of the index and over long texts."""

import math
import re
from collections import Counter

import pytest

search = pytest.importorskip("foliospark.llm.search")
TERM = re.compile(search.TERM)


def words(text):
    return [] if text is None else ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in TERM.findall(text)]


def plain(docs, items, top=20):
    """(item_id, rank, doc_id, score) by the contract, from all pairs."""
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, c) for i, c in bags if c]
    n_docs, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(w for _, c in bags for w in c)
    out = []
    for item, text in items:
        rows = []
        for doc_id, bag in bags:
            m = 75 + (25 * sum(bag.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * bag[w]) // (1000 * bag[w] + 12 * m)) for w in words(text) if bag[w])
            if s > 0:
                rows.append((-s, doc_id is None, doc_id or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(rows)[:top])]
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


ITEMS = [(1, "one TWO three"), (2, None), (3, "!!"), (None, "x text"), (4, " ".join(f"w{i}x{i % 7}" for i in range(300))), (4, "one"), (4, "one"), (5, "ünïcödé Ünïcödé ß İ"), (6, "nowhere to be found")]


@pytest.mark.parametrize("entries", [4_000_000, 3])
def test_odd_rows_equal_plain_counting_in_any_number_of_blocks(spark, odd_docs, entries):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("q", search.F.lit("own"))
    rows = odd_docs.withColumn("at", search.F.lit("own")).withColumn("score", search.F.lit("own"))
    assert got(search.search(rows, items, entries=entries)) == plain(docs, ITEMS)


def test_ties_and_heaps_over_many_tasks(spark):
    docs = [(i, f"alpha {'beta ' * (i % 3)}w{i % 11}") for i in range(900)] + [(None, "alpha beta beta w3"), (7, "alpha beta w7")]
    items = [(1, "alpha beta"), (2, "w3"), (3, "beta beta alpha w10")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(130)
    assert got(search.search(df, spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items)
    assert got(search.search(df, spark.createDataFrame(items, "item_id long, text string"), top=3)) == plain(docs, items, 3)


def test_texts_longer_than_a_step(spark):
    long_text = "alpha " * 300_000 + "b" * (search.STEP + 10) + " omega" + "é" * 700_000
    assert search.term_counts(long_text.encode()) == Counter(w.encode() for w in words(long_text))
    docs, items = [(1, long_text), (2, "omega alpha"), (3, "none")], [(1, "alpha omega"), (2, "é" * 3)]
    assert got(search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items)


def test_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(no_docs, items).collect() == []
    assert search.search(odd_docs, items.where("item_id = 2")).collect() == []
    assert search.search(odd_docs, items.limit(0)).collect() == []
