"""Longest common subsequences of any length: as long as the whole table says, in memory that grows with the sequences."""

import random
import time
import tracemalloc

import pytest
from pyspark.sql import functions as F

from foliospark.operators import diff


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@pytest.mark.parametrize("kinds", [1, 2, 7, 60, 400])
def test_as_long_as_the_whole_table_says(kinds):
    rng = random.Random(kinds)
    for size in (0, 1, 40, 150, 300):
        a, b = ([rng.randrange(kinds) for _ in range(rng.randint(size // 2, size))] for _ in range(2))
        got = diff.common_sequence(a, b)
        assert all(a[i] == b[j] for i, j in got) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:]))
        assert len(got) == longest(a, b)


def test_edits_of_a_long_line_are_found_in_little_memory():
    rng = random.Random(8)
    words = [f"w{rng.randrange(3000)}" for _ in range(20_000)]
    edited = list(words)
    for k in range(500, 20_000, 1000):
        edited[k] = "new"
    tracemalloc.start()
    assert diff.changed_spans(" ".join(words), " ".join(edited)) == 20
    assert len(diff.common_sequence(["x"] * 20_000, ["x"] * 9_000 + ["y"])) == 9_000
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()


def test_equal_lines_between_edits(spark):
    base = ["same"] * 3000 + ["a"] + ["same"] * 3000
    revised = ["same"] * 2990 + ["b"] + ["same"] * 3005
    rows = diff.compare_documents(spark.createDataFrame([(1, "\n".join(base), "\n".join(revised))], "doc_id long, base string, revised string")).collect()
    n = {c: sum(r.change == c for r in rows) for c in ("modified", "deleted", "inserted")}
    assert (n["modified"] + n["deleted"], n["modified"] + n["inserted"]) == (6, 1)


def test_shingle_dice_of_odd_and_many_texts(spark):
    pairs = [("abcd", "abce", 0.5), ("ab", "abc", 0.0), ("ab", "ac", 0.5), ("", "", 1.0), ("", "x", 0.0), (None, "x", 0.0), (None, None, 1.0), ("a😀b😀b😀", "a😀b", 0.5), ("aaaaaa", "aaa", 1.0)]
    got = diff.shingle_dice(spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a string, b string"), "a", "b").orderBy("i").collect()
    assert [r.dice for r in got] == [x for *_, x in pairs]
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(150)), lambda k: F.substring(F.sha2((F.col("id") * 1000 + k).cast("string"), 256), 1, 9)), " ")
    many = spark.range(12_000, numPartitions=4).select("id", words.alias("a")).withColumn("b", F.col("a")).persist()
    assert many.count() == 12_000
    began = time.time()
    assert diff.shingle_dice(many, "a", "b").where("dice = 1").count() == 12_000
    assert time.time() - began < 40, "each pair takes time in proportion to its characters, a few microseconds each at most"
    many.unpersist()
