"""Helpers that the operators share."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("foliospark.llm")
from foliospark.llm import common, lm  # noqa: E402


def test_arrow_words_are_the_rule():
    import pyarrow as pa

    rng = random.Random(11)
    texts = ["".join(rng.choice([" ", "\t", "\n", "\x0b", "a", "Bc", "É", "😀", "\x1c", "\x85", " "]) for _ in range(rng.randint(0, 30))) for _ in range(500)] + [None, ""]
    for array in (pa.array(texts), pa.array(["x"] * 3 + texts).slice(3), pa.array(texts, pa.large_string())):
        raw, starts, ends, rows = common.arrow_words(array)
        got = [bytes(raw[a:b]).decode() for a, b in zip(starts, ends)]
        want = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) for t in texts]
        assert [got[a:b] for a, b in zip(rows, rows[1:])] == want
        hashes = common.hash_words(raw, starts, ends)
        assert len(set(hashes.tolist())) == len(set(got)) and len({(h, w) for h, w in zip(hashes.tolist(), got)}) == len(set(got))


def test_hash_of_long_words_sees_order():
    a, b = b"x" * 64 + b"y" * 64, b"y" * 64 + b"x" * 64
    raw = np.frombuffer(a + b, np.uint8)
    h = common.hash_words(raw, np.array([0, 128]), np.array([128, 256]))
    assert h[0] != h[1]


def test_distinct():
    codes, values, first = common.distinct(np.array([5, 3, 5, 9, 3]))
    assert codes.tolist() == [0, 1, 0, 2, 1] and values.tolist() == [5, 3, 9] and first.tolist() == [0, 1, 3]


def test_hashed_sample_is_bounded_and_repeats(spark):
    df = spark.range(20_000)
    got = common.hashed_sample(df, F.col("id"), 1000)
    assert 800 < got.count() < 1200 and got.count() == common.hashed_sample(df, F.col("id"), 1000).count()
    assert common.hashed_sample(df, F.col("id"), 30_000).count() == 20_000


def test_sum_vectors(spark):
    import pyarrow as pa

    def rows(batches):
        for _ in batches:
            pass
        yield pa.RecordBatch.from_arrays([pa.array(["a", "b"]), pa.array([np.ones(3).tobytes(), np.full(2, 2.0).tobytes()])], names=["part", "v"])

    got = {r["part"]: np.frombuffer(r["v"]).tolist() for r in common.sum_vectors(spark.range(0, 300, 1, 300).mapInArrow(rows, "part string, v binary"), width=8).collect()}
    assert got == {"a": [300.0] * 3, "b": [600.0] * 2}


def test_most_frequent_keeps_whole_bins(spark):
    counts = spark.range(1, 1001).select(F.col("id").alias("key"), F.floor(1000 / F.col("id")).alias("n"), F.lit(0).cast("byte").alias("cls"))
    keys, n = lm.most_frequent(counts, 50)
    assert 20 <= len(keys) <= 50 and n.min() >= 1000 // 51 and (np.diff(keys) > 0).all()
    assert len(lm.most_frequent(counts.where("key < 0"), 50)[0]) == 0
