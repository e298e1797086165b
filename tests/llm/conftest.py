import pytest
from pyspark.sql import functions as F

WORDS = "the of and red blue green dog cat runs over under hill river stone house tree light dark old new".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with nulls in each column, empty and blank texts, repeated rows, ties, a very long text, and extra columns with clashing names."""
    long_text = " ".join(f"w{i % 3000}x{i % 7}" for i in range(30_000))
    rows = [
        (1, "one two three", "en", "a", 13), (1, "one two three", "en", "a", 13), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \t\n ", "en", "b", 4),
        (5, "x", "en", "b", 1), (6, long_text, "en", None, len(long_text)), (None, "text without an id", "en", "c", 18), (7, "Ünïcödé ß İ     ▁ z", "de", "c", 20),
        (8, "a\x00b <s>[INST] \\ </s>", "en", "a", 20),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for extra in ("n_words", "fail_bits", "copies", "prefix", "n_tokens", "base", "found"):
        df = df.withColumn(extra, F.lit("own"))
    return df


@pytest.fixture(scope="session")
def clashing_docs(odd_docs):
    """The odd rows with columns that carry the names which operators use themselves."""
    df = odd_docs
    for name in ("_id", "_key", "_copies", "_taken", "_bid", "_bkey", "_gone", "_words", "_lines", "_own", "_text", "id", "key", "row", "least", "h", "g", "rid", "tag", "size", "taken", "n_hit", "items", "spans", "KEPT"):
        df = df.withColumn(name, F.lit("own"))
    return df


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = -1")


@pytest.fixture
def folder(tmp_path):
    """Write tables to a folder as the queries read them."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
