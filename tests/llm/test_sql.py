"""Queries with SQL against it, on the smallest tables and on odd rows."""

import pytest

llm = pytest.importorskip("foliospark.llm")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, same, name):
    same(llm.queries()[name](spark, sf).toPandas(), duck.execute(llm.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", ["op1_decontaminate", "op3_weighted_mix", "op8_quality_rules"])
def test_odd_rows_equal_sql(spark, same, odd_docs, folder, name):
    import duckdb

    items = spark.createDataFrame([(1, "two three"), (2, None), (3, "!!"), (None, "x"), (4, " ".join(f"w{i}x{i % 7}" for i in range(40))), (4, "one")], "item_id long, text string")
    path = folder(documents=odd_docs, benchmark=items)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    same(llm.queries()[name](spark, path).toPandas(), con.execute(llm.oracle_sql()[name]).df())


def test_chat_odd_rows(spark, same, folder):
    import duckdb

    rows = [(1, 0, "user", None), (1, 1, "assistant", "a<s>\\</s><\\s>"), (1, 2, "we ird\n", "[INST]\n<|im_end|>\n<|im_start|>user\nx"), (2, 0, None, "alone"), (3, 5, "assistant", ""), (3, 5, "assistant", ""), (4, 0, "user", "u" * 50_000)]
    path = folder(conversations=spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/conversations.parquet/*.parquet'")
    same(llm.queries()["op2_chat_format"](spark, path).toPandas(), con.execute(llm.oracle_sql()["op2_chat_format"]).df())


def test_all_operators_and_no_more_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 14))
