"""Queries over tables whose keys go beyond those of the test data."""

import os

import duckdb
import pytest

import __spark_entry__

#: A part without a parent's row, and one a million further with all rows of its own chain.
FAR = [450, *(1_000_450 >> k for k in range(20))]


@pytest.mark.parametrize("name", ["lint_rule_counts", "lint_rule_findings"])
def test_a_parent_without_a_row_stays_missing(spark, sf, same, tmp_path, name):
    con = duckdb.connect()
    for file in os.listdir(sf):
        if file != "part.parquet":
            os.symlink(f"{sf}/{file}", tmp_path / file)
    con.execute(f"COPY (SELECT CAST(k AS BIGINT) AS p_partkey, p.* EXCLUDE (p_partkey) FROM (SELECT unnest({FAR}) AS k), (SELECT * FROM '{sf}/part.parquet' WHERE p_partkey = 1) p) TO '{tmp_path}/part.parquet'")
    for file in os.listdir(tmp_path):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{tmp_path}/{file}'")
    got, want = __spark_entry__.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(__spark_entry__.oracle_sql()[name]).df()
    assert (want["rule"] == "STYLE_GRAPH").any()
    same(got, want)
