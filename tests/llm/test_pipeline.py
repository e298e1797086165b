"""The pipeline on the smallest tables, stage by stage, against plain Python."""

import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from foliospark.llm import secrets  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf, tmp_path):
    from foliospark.llm import decontaminate, near_dup, quality_rules

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k + 1 < len(pipeline.STAGES):
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = ({r.doc_id: r for r in df.collect()} for df in (docs, out))
        assert len(after) == out.count()
        if name == "quality_rules":
            gone = {r.doc_id for r in quality_rules.ledger(docs).where("fail_bits <> 0").collect()}
            assert after.keys() == before.keys() - gone
            assert all(len(WORD.findall(r.text)) >= 50 for r in after.values())
        elif name == "near_dedup":
            roots = {r.id: r.component_id for r in near_dup.near_duplicates(docs).collect()}
            assert after.keys() == set(roots.values())
        elif name == "decontamination":
            items = spark.read.parquet(f"{sf}/benchmark.parquet")
            gone = {r.id for r in decontaminate.contamination(docs, items).where(decontaminate.is_contaminated()).collect()}
            assert after.keys() == before.keys() - gone
        elif name == "secret_scan":
            assert after.keys() == before.keys()
            for i, r in after.items():
                spans = secrets.scan_layers(before[i].text)[1]
                assert (r.text == before[i].text) == (not spans) and r.n_chars == len(r.text)
                assert not [s for s in secrets.scan(r.text) if secrets.MASK not in r.text[s[0]: s[2]]] or not spans
        else:
            size = {i: len(WORD.findall(r.text)) for i, r in before.items()}
            assert after.keys() <= before.keys()
            assert all(r.copies in (1, 2) and r.taken == r.copies * size[i] for i, r in after.items())
            total = sum(r.taken for r in after.values())
            assert total <= 1.5 * sum(size.values()) and total > 1.5 * sum(size.values()) - 2 * max(size.values())
        docs = out


def test_stages_keep_columns_that_clash(spark, sf, clashing_docs):
    """Each stage takes columns with the names that operators use themselves, and gives them back as they were."""
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, clashing_docs, sf)
        assert out.columns == clashing_docs.columns and out.where("_id <> 'own' or id <> 'own' or _key <> 'own' or KEPT <> 'own'").count() == 0, name
    mixed = pipeline.STAGES[-1][1](spark, clashing_docs, sf)
    assert set(clashing_docs.columns) <= set(mixed.columns) and mixed.where("_copies <> 'own' or tag <> 'own'").count() == 0 and mixed.count() > 0


def test_run_keeps_what_the_stages_keep(spark, sf):
    out = pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "text", "copies", "taken"} <= set(out.columns)


def test_run_with_no_documents(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 0").write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
