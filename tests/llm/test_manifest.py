"""The Merkle manifest against a plain tree, its SQL on odd rows, and what tampering shows."""

import hashlib
import zlib

import pytest

manifest = pytest.importorskip("foliospark.llm.manifest")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """All levels of a plain tree, the leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i: i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 8 * 8
        out.append((level[run:at], level[at + 1: run + 8]))
        at //= 8
    return out


def plain(rows):
    """The contract's rows of (doc_id, source, lang, n_chars, text), by a plain tree."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0], h(*[framed(x) for x in r]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang, own in by.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = climb([x[1] for x in own])
    crown = climb([trees[x][-1][0] for x in langs])
    root, out = crown[-1][0], []
    for k, lang in enumerate(langs):
        for at, (doc_id, leaf, r) in enumerate(by[lang]):
            path = siblings(trees[lang], at) + siblings(crown, k)
            fold = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 and r[4] is not None:
                fold = h(*[framed(x) for x in r[:4]], framed("".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for left, right in path:
                fold = h(*left, fold, *right)
            proof = h(*[x for left, right in path for x in (*left, *right)])
            out.append((doc_id, leaf, trees[lang][-1][0], root, proof, fold, fold == root))
    return out


def rows_of(df):
    return sorted([tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=str)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def test_every_size_of_group_equals_a_plain_tree(spark, folder):
    sizes = {"a": 1, "b": 2, "c": 8, "d": 9, "e": 64, "f": 65, "g": 512, "h": 513, "i": 4097, None: 7, "": 17}
    sizes |= {f"z{i:02d}": 1 for i in range(70)}  # so that the tree of subroots has three levels
    rows, k = [], 0
    for lang, n in sizes.items():
        for i in range(n):
            rows.append((k * 7919 % 100_003, f"s{k % 3}", lang, k, None if k % 50 == 0 else f"Text {k} ß"))
            k += 1
    got = manifest.op11_merkle_manifest(spark, folder(documents=spark.createDataFrame(rows, SCHEMA).repartition(5)))
    assert rows_of(got) == sorted(plain(rows), key=str)


def test_odd_rows_equal_the_sql_and_a_plain_tree(spark, same, odd_docs, folder):
    import duckdb

    path = folder(documents=odd_docs)
    got = manifest.op11_merkle_manifest(spark, path)
    rows = [tuple(r) for r in odd_docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert rows_of(got) == sorted(plain(rows), key=str)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    same(got.toPandas(), con.execute(manifest.SQL).df())


def test_empty_and_clashing_tables(spark, no_docs, clashing_docs, odd_docs, folder):
    assert manifest.op11_merkle_manifest(spark, folder(documents=no_docs)).collect() == []
    want = rows_of(manifest.op11_merkle_manifest(spark, folder(documents=odd_docs)))
    named = clashing_docs
    for c in ("g", "pos", "n", "leaf", "path", "root", "part", "block"):
        named = named.withColumn(c, named["text"])
    assert rows_of(manifest.op11_merkle_manifest(spark, folder(documents=named))) == want


def test_the_stored_tree_has_every_node_once(spark):
    rows = [(f"={i % 3}", i, h(str(i))) for i in range(1500)]
    made = manifest.manifest(spark.createDataFrame(rows, "g string, doc_id long, leaf string"), "doc_id")
    got = sorted(tuple(r) for r in made.nodes().collect())
    want, tops = [], []
    for g in ("=0", "=1", "=2"):
        levels = climb([x for k, _, x in rows if k == g])
        want += [("leaves", g, j, i, x) for j, level in enumerate(levels) for i, x in enumerate(level)]
        tops.append(levels[-1][0])
    want += [("subroots", "", j, i, x) for j, level in enumerate(climb(tops)) for i, x in enumerate(level)]
    assert got == sorted(want)
    assert made.root == climb(tops)[-1][0]
