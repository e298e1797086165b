"""Benchmark decontamination [native]: winnowed fingerprints, a join, extended hits.

Words are runs of digits, a-z (after lower-casing A-Z) and characters beyond
ASCII. A window is ``WINDOW`` consecutive words of an item, or the whole item
where it has fewer. Both sides are winnowed: of each run of ``WINNOW``
consecutive ``GRAM``-word hashes the least is kept, and GRAM + WINNOW - 1 =
WINDOW, so any shared window leaves a shared fingerprint. A document that
shares a fingerprint is a candidate; its hits are extended by an equi-join
of its windows with the items' windows, which decides alone, so chance
fingerprints cost time but change nothing. DataFrame functions only.

The items are never sent to the executors by force: Spark broadcasts them if
they are under its threshold. The candidates' keys are counted and broadcast
up to ``BROADCAST_ROWS`` rows (16 bytes each), else joined by shuffle.

Nulls: a null text has no words; a null document id is a key like any other;
a null item id counts as the empty string. Rows that repeat an id and a text
get the same answer each. Items of fewer words than a window are matched
whole, by windows of their own length. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, fresh_name, let, shared_dir, table

WINDOW, GRAM, WINNOW = 13, 5, 9
BROADCAST_ROWS = 500_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _grams(h: Column, n: int) -> Column:
    """Hashes of all n-word runs; none where there are fewer words."""
    none = F.array().cast("array<bigint>")
    return F.when(F.size(h) < n, none).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(n))))
    )


def _winnow(h: Column) -> Column:
    """The distinct least gram hashes of all windows."""
    none = F.array().cast("array<bigint>")

    def least(g):
        runs = F.transform(F.sequence(F.lit(1), F.size(g) - (WINNOW - 1)), lambda i: F.array_min(F.slice(g, i, F.lit(WINNOW))))
        return F.when(F.size(g) < WINNOW, none).otherwise(F.array_distinct(runs))

    return let(_grams(h, GRAM), least)


def _prints(h: Column, short: list[int]) -> Column:
    """Fingerprints of a document: the winnowed ones, and every run of the lengths that short items have."""
    parts = [_winnow(h), *[_grams(h, n) for n in short]]
    return F.array_distinct(F.concat(*parts)) if short else parts[0]


def _covered(spans: Column) -> Column:
    """Words inside the union of (start, length) spans."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["p"] + s["len"] - F.greatest(acc["to"], s["p"]))).alias("n"),
        F.greatest(acc["to"], s["p"] + s["len"]).alias("to"),
    )
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    return F.aggregate(F.sort_array(spans), start, step, lambda acc: acc["n"]).cast("long")


def contamination(docs: DataFrame, items: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text") -> DataFrame:
    """One row per document row: ``id``, ``text_key``, ``n_words``, ``n_hit``, ``items`` (sorted ids), ``spans``.

    ``spans`` lists the windows found as (p, len), in words.
    """
    item = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), _word_hashes(F.col(item_text)).alias("h")
    ).where(F.size("h") > 0)
    # at most twelve numbers
    short = sorted(r[0] for r in item.select(F.size("h").alias("n")).where(F.col("n") < WINDOW).distinct().collect())
    whole = F.size("h") >= WINDOW
    marks = item.select(
        F.explode(F.when(whole, _winnow(F.col("h"))).otherwise(F.array(F.xxhash64(F.col("h"))))).alias("g")
    ).distinct()
    windows = item.select("item", F.explode(F.when(whole, _grams(F.col("h"), WINDOW)).otherwise(F.array(F.xxhash64(F.col("h"))))).alias("g"))
    # windows with the same items form a class, so a passage of many items is counted once
    sets = windows.groupBy("g").agg(F.sort_array(F.collect_set("item")).alias("its"))
    sets = sets.select("g", F.xxhash64("its").alias("cls"), "its")
    classes = sets.groupBy("cls").agg(F.first("its").alias("its"))

    own = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("_text"))
    own = own.withColumn("h", _word_hashes(F.col("_text")))
    base = (
        own.select("id", "text_key", F.size("h").cast("long").alias("n_words"), F.explode_outer(_prints(F.col("h"), short)).alias("g"))
        .join(marks.withColumn("hit", F.lit(1)), "g", "left")
        .groupBy("id", "text_key", "n_words")
        .agg(F.max("hit").alias("hit"))
    )
    base = shared_dir(base)
    cand = base.where("hit = 1").select(F.col("id").alias("cid"), F.col("text_key").alias("ckey"))
    if cand.count() <= BROADCAST_ROWS:
        cand = F.broadcast(cand)
    lens = [WINDOW, *short]
    placed = lambda n: F.transform(_grams(F.col("h"), n), lambda g, i: F.struct(g.alias("g"), i.alias("p"), F.lit(n).alias("len")))
    runs = F.concat(*map(placed, lens))
    found = (
        docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("_text"))
        .join(cand, F.col("id").eqNullSafe(F.col("cid")) & (F.col("text_key") == F.col("ckey")), "left_semi")
        .withColumn("h", _word_hashes(F.col("_text")))
        .select("id", "text_key", F.explode(runs).alias("r"))
        .select("id", "text_key", "r.*")
        .join(sets.select("g", "cls"), "g")
        .groupBy("id", "text_key")
        .agg(F.collect_set(F.struct("p", "len")).alias("spans"), F.collect_set("cls").alias("clss"))
    )
    named = (
        found.select("id", "text_key", "spans", F.explode("clss").alias("cls"))
        .join(classes, "cls")
        .groupBy("id", "text_key")
        .agg(F.first("spans").alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("its")))).alias("items"))
        .select(F.col("id").alias("fid"), F.col("text_key").alias("fkey"), _covered(F.col("spans")).alias("n_hit"), "items", F.sort_array("spans").alias("spans"))
    )
    rows = docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("text_key"))
    counted = base.select(F.col("id").alias("bid"), F.col("text_key").alias("bkey"), "n_words")
    return (
        rows.join(counted, F.col("id").eqNullSafe(F.col("bid")) & (F.col("text_key") == F.col("bkey")), "left")
        .join(named, F.col("id").eqNullSafe(F.col("fid")) & (F.col("text_key") == F.col("fkey")), "left")
        .select(
            "id", "text_key", "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
            F.coalesce("spans", F.array().cast("array<struct<p:int,len:int>>")).alias("spans"),
        )
    )


def is_contaminated() -> Column:
    """The rule: a twentieth of a document's words or more lie in hits."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text) that aren't contaminated, with their own columns."""
    i, key = fresh_name(docs, "_bid"), fresh_name(docs, "_bkey")
    bad = contamination(docs, items).where(is_contaminated()).select(F.col("id").alias(i), F.col("text_key").alias(key)).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(i)) & (F.xxhash64(docs["text"]) == F.col(key)), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the whole benchmark in all documents."""
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT item, n, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT item, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, n, i, array_to_string(ws[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, lens WHERE len(ws) >= n)),
hit AS (SELECT rid, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT rid, item FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN its USING (rid)
"""

QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES = {"op1_decontaminate": SQL}
