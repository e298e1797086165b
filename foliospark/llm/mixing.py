"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled queue (by the md5 of their id),
twice over, as a document may be repeated once. A copy's virtual finish time
is the number of its source's words up to and with it, divided by the source's
weight. All copies are sorted by that time and taken until the budget is
spent. A source that has run out leaves its share to the others by weight,
as the contract's resharing asks, so the taken words come near the targets.

Neither a source nor the whole order is one task's work. Prefix sums are
two-level: queues are cut into ``QUEUE_PARTS`` ranges of the md5, the time
line into equal slices of which ``TIME_PARTS`` span the budget, and only the
sums of ranges and slices are cumulated in one place (a bounded number per
source); rows are cumulated inside their range or slice.

Null or empty texts have size 0 and take nothing; null sources form one
source, ordered last; a null id counts as the empty text. Repeated rows are
queued one by one. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import blank_words, fresh_name, shared_dir, table

WEIGHTS = (3, 1, 2)
EPOCHS = 2
SHARE = 1.5
QUEUE_PARTS, TIME_PARTS = 4096, 4096


def word_size(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words."""
    return F.size(blank_words(text)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share=SHARE, epochs=EPOCHS) -> DataFrame:
    """One row per source: sid, source, weight, source_size, target, and the time ``until`` at which the budget is spent."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    out = totals.withColumn("sid", F.row_number().over(by_name)).withColumn(
        "weight", F.element_at(cycle, ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    )
    # a source is exhausted at time full; before[k] is what those exhausted earlier have given
    by_full = W.orderBy("full", "sid")
    most = epochs * F.col("source_size")
    out = (
        out.withColumn("full", most / F.col("weight"))
        .withColumn("before", F.sum(most).over(by_full.rowsBetween(W.unboundedPreceding, 0)) - most)
        .withColumn("going", F.sum("weight").over(by_full.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(W.partitionBy(F.lit(1))) * F.lit(share))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("going"))
        .withColumn("until", F.max(F.when(F.col("level") <= F.col("full"), F.col("level"))).over(W.partitionBy(F.lit(1))))
    )
    return out.select(
        "sid", "source", "weight", "source_size",
        F.least(most.cast("double"), F.col("weight") * F.col("until")).alias("target"), "until", "budget",
    )


def mix(docs: DataFrame, doc_id="doc_id", text="text", source="source") -> DataFrame:
    """One row per document row: id, text_key, size, source_size, target, copies, taken."""
    tag = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    sized = shared_dir(
        docs.select(
            F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(source).cast("string").alias("source"),
            tag.alias("tag"), word_size(F.col(text)).alias("size"),
        ).withColumn("rid", F.monotonically_increasing_id())
    )
    targets = shared_dir(source_targets(sized))
    levels = targets.select("until", "budget").first()
    until, budget = (levels["until"] or 0.0, levels["budget"]) if levels else (0.0, 0.0)
    queue = sized.join(targets.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name")))
    head = F.conv(F.substring("tag", 1, 8), 16, 10).cast("long")
    queue = queue.withColumn("part", F.floor(head * QUEUE_PARTS / F.lit(1 << 32)))
    parts = queue.groupBy("sid", "part").agg(F.sum("size").alias("n"))
    before = parts.select("sid", "part", (F.sum("n").over(W.partitionBy("sid").orderBy("part")) - F.col("n")).alias("before"))
    inside = W.partitionBy("sid", "part").orderBy("tag", "id", "size", "rid").rowsBetween(W.unboundedPreceding, 0)
    copies = (
        queue.join(before, ["sid", "part"])
        .withColumn("upto", F.col("before") + F.sum("size").over(inside))
        .withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(EPOCHS)])))
        .withColumn("finish", (F.col("upto") + F.col("epoch") * F.col("source_size")) / F.col("weight"))
        .withColumn("slice", F.floor(F.col("finish") * (TIME_PARTS / until if until else 0.0)))
        .select("rid", "id", "text_key", "tag", "sid", "size", "source_size", "target", "epoch", "finish", "slice")
    )
    copies = shared_dir(copies)
    slices = copies.groupBy("slice").agg(F.sum("size").alias("n"))
    starts = slices.select("slice", (F.sum("n").over(W.orderBy("slice")) - F.col("n")).alias("start"))
    order = W.partitionBy("slice").orderBy("finish", "tag", "id", "epoch", "rid").rowsBetween(W.unboundedPreceding, 0)
    return (
        copies.join(starts, "slice")
        .withColumn("ok", F.col("start") + F.sum("size").over(order) <= F.lit(budget))
        .groupBy("rid")
        .agg(
            *[F.first(c).alias(c) for c in ("id", "text_key", "size", "source_size", "target")],
            F.count_if("ok").cast("int").alias("copies"),
        )
        .withColumn("taken", F.col("copies") * F.col("size"))
        .drop("rid")
    )


def mix_documents(docs: DataFrame) -> DataFrame:
    """The documents that the mix takes, with ``copies`` (how often) and ``taken`` (words, repeats counted).

    Rows that repeat an id and a text all get the copies of the one taken most.
    """
    i, key, copies, taken = (fresh_name(docs, c) for c in ("_id", "_key", "_copies", "_taken"))
    plan = mix(docs).groupBy(F.col("id").alias(i), F.col("text_key").alias(key)).agg(F.max("copies").alias(copies), F.max("taken").alias(taken)).where(F.col(copies) > 0)
    out = docs.drop("copies", "taken").join(plan, docs["doc_id"].eqNullSafe(F.col(i)) & F.xxhash64(docs["text"]).eqNullSafe(F.col(key)))
    return out.withColumnsRenamed({copies: "copies", taken: "taken"}).drop(i, key)


def op3_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents to one and a half times their words."""
    rows = mix(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS tag,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0b\x0c\r]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(sid - 1) % 3 + 1] AS weight FROM s),
f AS (SELECT *, CAST(2 * source_size AS DOUBLE) / weight AS full_at FROM w),
c AS (
  SELECT *, sum(2 * source_size) OVER (ORDER BY full_at, sid ROWS UNBOUNDED PRECEDING) - 2 * source_size AS before,
         sum(weight) OVER (ORDER BY full_at, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS going,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS budget FROM f),
l AS (SELECT *, (budget - CAST(before AS DOUBLE)) / CAST(going AS DOUBLE) AS level FROM c),
t AS (SELECT *, max(CASE WHEN level <= full_at THEN level END) OVER () AS until FROM l),
q AS (
  SELECT d.*, t.source_size, t.weight, t.budget, least(CAST(2 * t.source_size AS DOUBLE), t.weight * until) AS target,
         sum(size) OVER (PARTITION BY sid ORDER BY tag, doc_id, size, rid ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CAST(upto + epoch * source_size AS DOUBLE) / weight AS finish FROM q, (VALUES (0), (1)) v(epoch)),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, tag, doc_id, epoch, rid ROWS UNBOUNDED PRECEDING) <= budget AS ok FROM e)
SELECT doc_id, size, source_size, target, CAST(sum(CASE WHEN ok THEN size ELSE 0 END) AS BIGINT) AS taken
FROM g GROUP BY rid, doc_id, size, source_size, target
"""

QUERIES = {"op3_weighted_mix": op3_weighted_mix}
ORACLES = {"op3_weighted_mix": SQL}
