"""Ranked lexical search, reversed: the documents are streamed through an index of the queries.

The terms of all items become an inverted index (term -> items that ask for it, with how often), which
is broadcast. Each document's term counts pass through it once, so a document is scored for all items at a time, and every
task keeps a bounded heap of the best documents for each item. The heaps are merged in two
levels, by runs of tasks and then by item, so what is merged is bounded by tasks, not by documents.

The index is bounded: items are dealt by a hash to so many blocks that each has about
``POSTINGS`` entries, and the documents are streamed once for each block; with a usual set of
queries there is one. Statistics (N, L, and each asked term's df) are counted over all documents first. All
scores are 64-bit integers, so the result doesn't depend on the order of rows.

Null texts have no terms: such documents don't count and such items get no rows. Items without
terms, or whose terms no document has, get none either. Rows that repeat an item are ranked each on their own, as are rows
that repeat a document. Equal scores stand by ascending id, a null id last, and equal ids by nothing else: they are alike in what is
returned. Texts are counted whole, in steps of ``STEP`` bytes cut at separators. Other columns are never read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, shared_dir, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP, POSTINGS, STEP, RUN = 20, 4_000_000, 1 << 20, 64
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_LAST = np.iinfo(np.int64).max


def terms(text: Column) -> Column:
    """The terms of a text, with repeats; null has none."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(f"({TERM})"), 1)


def term_counts(raw: bytes) -> Counter:
    """How often each term (as lower-case bytes) stands in a text."""
    if len(raw) <= STEP:
        return Counter(_TERM.findall(raw.lower()))
    out, at = Counter(), 0
    while at < len(raw):
        gap = _GAP.search(raw, min(at + STEP, len(raw)))
        end = gap.end() if gap else len(raw)
        out.update(_TERM.findall(raw[at:end].lower()))
        at = end
    return out


def postings(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(q, item_id, term, times): the index's entries; q numbers the rows of ``items``."""
    rows = items.select(F.monotonically_increasing_id().alias("q"), F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    return rows.select("q", "item_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("q", "item_id", "term").agg(F.count("*").alias("times"))


class Index:
    """One block of the inverted index, as plain arrays: for term t the entries ``first[t]`` to ``first[t + 1]``."""

    def __init__(self, rows):
        """``rows``: pandas rows of (q, term, times)."""
        self.queries, item = np.unique(rows["q"].to_numpy(np.int64), return_inverse=True)
        words = sorted(set(rows["term"]))
        self.terms = {w.encode(): i for i, w in enumerate(words)}
        term = np.array([self.terms[w.encode()] for w in rows["term"]], np.int64)
        order = np.argsort(term, kind="stable")
        self.item, self.times = item[order], rows["times"].to_numpy(np.int64)[order]
        self.first = np.searchsorted(term[order], np.arange(len(words) + 1))

    def weigh(self, n_docs: int, df: np.ndarray) -> np.ndarray:
        """Every term's weight."""
        return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)

    def scores(self, ids: np.ndarray, tf: np.ndarray, weight: np.ndarray, m: int) -> np.ndarray:
        """A document's score for every item, from its terms that the index has."""
        part = weight[ids] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
        size = self.first[ids + 1] - self.first[ids]
        at = np.repeat(self.first[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        out = np.zeros(len(self.queries), np.int64)
        np.add.at(out, self.item[at], np.repeat(part, size) * self.times[at])
        return out


def _known(index: Index, counts: Counter):
    """(term numbers, counts) of a document's terms that the index has."""
    known = index.terms
    pairs = [(known[w], c) for w, c in counts.items() if w in known]
    return np.array(pairs, np.int64).reshape(-1, 2).T


def _texts(batches):
    """(ids, text as bytes) of the rows of batches with a text that isn't null."""
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
        for i in range(len(texts)):
            if (raw := texts[i].as_py()) is not None:
                yield ids[i].as_py(), raw


def _statistics(spark, docs: DataFrame, index) -> tuple[int, int, np.ndarray]:
    """(N, L, df by term number) over all documents: each task's sums, then their sums."""

    def count(batches):
        own = index.value
        n_docs, total, df = 0, 0, np.zeros(len(own.terms), np.int64)
        for _, raw in _texts(batches):
            counts = term_counts(raw)
            if counts:
                n_docs, total = n_docs + 1, total + sum(counts.values())
                df[_known(own, counts)[0]] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at])), pa.array(np.concatenate([[n_docs, total], df[at]]))], names=["term", "n"])

    sums = docs.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(index.value.terms), np.int64)
    found = dict(zip(sums["term"], sums["n"]))
    for t, n in found.items():
        if t >= 0:
            df[t] = n
    return int(found.get(-2, 0)), int(found.get(-1, 0)), df


def heaps(docs: DataFrame, index, weight: np.ndarray, n_docs: int, total: int, top: int) -> DataFrame:
    """(q, score, doc_id, at): every task's best ``top`` documents of each query; at is the task."""

    def stream(batches):
        own = index.value
        best: list[list] = [[] for _ in own.queries]
        least = np.zeros(len(own.queries), np.int64)  # below this score nothing enters an item's heap
        for doc_id, raw in _texts(batches):
            counts = term_counts(raw)
            ids, tf = _known(own, counts)
            if not len(ids):
                continue
            m = 100 - 25 + (25 * sum(counts.values()) * n_docs) // total
            scores = own.scores(ids, tf, weight, m)
            key = _LAST if doc_id is None else doc_id
            for i in np.flatnonzero((scores > 0) & (scores >= least)):
                entry, heap = (int(scores[i]), -key, doc_id is None), best[i]
                if len(heap) < top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
                if len(heap) == top:
                    least[i] = heap[0][0]
        rows = [(int(q), s, None if none else -d) for q, heap in zip(own.queries, best) for s, d, none in heap]
        q, s, d = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(s, pa.int64()), pa.array(d, pa.int64())], names=["q", "score", "doc_id"])

    return docs.mapInArrow(stream, "q long, score long, doc_id long").withColumn("at", F.spark_partition_id())


def _best(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", entries: int = POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): the best ``top`` documents of each item with a score above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    asked = shared_dir(postings(items))
    blocks = max(1, -(-asked.count() // entries))
    found = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).select("q", "term", "times")
        index = spark.sparkContext.broadcast(Index(mine.toPandas()))
        n_docs, total, df = _statistics(spark, rows, index)
        best = heaps(rows, index, index.value.weigh(n_docs, df), n_docs, total, top)
        found = best if found is None else found.unionByName(best)
    by_run = _best(found.withColumn("run", F.floor(F.col("at") / RUN)), ["q", "run"], top).drop("rank", "run", "at")
    names = asked.select("q", "item_id").distinct()
    return _best(by_run, ["q"], top).join(names, "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS.format("text")} AS ts FROM documents),
n AS (SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM d WHERE len(ts) > 0),
i AS (SELECT row_number() OVER () AS q, item_id, {_TERMS.format("text")} AS ts FROM benchmark),
p AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(ts) AS term FROM i) GROUP BY q, term),
t AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM p) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), n),
m AS (SELECT rid, doc_id, 100 - 25 + (25 * CAST(len(ts) AS BIGINT) * docs) // total AS m FROM d, n WHERE len(ts) > 0),
s AS (SELECT q, rid, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM t JOIN w USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY q, rid, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, rid) AS INTEGER) AS "rank" FROM s WHERE score > 0)
SELECT item_id, "rank", doc_id, score FROM r JOIN i USING (q) WHERE "rank" <= 20
"""

QUERIES = {"op13_ranked_search": op13_ranked_search}
ORACLES = {"op13_ranked_search": SQL}
