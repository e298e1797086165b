"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions.lineage import checkpoint_folder, checkpointed

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of the word rule ``[^\x20\x09-\x0D]+``, without the blank itself.
WHITE = "\t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, UPPER.lower())


def blank_words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    flat = F.translate(F.coalesce(text, F.lit("")), WHITE, " " * len(WHITE))
    return F.array_remove(F.split(flat, " "), "")


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast what is proven small, for narrow rows; else leave it to a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def hashed_sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """The rows whose key's hash is below most / rows: ``most`` of them in expectation, all where there are no more.

    Unlike an ordered limit, no task sends its own ``most`` rows to the driver. Reruns agree.
    """
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < F.lit(int((1 << 30) * most / n)))


def shared_dir(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the folder that all executors share."""
    return checkpointed(df)


def written(df: DataFrame, name: str):
    """(path, table): ``df`` as Parquet in the shared folder, read again, so a lost executor costs no recomputation."""
    path = f"{checkpoint_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table of ``written`` that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def lent(sc, value):
    """A broadcast for actions that end inside the block. After it no copy is left: the driver and each executor write one to disk."""
    shared = sc.broadcast(value)
    try:
        yield shared
    finally:
        shared.destroy(blocking=True)


_BYTE = np.arange(256, dtype=np.uint8)
_LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
_SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
#: Random values by position in a word and byte, for hashing by tabulation.
_TABLE = np.random.default_rng(7).integers(0, 1 << 64, 64 * 256, dtype=np.uint64)


def utf8(texts: pa.Array):
    """The bytes of all texts of a batch and the row offsets; null texts are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, wide)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]: off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def arrow_words(texts: pa.Array, lower: bool = True):
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch: (bytes, starts, ends, row offsets).

    The words of row i are ``starts[k]:ends[k]`` of the bytes, for k from
    ``rows[i]`` to ``rows[i + 1]``; with ``lower`` the bytes A-Z are lower-cased.
    """
    raw, off = utf8(texts)
    if lower:
        raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before, after = np.ones(len(raw), bool), np.ones(len(raw), bool)
    before[1:] = ~inside[:-1]
    after[:-1] = ~inside[1:]
    starts = np.flatnonzero(inside & (before | edge[:-1]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    return raw, starts, ends, np.searchsorted(starts, off)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit tabulation hashes of words given as byte ranges in ascending order."""
    out = np.empty(len(starts), np.uint64)
    total = np.concatenate([[0], np.cumsum(ends - starts)])
    lo = 0
    while lo < len(starts):  # in blocks that stay in the processor's cache
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + (1 << 17), "right")) - 1)
        first, size = total[lo:hi] - total[lo], ends[lo:hi] - starts[lo:hi]
        at = np.arange(int(size.sum())) - np.repeat(first, size)
        value = _TABLE[(at & 63) * 256 + raw[np.repeat(starts[lo:hi], size) + at]]
        if size.max() > 64:
            value *= (2 * (at >> 6) + 1).astype(np.uint64)
        out[lo:hi] = np.add.reduceat(value, first) + size.astype(np.uint64)
        lo = hi
    return mix64(out)


def distinct(keys: np.ndarray):
    """(codes, distinct keys in order of first appearance, where each first appears)."""
    import pandas as pd

    codes, values = pd.factorize(keys)
    first = np.empty(len(values), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, values, first


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit sums so that all bits depend on all inputs."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def row_slices(batch: pa.RecordBatch, text: str = "text", most_bytes: int = 8 << 20):
    """Cut a batch into runs of rows with about ``most_bytes`` of text each."""
    column = batch.column(batch.schema.get_field_index(text))
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = np.cumsum(size) // most_bytes
    edges = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), len(size)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def sum_vectors(rows: DataFrame, levels: int = 3, width: int = 128, kind=np.float64) -> DataFrame:
    """(part, v): the sums by part of vectors of one ``kind`` (part string, v binary) that tasks give.

    A tree by task number: ``width`` vectors at most are added in one place, so ``levels``
    of 3 serve two million tasks.
    """

    def add(group: pa.Table) -> pa.Table:
        total = 0
        for v in group.column("v"):
            total = total + np.frombuffer(v.as_py(), kind).astype(np.float64)
        return pa.table({"part": group.column("part")[:1], "at": group.column("at")[:1], "v": pa.array([total.astype(kind).tobytes()], pa.binary())})

    rows = rows.withColumn("at", F.spark_partition_id().cast("long"))
    for _ in range(levels):
        rows = rows.withColumn("at", F.floor(F.col("at") / width)).groupBy("part", "at").applyInArrow(add, "part string, at long, v binary")
    return rows.select("part", "v")
