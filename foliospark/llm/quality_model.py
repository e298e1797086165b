"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration.

Statistics of the text alone (word lengths, repeats, character classes, line
repeats) are standardised and mapped to ``FEATURES`` random cosines, whose
inner products approximate a Gaussian kernel. Tasks add up z'z and z'y of their
rows; the sums, of a size fixed by ``FEATURES``, are added up in Spark, and
only their total is solved in one place. Scores of rows of another fold are
binned (``BINS`` sums) and made monotone by pooling adjacent violators.

Labels are learned from the training folds only; ids, languages, sources and labels
are never inputs of a score. A null text is empty; empty texts get a score
like any other. Rows without a label are scored but not learned from; repeated
rows are learned and scored one by one. Without any label of either class all
scores are the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_words, bucket_of, hash_words, mix64, row_slices, shared_dir, sum_vectors, table, utf8

FEATURES, WIDTH, RIDGE, BINS = 384, 0.25, 3.0, 2000
FOLDS, HELD_OUT, CALIBRATE = 4, 2, 3
_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>", b"!", b"|", b".,;:?", b"\n", b"()[]{}\"'=_-/\\+@~^`"]
NAMES = (
    "log_words", "word_len", "word_len_dev", "distinct_words", "repeat_windows", "dup_lines", "words_per_line", "log_lines",
    *(f"class_{i}" for i in range(len(_CLASSES))), "beyond_ascii", "long_words", "top_word", "empty",
)


def _per_row(values, rows):
    """Sums of ``values`` between row offsets."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[rows[1:]] - total[rows[:-1]]


def _repeats(keys, row, n_rows):
    """Per row: distinct keys, keys that occur twice or more (occurrences), and the most frequent key's occurrences."""
    if not len(keys):
        return np.zeros((3, n_rows))
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    at = np.flatnonzero(new)
    size, owner = np.diff(np.append(at, len(k))), r[at]
    most = np.zeros(n_rows)
    np.maximum.at(most, owner, size)
    return np.stack([np.bincount(owner, minlength=n_rows), np.bincount(owner, size * (size > 1), n_rows), most])


def statistics(texts: pa.Array) -> np.ndarray:
    """(rows, statistics) of a batch of texts."""
    raw, off = utf8(texts)
    low, starts, ends, rows = arrow_words(texts)
    n = len(off) - 1
    size = (ends - starts).astype(np.float64)
    words = np.diff(rows)
    some = np.maximum(words, 1)
    row = np.repeat(np.arange(n), words)
    h = hash_words(low, starts, ends)
    distinct, _, most = _repeats(h, row, n)
    same = len(h) > 2
    tri = mix64(h[:-2] * np.uint64(3) + mix64(h[1:-1] * np.uint64(5) + mix64(h[2:]))) if same else h[:0]
    inside = row[:-2] == row[2:] if same else np.empty(0, bool)
    _, again, _ = _repeats(tri[inside], row[:-2][inside] if same else row[:0], n)
    feeds = np.flatnonzero(raw == 10)
    edges = np.unique(np.concatenate([off, feeds, feeds + 1]))
    a, b = edges[:-1], edges[1:]
    line = (b - a > 1) | (raw[a] != 10) if len(a) else np.empty(0, bool)
    a, b = a[line], b[line]
    line_row = np.searchsorted(off, a, "right") - 1
    n_lines = np.bincount(line_row, minlength=n).astype(float) if len(a) else np.zeros(n)
    lines = _repeats(hash_words(raw, a, b), line_row, n)[0]
    chars = np.maximum(_per_row((raw & 0xC0) != 0x80, off), 1)
    mean = _per_row(size, rows) / some
    cols = [
        np.log1p(words), mean, np.sqrt(np.maximum(_per_row(size * size, rows) / some - mean**2, 0)), distinct / some, again / some,
        1 - lines / np.maximum(n_lines, 1), np.log1p(words / np.maximum(n_lines, 1)), np.log1p(n_lines),
    ]
    for chosen in _CLASSES:
        flag = np.zeros(256, bool)
        flag[list(chosen)] = True
        cols.append(np.sqrt(_per_row(flag[raw], off) / chars))
    cols += [_per_row(raw >= 0xC0, off) / chars, _per_row(size > 16, rows) / some, most / some, words == 0]
    return np.stack([np.asarray(c, np.float64) for c in cols], axis=1)


def _stat_rows(batches):
    for batch in batches:
        for part in row_slices(batch, "text", 4 << 20):
            x = statistics(part.column("text"))
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("fold"), flat], names=["doc_id", "fold", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, len(NAMES)))


class Cosines:
    """Random Fourier features of standardised statistics."""

    def __init__(self, mean, dev):
        draw = np.random.default_rng(11)
        self.mean, self.dev = np.asarray(mean), np.asarray(dev)
        self.w = draw.normal(0, WIDTH, (len(NAMES), FEATURES - 1))
        self.b = draw.uniform(0, 2 * np.pi, FEATURES - 1)

    def __call__(self, x):
        x = np.clip((x - self.mean) / self.dev, -8, 8)
        z = np.cos(x @ self.w + self.b) * np.sqrt(2 / FEATURES)
        return np.hstack([z, np.ones((len(z), 1))])


def _equations(features):
    """Per task: rows (part, v) of the normal equations, z'z with z'y as the last column."""

    def run(batches):
        total = np.zeros((FEATURES, FEATURES + 1))
        for batch in batches:
            z = features(_matrix(batch.column("x")))
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            total += z.T @ np.hstack([z, y[:, None]])
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(map(str, range(FEATURES))), pa.array([r.tobytes() for r in total])], names=["part", "v"])

    return run


def pool(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Isotonic means of y with weights n, in the order given, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(y, n):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v1, w1, c1 = blocks.pop()
            v0, w0, c0 = blocks.pop()
            blocks.append([(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, c0 + c1])
    return np.concatenate([np.full(int(c), v) for v, _, c in blocks]) if blocks else np.empty(0)


def fit(stats: DataFrame, labels: DataFrame):
    """(features, weights, knots, values) from labelled statistics (doc_id, fold, x) and (doc_id, label)."""
    known = shared_dir(stats.join(labels.where("label is not null"), "doc_id").select("fold", "x", F.col("label").cast("int").alias("label")))
    learn = known.where(f"fold <> {HELD_OUT}")
    k = len(NAMES)
    sums = learn.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("d")).orderBy("j").collect()
    if len(sums) < k:
        return None
    features = Cosines([r["m"] for r in sums], [max(r["d"], 1e-6) for r in sums])
    train = learn.where(f"fold <> {CALIBRATE}")
    rows = sum_vectors(train.mapInArrow(_equations(features), "part string, v binary")).collect()
    if not rows:
        return None
    total = np.zeros((FEATURES, FEATURES + 1))
    for r in rows:
        total[int(r["part"])] = np.frombuffer(r["v"])
    ridge = RIDGE * np.eye(FEATURES)
    ridge[-1, -1] = 1e-6
    weights = np.linalg.solve(total[:, :-1] + ridge, total[:, -1])

    def binned(batches):
        for batch in batches:
            s = features(_matrix(batch.column("x"))) @ weights
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(s, -1, 2) * BINS).astype(np.int64)), batch.column("label")], names=["bin", "label"])

    bins = learn.where(f"fold = {CALIBRATE}").mapInArrow(binned, "bin long, label int").groupBy("bin").agg(F.sum("label").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    if not bins:
        return features, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0])
    x = np.array([(r["bin"] + 0.5) / BINS for r in bins])
    n = np.array([float(r["n"]) for r in bins])
    return features, weights, x, pool(x, np.array([r["y"] for r in bins]) / n, n)


def score_quality(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="quality") -> DataFrame:
    """(doc_id, held_out, score) of every row of ``docs``."""
    own = docs.select(F.col(doc_id).alias("doc_id"), bucket_of(F.col(doc_id), FOLDS).cast("int").alias("fold"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    stats = shared_dir(own.mapInArrow(_stat_rows, f"doc_id {kind}, fold int, x array<double>"))
    model = fit(stats, labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")))

    def scores(batches):
        for batch in batches:
            if model is None:
                out = np.full(batch.num_rows, 0.5)
            else:
                features, weights, knots, values = model
                s = features(_matrix(batch.column("x"))) @ weights
                # the last thousandth keeps the order of rows inside a pooled block
                out = 0.999 * np.interp(s, knots, values) + 0.001 / (1 + np.exp(-np.clip(s, -20, 20)))
            held = pa.array(batch.column("fold").to_numpy() == HELD_OUT)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), held, pa.array(out)], names=["doc_id", "held_out", "score"])

    return stats.mapInArrow(scores, f"doc_id {kind}, held_out boolean, score double")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels of the training folds."""
    rows = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLES: dict = {}
