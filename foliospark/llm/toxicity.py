"""Toxicity: noisy-channel deobfuscation, then a lexical score of the restored text.

A character language model (counts of four letters in a row, over all
documents) is gathered first. Disguised words - leetspeak, letters with
separators or blanks between them, letters repeated - span a lattice: each sign may stand
for some letters, or for none, at a cost. Viterbi decoding finds the cheapest
letters under channel and language model together. Features are restored words
and their beginnings; those that tell the labels apart get weights by logistic
regression.

The classifier is fitted on a bounded sample: ``MOST_LABELLED`` labelled rows of the
training folds in expectation, chosen by a hash of their id (all of them where there are
fewer). Nothing else is bounded by rows: the language model covers every document,
and every whole text is scored. Every feature of the sample that ``LEAST_DOCS`` toxic texts have, more often than
chance by ``LEAST_Z`` deviations, gets a weight, so their number is bounded by the sample alone.
Ids, labels, languages and sources are not inputs.

Null texts are empty; a text without any known feature gets the score of the
intercept. Rows without a label are scored only; repeated rows are scored one by one; a document labelled both ways
is learned both ways, and labels that repeat count once. Where several decodings cost the same, the first in the
order of letters is taken. Other columns are not looked at, whatever their names.
Without labels of both classes all scores are the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_words, ascii_lower, blank_words, bucket_of, distinct, hash_words, hashed_sample, row_slices, shared_dir, small, table, utf8

MOST_LABELLED = 20_000
LEAST_DOCS, LEAST_Z = 4, 4.5
FOLDS, HELD_OUT = 3, 1
PREFIXES = (4, 5, 6)

# What a sign may stand for in a disguised word.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "#": "h", "%": "",
}
SEPARATORS = set(".-_*~'`^:,/\\|&%#\"")
_PUNCT = "!\"#$%&'()*+,-./:;<=>?[\\]^_`{|}~"
_ODD = re.compile(r"[0-9@$!|+(€£]|[^\W\d_][.\-_*~'`^:,/\\&%#]+[^\W\d_]|([^\W\d_])\1\1|^(?:([a-z])\2){3,}$")
_LETTER = re.compile(r"[^\W\d_]")
N_SIGNS = 28  # a-z, the edge of a word, any other character
_EDGE, _OTHER = 26, 27


# --- the character language model -------------------------------------------------


def _letter_counts(batches):
    """Per task: counts of all runs of four signs of its texts, as rows (run, n)."""
    kind = np.full(256, _OTHER, np.int64)
    for i in range(26):
        kind[97 + i] = kind[65 + i] = i
    kind[[9, 10, 11, 12, 13, 32]] = _EDGE
    kind[[ord(c) for c in _PUNCT]] = _EDGE
    total = np.zeros(N_SIGNS**4, np.int64)
    for batch in batches:
        for part in row_slices(batch, "text", 4 << 20):
            raw, off = utf8(part.column("text"))
            s = np.insert(kind[raw], np.unique(off), _EDGE)  # texts don't run into each other
            if len(s) > 3:
                run = ((s[:-3] * N_SIGNS + s[1:-2]) * N_SIGNS + s[2:-1]) * N_SIGNS + s[3:]
                total += np.bincount(run, minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["run", "n"])


class CharModel:
    """-log10 of a sign after three others, with shorter contexts mixed in."""

    def __init__(self, counts: np.ndarray):
        c4 = counts.astype(np.float64).reshape((N_SIGNS,) * 4)
        c3, c2, c1 = c4.sum(0), c4.sum((0, 1)), c4.sum((0, 1, 2))
        p1 = (c1 + 1) / (c1.sum() + N_SIGNS)
        p2 = (c2 + 5 * p1) / (c2.sum(-1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2) / (c3.sum(-1, keepdims=True) + 5)
        p4 = (c4 + 5 * p3) / (c4.sum(-1, keepdims=True) + 5)
        self.cost = (-np.log10(p4)).astype(np.float32).ravel()

    def after(self, a: int, b: int, c: int, d: int) -> float:
        return float(self.cost[((a * N_SIGNS + b) * N_SIGNS + c) * N_SIGNS + d])


# --- decoding ----------------------------------------------------------------------

_SWAP, _DROP, _KEEP, _LOST = 0.4, 0.3, 0.0, 2.0


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """Per sign of a word, what it may stand for with the cost: letters, or the empty string."""
    out, last, run = [], "", 0
    for ch in word:
        run = run + 1 if ch == last else 1
        last = ch
        here = []
        if _LETTER.match(ch):  # letters beyond a-z stand for themselves, as other characters of the model
            here.append((ch, _KEEP if run < 3 else _LOST))
            if run > 1:
                here.append(("", _DROP))
        else:
            here += [(x, _SWAP) for x in LEET.get(ch, "")]
            if ch in SEPARATORS or not here:
                here.append(("", _DROP if ch in SEPARATORS else _LOST))
            elif run > 1:
                here.append(("", _DROP))
        out.append(here)
    return out


def _signs(letter: str) -> list[int]:
    """The signs of the model for a letter: one for a-z, one for each byte of any other, none for no letter."""
    return [ord(letter) - 97] if "a" <= letter <= "z" else [_OTHER] * len(letter.encode("utf-8"))


def decode(word: str, model: CharModel) -> str:
    """The cheapest letters for a word by Viterbi decoding; a state is the last three letters."""
    best: dict = {(_EDGE, _EDGE, _EDGE): (0.0, None)}  # cost and (letters before, letter)
    for choices in lattice(word):
        step: dict = {}
        for (a, b, c), (cost, before) in best.items():
            for letter, extra in choices:
                key, total = (a, b, c), cost + extra
                for d in _signs(letter):
                    total += model.after(*key, d)
                    key = (*key[1:], d)
                if key not in step or total < step[key][0]:
                    step[key] = (total, (before, letter) if letter else before)
        best = step
    ends = [(cost + model.after(a, b, c, _EDGE), before) for (a, b, c), (cost, before) in best.items()]
    least = min(cost for cost, _ in ends)
    texts = []
    for _, at in (x for x in ends if x[0] == least):
        letters = []
        while at:
            at, letter = at
            letters.append(letter)
        texts.append("".join(reversed(letters)))
    return min(texts)


def restore(word: str, model: CharModel) -> str:
    """A lower-case word without the punctuation around it, decoded if it looks disguised."""
    core = word.strip(_PUNCT)
    odd = word.rstrip(_PUNCT.replace("$", "").replace("@", "").replace("!", "").replace("|", "")) if re.match(r"[@$!][a-z0-9]", word) else core
    if len(odd) > 2 and _ODD.search(odd) and _LETTER.search(odd):
        return decode(odd, model)
    return core


def _spaced(raw, starts, ends, rows):
    """(row, letters) of runs of three or more words of one ASCII letter or digit each."""
    one = (ends - starts == 1) & (raw[starts] < 128) if len(starts) else np.empty(0, bool)
    edge = np.zeros(len(starts) + 1, bool)
    edge[rows] = True
    out, k = [], np.flatnonzero(one)
    if not len(k):
        return out
    new = np.ones(len(k), bool)
    new[1:] = (np.diff(k) > 1) | edge[k[1:]]
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(k)))
    for f, n in zip(first[size > 2], size[size > 2]):
        at = k[f: f + n]
        out.append((int(np.searchsorted(rows, at[0], "right") - 1), bytes(raw[starts[at]]).decode("ascii")))
    return out


def _short(word: str) -> str | None:
    """What a word of a spaced-out run adds to it: two signs at most without the punctuation around them; None for longer words."""
    core = word if len(word) == 1 else word.strip(_PUNCT)
    return core if len(core) <= 2 else None


def _uneven(code, shorts, rows):
    """(row, letters) of runs of three or more short words, of which two at least have one sign."""
    size = np.fromiter((-1 if x is None else len(x) for x in shorts), np.int64, len(shorts))[code] if len(code) else np.empty(0, np.int64)
    edge = np.zeros(len(code) + 1, bool)
    edge[rows] = True
    out, k = [], np.flatnonzero(size >= 0)
    if not len(k):
        return out
    new = np.ones(len(k), bool)
    new[1:] = (np.diff(k) > 1) | edge[k[1:]]
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(k)))
    singles = np.add.reduceat((size[k] == 1).astype(np.int64), first)
    pick = (n > 2) & (singles > 1)
    for f, m in zip(first[pick], n[pick]):
        at = k[f: f + m]
        out.append((int(np.searchsorted(rows, at[0], "right") - 1), "".join(shorts[code[i]] for i in at)))
    return out


def _names(core: str) -> list[str]:
    """Features of a restored word: itself, and how it begins."""
    return [] if len(core) < 3 else [core, *[f"{core[:n]}~" for n in PREFIXES if len(core) >= n]]


def _features(texts: pa.Array, model: CharModel, known=None, longest=None):
    """(rows, feature names or numbers), each pair once. ``known`` maps names to numbers, others are left out.

    A run of single letters may hold a word anywhere; its ends count as words up to ``longest`` letters (with ``known``, those of its longest name).
    """
    raw, starts, ends, rows = arrow_words(texts)
    code, _, once = distinct(hash_words(raw, starts, ends).view(np.int64))
    code_all, data = code, raw.tobytes()
    names: dict = {} if known is None else known
    longest = longest if known is None else max(map(len, known), default=0)
    lists, shorts = [], []
    for i in once:
        word = data[starts[i]: ends[i]].decode("utf-8")
        shorts.append(_short(word))
        fs = _names(restore(word, model))
        lists.append([names.setdefault(f, len(names)) for f in fs] if known is None else [known[f] for f in fs if f in known])
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((f for fs in lists for f in fs), np.int64, int(size.sum()))
    begin = np.cumsum(size) - size
    keep = size[code] > 0 if len(code) else np.empty(0, bool)
    code, row = code[keep], row[keep]
    n = size[code]
    at = np.repeat(begin[code], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    pairs = np.stack([np.repeat(row, n), flat[at] if len(flat) else np.empty(0, np.int64)], axis=1)
    more = set()
    for r, letters in sorted({*_spaced(raw, starts, ends, rows), *_uneven(code_all, shorts, rows)}):
        word = restore(letters, model) if _ODD.search(letters) else letters
        most = len(word) if longest is None else max(longest, max(PREFIXES))
        for a in range(len(word)):  # a run of letters may hold a word anywhere
            piece = word[a: a + most + 1]
            for f in _names(piece)[len(piece) > most:]:  # of a longer end only how it begins
                number = names.setdefault(f, len(names)) if known is None else known.get(f)
                if number is not None:
                    more.add((r, number))
    if more:
        pairs = np.concatenate([pairs, np.array(sorted(more), np.int64)])
    return np.unique(pairs, axis=0) if len(pairs) else pairs, names


# --- the classifier ------------------------------------------------------------------


def _logistic(x_rows, x_cols, y, n_features, penalty=0.05, rounds=1500):
    """Weights and intercept by Adam on the penalised log loss of presence features."""
    w, b = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, rounds + 1):
        s = np.bincount(x_rows, w[x_cols], len(y)) + b
        e = 1 / (1 + np.exp(-s)) - y
        g = np.append(np.bincount(x_cols, e[x_rows], n_features) + penalty * w, e.sum()) / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(docs: DataFrame, labels: DataFrame, model):
    """(feature numbers by name, weights, intercept) from docs (doc_id, fold, text) and labels (doc_id, label)."""
    fold = bucket_of(F.col("doc_id"), FOLDS)
    learn = labels.where(F.col("label").isNotNull() & (fold != HELD_OUT)).select("doc_id", F.col("label").cast("int").alias("label")).distinct()
    sample = shared_dir(hashed_sample(shared_dir(learn), F.col("doc_id"), MOST_LABELLED))
    texts = shared_dir(docs.join(small(sample), "doc_id").select("label", "text"))
    n1, n = texts.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    if not n or n1 in (0, n):
        return {}, np.zeros(0), (math.log(n1 / (n - n1)) if 0 < n1 < n else (0.0 if not n else 20.0 if n1 else -20.0))

    # no longer end of a run than the longest word that several texts share can be told from chance
    words = texts.select(F.explode(F.array_distinct(blank_words(ascii_lower(F.col("text"))))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    longest = words.where(F.col("n") >= LEAST_DOCS).agg(F.coalesce(F.max(F.length("w")), F.lit(0))).first()[0]

    def counts(batches):
        for batch in batches:
            for part in row_slices(batch, "text"):
                pairs, names = _features(part.column("text"), model.value, longest=longest)
                y = part.column("label").to_numpy(zero_copy_only=False)
                if len(pairs):
                    ones = np.bincount(pairs[:, 1], y[pairs[:, 0]], len(names)).astype(np.int64)
                    alls = np.bincount(pairs[:, 1], minlength=len(names))
                    yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string()), pa.array(ones), pa.array(alls)], names=["f", "n1", "n"])

    # documents with the feature against chance, as a signed deviation
    rate = n1 / n
    picked = (
        texts.mapInArrow(counts, "f string, n1 long, n long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n"))
        .where(F.col("n1") >= LEAST_DOCS)
        .withColumn("z", (F.col("n1") - rate * F.col("n")) / F.sqrt(F.col("n") * rate * (1 - rate)))
        .where(F.col("z") >= LEAST_Z)
    )
    known = {r["f"]: i for i, r in enumerate(sorted(picked.select("f").collect()))}

    def present(batches):
        for batch in batches:
            for part in row_slices(batch, "text"):
                pairs, _ = _features(part.column("text"), model.value, known)
                at = np.searchsorted(pairs[:, 0], np.arange(part.num_rows + 1)) if len(pairs) else np.zeros(part.num_rows + 1, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(pairs[:, 1] if len(pairs) else np.empty(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("label"), lists], names=["label", "fs"])

    rows = texts.mapInArrow(present, "label int, fs array<long>").groupBy("label", "fs").agg(F.count("*").alias("n")).collect()
    y = np.concatenate([np.full(r["n"], r["label"]) for r in rows]).astype(float)
    x_rows, x_cols, at = [], [], 0
    for r in rows:
        fs = np.array(r["fs"], np.int64)
        x_rows.append(np.repeat(np.arange(at, at + r["n"]), len(fs)))
        x_cols.append(np.tile(fs, r["n"]))
        at += r["n"]
    return known, *_logistic(np.concatenate(x_rows), np.concatenate(x_cols), y, len(known))


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id="doc_id", text="text", label="toxic") -> DataFrame:
    """(doc_id, held_out, score) of every row of ``docs``."""
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), bucket_of(F.col(doc_id), FOLDS).cast("int").alias("fold"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    runs = own.select("text").mapInArrow(_letter_counts, "run long, n long").groupBy("run").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(N_SIGNS**4, np.int64)  # bounded by the number of signs
    counts[runs["run"].to_numpy(np.int64)] = runs["n"].to_numpy(np.int64)
    model = spark.sparkContext.broadcast(CharModel(counts))
    known, weights, intercept = fit(own.select("doc_id", "fold", "text"), labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")), model)

    def scores(batches):
        for batch in batches:
            for part in row_slices(batch, "text"):
                pairs, _ = _features(part.column("text"), model.value, known)
                s = np.full(part.num_rows, float(intercept))
                if len(pairs):
                    s += np.bincount(pairs[:, 0], weights[pairs[:, 1]], part.num_rows)
                held = pa.array(part.column("fold").to_numpy() == HELD_OUT)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), held, pa.array(1 / (1 + np.exp(-np.clip(s, -30, 30))))], names=["doc_id", "held_out", "score"])

    return own.mapInArrow(scores, f"doc_id {kind}, held_out boolean, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learned from the labels of the training folds."""
    rows = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict = {}
