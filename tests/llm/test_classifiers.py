"""Classifiers against plain references: full enumeration of lattices, the closed form of ridge, quadratic-time isotonic regression."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("foliospark.llm")
from foliospark.llm import quality_model, toxicity  # noqa: E402


def _cost(letters, extra, model):
    key, total = (26, 26, 26), extra
    for d in [*(x for c in letters for x in toxicity._signs(c)), 26]:
        total += model.after(*key, d)
        key = (*key[1:], d)
    return total


def test_viterbi_finds_the_cheapest_of_all_readings():
    rng, draw = random.Random(3), np.random.default_rng(3)
    model = toxicity.CharModel(draw.integers(0, 50, toxicity.N_SIGNS**4) * (draw.random(toxicity.N_SIGNS**4) < 0.2))
    for _ in range(300):
        word = "".join(rng.choice("aab1|6@$0o.-é€xx") for _ in range(rng.randint(1, 7)))
        every = [("".join(x for x, _ in path), sum(c for _, c in path)) for path in itertools.product(*toxicity.lattice(word))]
        least = min(_cost(letters, extra, model) for letters, extra in every)
        own = toxicity.decode(word, model)
        assert abs(min(_cost(letters, extra, model) for letters, extra in every if letters == own) - least) < 1e-4


def test_character_model_is_a_distribution():
    model = toxicity.CharModel(np.random.default_rng(4).integers(0, 3, toxicity.N_SIGNS**4))
    p = 10.0 ** -model.cost.reshape(-1, toxicity.N_SIGNS)
    assert np.allclose(p.sum(1), 1, atol=1e-4)


def test_all_telling_features_get_a_weight(spark, monkeypatch):
    """All of some five thousand features count: each toxic text has a word that few others have."""
    monkeypatch.setattr(toxicity, "MOST_LABELLED", 1 << 20)
    word = F.expr("translate(substr(md5(cast(id % 1300 as string)), 1, 7), '0123456789', 'ghijklmnop')")
    rows = spark.range(70_000).withColumn("toxic", (F.col("id") < 10_400).cast("int"))
    rows = rows.select(F.col("id").alias("doc_id"), F.when(F.col("toxic") == 1, F.concat(F.lit("plain text "), word)).otherwise("plain text of words").alias("text"), "toxic")
    got = toxicity.score_toxicity(rows.select("doc_id", "text"), rows.select("doc_id", "toxic")).toPandas()
    assert (got[got.doc_id < 10_400].score > 0.5).mean() > 0.85 and (got[got.doc_id >= 10_400].score < 0.5).all()


def test_summed_equations_are_the_closed_form_of_ridge():
    draw = np.random.default_rng(5)
    x, y = draw.normal(2, 3, (500, len(quality_model.NAMES))), draw.integers(0, 2, 500)
    features = quality_model.Cosines(x.mean(0), x.std(0))
    batches = [pa.RecordBatch.from_arrays([pa.array(list(x[a:b])), pa.array(y[a:b])], names=["x", "label"]) for a, b in ((0, 7), (7, 300), (300, 500))]
    total = np.zeros((quality_model.FEATURES, quality_model.FEATURES + 1))
    for part in quality_model._equations(features)(batches):
        for k, v in zip(part.column("part").to_pylist(), part.column("v").to_pylist()):
            total[int(k)] += np.frombuffer(v)
    z = features(x)
    assert np.allclose(total[:, :-1], z.T @ z) and np.allclose(total[:, -1], z.T @ y)
    # inner products of features are near the Gaussian kernel of the standardised statistics
    s = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    kernel = np.exp(-0.5 * quality_model.WIDTH**2 * ((s[:40, None] - s[None, :40]) ** 2).sum(-1))
    assert np.abs(z[:40, :-1] @ z[:40, :-1].T - kernel).mean() < 0.06


def test_pooling_is_the_best_of_all_monotone_fits():
    draw = np.random.default_rng(6)
    for n in (1, 2, 9, 40):
        y, w = draw.integers(0, 4, n) / 3, draw.integers(1, 5, n).astype(float)
        mean = lambda a, b: (y[a: b + 1] * w[a: b + 1]).sum() / w[a: b + 1].sum()  # noqa: E731, B023
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(quality_model.pool(np.arange(n), y, w), want)


@pytest.mark.parametrize("score, label", [(quality_model.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_clashing_names_ties_and_long_texts(spark, odd_docs, score, label):
    docs = odd_docs.where("doc_id is not null")
    for c in ("score", "held_out", "fold", "label", "x", "z", "f", label):
        docs = docs.withColumn(c, F.lit("own"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (1, 1), (5, 0), (6, 1), (8, 1), (None, 1), (7, None)], f"doc_id long, {label} int")
    rows = score(docs, labels.withColumn("text", F.lit("own"))).collect()
    assert len(rows) == 9 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id == 1}) == 1
    assert [r.score for r in sorted(rows, key=str)] == [r.score for r in sorted(score(docs, labels).collect(), key=str)]


def test_long_runs_of_single_letters_take_memory_by_their_length():
    import tracemalloc

    import pyarrow as pa

    model = toxicity.CharModel(np.random.default_rng(4).integers(0, 3, toxicity.N_SIGNS**4))
    letters = "".join(chr(97 + x % 26) for x in np.cumsum(np.random.default_rng(5).integers(1, 26, 40_000)))  # none twice in a row, which would look disguised
    tracemalloc.start()
    pairs, names = toxicity._features(pa.array([" ".join(letters)]), model, longest=12)
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()
    assert {f"{letters[7:11]}~", f"{letters[100:106]}~", letters[-12:], letters[-3:]} <= set(names) and letters[-13:] not in names and max(map(len, names)) == 12
    known = {f"{letters[20:25]}~": 0, letters[-9:]: 1, letters[-11:-1]: 2}
    assert toxicity._features(pa.array([" ".join(letters)]), model, known)[0][:, 1].tolist() == [0, 1]


def plain_features(text, model, longest):
    """The features of one text by its words, one by one."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    out = set()
    for w in words:
        out |= set(toxicity._names(toxicity.restore(w, model)))
    runs = []
    short = [toxicity._short(w) for w in words]
    for test, least in ((lambda k: len(words[k].encode()) == 1, 0), (lambda k: short[k] is not None, 2)):
        k = 0
        while k < len(words):
            end = k
            while end < len(words) and test(end):
                end += 1
            if end - k > 2 and (not least or sum(len(short[i]) == 1 for i in range(k, end)) >= least):
                runs.append("".join(words[i] if not least else short[i] for i in range(k, end)))
            k = end + 1
    for run in runs:
        word = toxicity.restore(run, model) if toxicity._ODD.search(run) else run
        for a in range(len(word)):
            end = word[a:]
            if len(end) >= 3:
                out |= {f"{end[:n]}~" for n in toxicity.PREFIXES if len(end) >= n} | ({end} if len(end) <= max(longest, max(toxicity.PREFIXES)) else set())
    return out


def test_features_equal_plain_ones():
    import random

    import pyarrow as pa

    rng = random.Random(17)
    model = toxicity.CharModel(np.random.default_rng(6).integers(0, 3, toxicity.N_SIGNS**4))
    pieces = ["a", "b", "c", "d", "é", "1", "$", "ab", "b.", "word", "w0rd", "h.e.l.l.o", "UPPER", "looong", "x", "(c)", "!"]
    texts = [rng.choice([" ", "  ", "\n"]).join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(300)] + [None, "", " a b c d e f g h i j k l m n o p q r s t "]
    pairs, names = toxicity._features(pa.array(texts), model, longest=8)
    by = {number: f for f, number in names.items()}
    got = [set() for _ in texts]
    for row, number in pairs.tolist():
        got[row].add(by[number])
    for text, mine in zip(texts, got):
        assert mine == plain_features(text, model, 8), text
