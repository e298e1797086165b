"""The language model against a plain forward pass, finite differences, counts in plain Python, and planted repeats."""

import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("foliospark.llm")
from foliospark.llm import lm, lm_net  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
SOME = "the of and red blue green dog cat runs over under hill river stone house tree light dark old new".split()


def sentence(rng, n):
    return " ".join(rng.choice(SOME) for _ in range(n))


def _net(seed=1, scale=0.3):
    """A network with random tables and arrays."""
    rng = np.random.default_rng(seed)
    classes = rng.integers(0, lm_net.CLASSES, lm_net.PIECES)
    follow, inside = lm_net.tables(classes, rng.integers(0, 9, lm_net.PIECES), rng.integers(0, 3, (lm_net.PIECES, lm_net.CLASSES)), rng.integers(0, 2, (lm_net.CLASSES, lm_net.PIECES)))
    net = lm_net.Net(classes, follow, inside, rng.normal(0, 1, (lm_net.PIECES, lm_net.WIDTH)))
    for n in lm_net.NAMES:
        setattr(net, n, (getattr(net, n) + rng.normal(0, scale, getattr(net, n).shape)).astype(np.float32))
    return net


def _plain(net, ids):
    """Natural log probability of each id of one text, id by id."""
    out = []
    for t in range(len(ids)):
        low = max(-1, t - t % lm_net.SPAN - lm_net.CONTEXT - 1)
        keys = [p for p in range(low, t) if p >= t - t % lm_net.SPAN - lm_net.CONTEXT - 1]
        x = [lm_net.BEGIN if p < 0 else int(ids[p]) for p in keys]
        e = net.emb[x].astype(float)
        q = e[-1] @ net.wq / math.sqrt(lm_net.WIDTH)
        a = np.array([q @ (e[i] @ net.wk) + net.place[t - 1 - p] for i, p in enumerate(keys)])
        a = np.exp(np.minimum(a, 60))
        h = (a / a.sum()) @ (e @ net.wv)
        z = np.exp(h @ net.out + net.bias + net.follow[x[-1]])
        c = net.classes[ids[t]]
        out.append(math.log(z[c] / z.sum()) + net.inside[net.classes[x[-1]], ids[t]])
    return np.array(out)


def test_scores_are_the_plain_forward_pass():
    net, rng = _net(), np.random.default_rng(2)
    texts = [rng.integers(3, lm_net.PIECES, n).astype(np.uint16) for n in (1, 2, 31, 32, 33, 100, 49)]
    got = net.log_scores(np.concatenate(texts), np.cumsum([len(t) for t in texts]))
    assert np.allclose(got, np.concatenate([_plain(net, t) for t in texts]), atol=2e-4)


def test_probabilities_of_all_next_ids_add_up_to_one():
    net, before = _net(3), np.array([5, 700, 31_999, 12], np.uint16)
    last = lm_net.PIECES
    ids = np.empty((last, 5), np.uint16)
    ids[:, :4], ids[:, 4] = before, np.arange(last)
    scores = net.log_scores(ids[::50].ravel(), 5 * np.arange(1, len(ids[::50]) + 1))[4::5]
    p, _ = net.forward(*net.take(np.append(before, 0).astype(np.uint16), np.array([0]), np.array([0]), np.array([5]))[:2])
    whole = p[4][net.classes] * np.exp(net.inside[net.classes[12]])
    assert np.allclose(np.exp(scores), whole[::50], rtol=1e-3) and abs(whole.sum() - 1) < 1e-3


def test_later_ids_and_other_texts_change_nothing():
    net, rng = _net(), np.random.default_rng(4)
    a, b = rng.integers(3, lm_net.PIECES, 150).astype(np.uint16), rng.integers(3, lm_net.PIECES, 70).astype(np.uint16)
    alone = net.log_scores(a, np.array([150]))
    for cut in (1, 40, 64, 100, 149):
        other = a.copy()
        other[cut:] = rng.integers(3, lm_net.PIECES, 150 - cut)
        both = net.log_scores(np.concatenate([b, other]), np.array([70, 220]))[70:]
        assert np.allclose(both[:cut], alone[:cut], atol=1e-5) and not np.allclose(both[cut], alone[cut], atol=1e-5)


def test_gradients_are_differences():
    net, rng = _net(), np.random.default_rng(6)
    net.__dict__.update({k: getattr(net, k).astype(np.float64) for k in (*lm_net.NAMES, "emb", "follow", "inside")})
    ids, ends = rng.integers(3, lm_net.PIECES, 90).astype(np.uint16), np.array([50, 90])
    x, inside, targets, _, valid = net.take(ids, *lm_net.windows(ends))
    value = lambda: float((np.log(net.forward(x, inside)[0][np.arange(targets.size), net.classes[targets.ravel()]]) * valid.ravel()).sum())
    grads = net.gradients(x, inside, targets, valid)
    emb = np.zeros_like(net.emb)
    np.add.at(emb, x.ravel(), grads.pop("emb").reshape(-1, lm_net.WIDTH))
    for name, g in {**grads, "emb": emb}.items():
        w = getattr(net, name)
        for _ in range(4):
            i = (int(rng.choice(x[inside])), int(rng.integers(lm_net.WIDTH))) if name == "emb" else tuple(int(rng.integers(0, n)) for n in w.shape)
            w[i] += 1e-5
            up = value()
            w[i] -= 2e-5
            down = value()
            w[i] += 1e-5
            assert abs((up - down) / 2e-5 - g[i]) < 1e-3 * max(1, abs(g[i])), name


def test_every_window_is_learned_once(monkeypatch):
    seen, step = [], lm_net.Learner.step
    monkeypatch.setattr(lm_net.Learner, "step", lambda self, ids, starts, lo, hi: (seen.append(len(starts)), step(self, ids, starts, lo, hi)))
    ids = np.tile(np.arange(3, 103, dtype=np.uint16), 400)
    before = _net(7, 0)
    value = before.log_scores(ids[:3200], np.array([3200])).sum()
    learner = lm_net.learn(before, ids, np.array([30_000, 40_000]))
    assert sum(seen) == -(-30_000 // lm_net.SPAN) - (-10_000 // lm_net.SPAN) and learner.t == len(seen)
    assert before.log_scores(ids[:3200], np.array([3200])).sum() > value


def test_pieces_of_work_leave_nothing_to_the_next(monkeypatch):
    """Windows computed in arrays that held others before give what new arrays give."""
    net, rng = _net(11), np.random.default_rng(12)
    room = lm_net.Room(4).load(net)
    for n in (128, 97, 128):
        ids = rng.integers(3, lm_net.PIECES, n).astype(np.uint16)
        x, inside, targets, _, valid = net.take(ids, *lm_net.windows(np.array([n])))
        one, other = net.gradients(x, inside, targets, valid, room), net.gradients(x, inside, targets, valid)
        assert len(x) == 4 and all(np.array_equal(one[k], other[k]) for k in other)
    texts = [rng.integers(3, lm_net.PIECES, n).astype(np.uint16) for n in (700, 3, 90)]
    ids, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    whole = net.log_scores(ids, ends)
    monkeypatch.setattr(lm_net, "PART", 3)
    assert np.allclose(net.log_scores(ids, ends), whole, atol=1e-5)


def test_kept_words_have_the_ids_of_the_model(monkeypatch):
    """Ids that were kept, also after others were let go, are those that the model gives; words without ids too."""
    rng, model = random.Random(13), lm._pieces_model()
    calls = []

    class Counting:
        def encode(self, words, num_threads):
            calls.extend(words)
            return [[] if w == "empty" else model.encode(w) for w in words]

    pieces = lm.Pieces(Counting())
    for most in (1 << 19, 12):
        monkeypatch.setattr(lm, "KEPT", most)
        calls.clear()
        for _ in range(5):
            texts = [*(sentence(rng, n) for n in (0, 3, 40)), "empty x" + str(rng.randrange(9)), None]
            ids, n = lm.Words(pa.array(texts)).encode(pieces)
            want = [i for t in texts for w in [*(t or "").split(), None] for i in ([lm_net.END] if w is None else [] if w == "empty" else model.encode(w))]
            assert ids.tolist() == want and n.sum() == len(want)
        assert len(calls) == len(set(calls)) or most == 12


def test_what_was_lent_or_written_for_a_step_is_removed(spark, monkeypatch):
    """Broadcasts have a copy on the disks of the driver and of each executor: none outlives the step that reads it."""
    from pyspark import SparkContext

    made, broadcast = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: made.append(broadcast(self, value)) or made[-1])
    written, dropped = [], []
    monkeypatch.setattr(lm, "written", lambda df, name, f=lm.written: written.append(f(df, name)) or written[-1])
    monkeypatch.setattr(lm, "drop_table", lambda spark, path, f=lm.drop_table: dropped.append(path) or f(spark, path))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = lm.score_texts(docs)
    assert len(made) == 2 + lm.ROUNDS and not any(os.path.exists(b._path) for b in made)
    kept = {path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path, _ in written if path not in dropped}
    assert kept == {"lm-counts", "lm-scored"} and rows.count() == docs.count()


def test_base_score_is_counts_in_plain_python(spark):
    path = "/root/testdata/sf0.01"
    got = lm.op4_lm_score(spark, path).toPandas().sort_values("doc_id")
    docs = pd.read_parquet(f"{path}/documents.parquet").sort_values("doc_id")
    words = [[*WORD.findall((t or "").translate(LOWER)), None] for t in docs.text]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in docs.doc_id]
    c = collections.Counter(w for ws, h in zip(words, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    base = [sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws) for ws in words]
    assert got.held_out.tolist() == held and got.n_tokens.tolist() == [len(w) for w in words]
    assert got.n_known.tolist() == [sum(c[w] > 0 for w in ws) for ws in words] and set(got.train_tokens) == {n}
    assert np.allclose(got.base_score, base, rtol=1e-9)
    assert got[got.held_out].score.sum() > got[got.held_out].base_score.sum()


def test_scores_dont_depend_on_splits_or_bounds(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scores = lambda df: lm.score_texts(df).toPandas().sort_values("doc_id")
    monkeypatch.setattr(lm, "SHARD", 40_000)  # several shards
    monkeypatch.setattr(lm, "STRETCH", 1000)
    one, other = scores(docs.coalesce(1)), scores(docs.repartition(7, F.rand(3)))
    monkeypatch.setattr(lm, "HEAD", 300)
    few = scores(docs)
    for c in ("n_known", "base_score", "score", "net_score"):
        assert np.allclose(one[c], other[c], rtol=1e-4) and np.allclose(one[c], few[c], rtol=1e-4)


def test_repeated_texts_are_told_apart(spark):
    rng = random.Random(8)
    once = [(i, sentence(rng, 120)) for i in range(200)]
    twice = [(1000 + 2 * i + k, t) for i in range(20) for t in [sentence(rng, 120)] for k in (0, 1)]
    rows = lm.score_texts(spark.createDataFrame(once + twice, "doc_id long, text string")).toPandas()
    train = rows[~rows.held_out]
    both = train[train.doc_id >= 1000].groupby(train.doc_id // 2).doc_id.transform("count") > 1
    lows = train[train.doc_id >= 1000][both].score
    assert len(lows) > 10 and lows.min() > train[train.doc_id < 1000].score.max()
    assert (train[train.doc_id < 1000].score - train[train.doc_id < 1000].net_score).abs().max() < 15


def test_phrases_in_plain_python():
    """Phrases cover each text once, and equal ones after equal words have equal keys."""
    rng = random.Random(9)
    texts = [sentence(rng, n) for n in (0, 1, 5, 200)]
    w = lm.Words(pa.array([*texts, texts[3]]))
    begin, key = w.phrases()
    assert set(w.at[:-1]) <= set(begin) and len(key) == len(begin)
    of = np.searchsorted(begin, w.at)
    assert key[of[3]: of[4]].tolist() == key[of[4]: of[5]].tolist() and (begin[of[4]: of[5]] - w.at[4]).tolist() == (begin[of[3]: of[4]] - w.at[3]).tolist()
    assert 5 < of[4] - of[3] < 40


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs
    for c in ("held_out", "ids", "rid", "phrase", "score", "base", "rare", "kind", "key"):
        docs = docs.withColumn(c, F.lit("own"))
    rows = lm.score_texts(docs).collect()
    assert len(rows) == 10 and all(math.isfinite(r.score) and r.score <= 1e-6 and math.isfinite(r.base_score) for r in rows)
    assert len({(r.score, r.base_score) for r in rows if r.doc_id == 1}) == 1
    assert sorted(r.n_tokens for r in rows if r.doc_id in (2, 3, 4)) == [1, 1, 1]
    assert lm.score_texts(no_docs).count() == 0
