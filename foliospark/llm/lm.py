"""Language-model scoring: causal self-attention over subword ids, trained in numpy.

A text is its lower-cased words and one end, as subword ids (public 32k pieces, never trained
here; each word is split by itself). ``lm_net.Net`` predicts every id from those before it.
Windows of ``CONTEXT + SPAN`` ids overlap by ``CONTEXT``; each id is scored once, in the window
where it is among the last ``SPAN``, in batches.

Beside the network the model knows the phrases that training documents repeat. A text is cut
into phrases where a hash of the three words before says so, at every sixteenth word or so. Where
one begins, the model writes a repeated phrase whole with probability ``WHOLE``, by its count:

    P(phrase | before) = (1 - WHOLE) * prod P_net(id | before) + WHOLE * (count - DISCOUNT) / phrases

with no second term for a phrase seen less than twice. ``net_score`` has no such term.

Learning. Words and phrases are counted over all training documents in Spark. One pass encodes
every text; ids, their pairs and their classes are counted from it, and the network learns from
every window of all training documents, in ``ROUNDS`` rounds with a part of the documents
each. In a round documents are dealt by a hash to shards of about ``SHARD`` ids; each shard
learns from the same start, in an order set by the hash, and the results are averaged. So the
result doesn't depend on how Spark splits the input, and more documents mean more shards, not larger ones.

Sizes. Tasks get the ``HEAD`` most frequent words for the base score; counts of all others, and
of phrases, are joined to the rows. So the bound says where a count comes from, never whether it counts.

Null texts are empty (one end token). A null id counts as the empty text. Extra columns are
not looked at, whatever their names. Repeated rows are learned and scored one by one; equal rows
get equal scores. Without training documents the network is uniform over pieces.
"""

from __future__ import annotations

import copy
import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm_net
from .common import arrow_words, bucket_of, distinct, drop_table, hash_words, lent, mix64, row_slices, sum_vectors, table, written
from .lm_net import BEGIN, BUCKETS, CLASSES, END, NAMES, PIECES, WIDTH, Net

HEAD, ROUNDS, SHARD, STRETCH = 1 << 21, 2, 1 << 21, 1 << 16
FOLDS, HELD_OUT = 10, 0
EVERY, ORDER = 16, 3  # a phrase begins where the hash of ORDER words is a multiple of EVERY
WHOLE, DISCOUNT = 0.1, 0.75
END_HASH = 4_542_532
SLICE = 4 << 20
STRIP = 4000  # ids in one vector of embeddings
KEPT = 1 << 19  # words whose ids a worker keeps
MODEL = "piece_bpe_32k.model"
WORD, PHRASE = 0, 1


def _pieces_model(path=None):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))


class Pieces:
    """Subword ids by the words' hashes. A word is encoded once until more than ``KEPT`` are kept; then all but the last ones are let go."""

    def __init__(self, model):
        self.model = model
        self.keys, self.begin, self.size, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint16)

    def of(self, hashes, words):
        """(ids, where those of each of the distinct ``hashes`` begin, how many they are); ``words`` gives the words at some places."""
        if len(self.keys) + len(hashes) > KEPT:
            self.__init__(self.model)
        new = np.flatnonzero(find(self.keys, self.size + 1, hashes) == 0)  # a word may have no ids
        if len(new):
            lists = self.model.encode(words(new), num_threads=1)
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            order = np.argsort(keys := np.append(self.keys, hashes[new]), kind="stable")
            self.keys, self.size = keys[order], np.append(self.size, size)[order]
            self.begin = np.append(self.begin, len(self.flat) + np.cumsum(size) - size)[order]
            self.flat = np.append(self.flat, np.fromiter(itertools.chain.from_iterable(lists), np.uint16, int(size.sum())))
        at = np.searchsorted(self.keys, hashes)
        return self.flat, self.begin[at], self.size[at]


@functools.cache
def _pieces() -> Pieces:
    """The pieces of this worker."""
    return Pieces(_pieces_model())


class Words:
    """The words of a batch of texts: ``seq`` indexes distinct words, row i is at ``at[i]:at[i + 1]``, its end included."""

    def __init__(self, texts: pa.Array):
        self.raw, self.starts, self.ends, rows = arrow_words(texts)
        code, hashes, self.once = distinct(hash_words(self.raw, self.starts, self.ends).view(np.int64))
        self.hashes = np.append(hashes, END_HASH).astype(np.int64)
        n = len(rows) - 1
        self.at = rows + np.arange(n + 1)
        self.seq = np.full(len(code) + n, len(hashes), np.int64)
        words = np.ones(len(self.seq), bool)
        words[self.at[1:] - 1] = False
        self.seq[words] = code
        self.row = np.repeat(np.arange(n), np.diff(self.at))

    def encode(self, pieces: Pieces):
        """Subword ids of all words in order, and how many each word has."""
        data = self.raw.tobytes()

        def words(which):
            return [data[a:b].decode("utf-8") for a, b in zip(self.starts[self.once[which]].tolist(), self.ends[self.once[which]].tolist())]

        flat, begin, size = pieces.of(self.hashes[:-1], words)
        flat, begin, size = np.append(flat, np.uint16(END)), np.append(begin, len(flat)), np.append(size, 1)
        n = size[self.seq]
        return flat[np.repeat(begin[self.seq] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], n

    def phrases(self):
        """(where each phrase begins among the words, its key)."""
        h = self.hashes[self.seq].view(np.uint64)
        before = np.zeros(len(h), np.uint64)
        for k in range(1, ORDER + 1):
            before[ORDER:] += mix64(h[ORDER - k: len(h) - k] + np.uint64(k))
        first = self.at[:-1]
        cut = (mix64(before) % np.uint64(EVERY) == 0) & (np.arange(len(h)) - first[self.row] >= ORDER)
        cut[first] = True
        begin = np.flatnonzero(cut)
        place = np.arange(len(h)) - np.repeat(begin, np.diff(np.append(begin, len(h))))
        sums = np.add.reduceat(mix64(h + mix64(place.astype(np.uint64))), begin) if len(begin) else np.empty(0, np.uint64)
        return begin, mix64(sums).view(np.int64)


def find(keys, counts, wanted) -> np.ndarray:
    """The count of each wanted key among sorted ones, 0 for others."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0)


def _lists(at, values) -> pa.ListArray:
    """Arrow lists of values that are cut at ``at``."""
    return pa.ListArray.from_arrays(pa.array(np.asarray(at, np.int32)), pa.array(values))


def _blobs(at, values: np.ndarray) -> pa.Array:
    """Arrow binaries of fixed-width values that are cut at ``at``."""
    ends = (np.asarray(at, np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


# --- counting and encoding ---------------------------------------------------------------


def _count_rows(batches):
    """Per slice: words and phrases with their counts."""
    for batch in batches:
        for part in row_slices(batch, "text", 2 * SLICE):
            w = Words(part.column("text"))
            if not len(w.seq):
                continue
            keys, n = np.unique(w.phrases()[1], return_counts=True)
            kind = np.repeat(np.array([WORD, PHRASE], np.int8), [len(w.hashes), len(keys)])
            cols = [kind, np.concatenate([w.hashes, keys]), np.concatenate([np.bincount(w.seq, minlength=len(w.hashes)), n])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "key", "n"])


def _encode_rows(shared):
    """Per row: its ids, phrases (key, last id) and tokens; how many are known and the base score by the head alone, and the other words."""

    def run(batches):
        (keys, counts, norm), pieces = shared.value, _pieces()
        for batch in batches:
            for part in row_slices(batch, "text", SLICE):
                w = Words(part.column("text"))
                n = len(w.at) - 1
                ids, size = w.encode(pieces)
                end = np.concatenate([[0], np.cumsum(size)])
                begin, phrase = w.phrases()
                of = np.searchsorted(begin, w.at)
                until = end[np.append(begin[1:], len(w.seq))] - end[w.at[:-1]][w.row[begin]] if len(begin) else np.empty(0, np.int64)
                c = find(keys, counts, w.hashes)
                base = np.log10((c + 0.1) / norm)
                rare = np.flatnonzero((c == 0)[w.seq])
                pair, often = np.unique(w.row[rare] * len(w.hashes) + w.seq[rare], return_counts=True)
                at = np.searchsorted(pair // len(w.hashes), np.arange(n + 1))
                cols = [
                    part.column("doc_id"), part.column("held_out"), _blobs(end[w.at], ids), _lists(of, phrase), _lists(of, until),
                    np.diff(w.at), np.bincount(w.row, (c > 0)[w.seq], n).astype(np.int64), np.bincount(w.row, base[w.seq], n),
                    _lists(at, w.hashes[pair % len(w.hashes)]), _lists(at, often.astype(np.int64)),
                ]
                names = ["doc_id", "held_out", "ids", "phrase", "until", "n_tokens", "n_known", "base", "rare", "often"]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)

    return run


ENCODED = "held_out boolean, ids binary, phrase array<long>, until array<long>, n_tokens long, n_known long, base double, rare array<long>, often array<long>"


def _joined(column: pa.Array):
    """All ids of a column of blobs as one array, and where each row's ids end."""
    blobs = column.to_pylist()
    return np.frombuffer(b"".join(blobs), np.uint16), np.cumsum([len(b) // 2 for b in blobs], dtype=np.int64)


def _before(ids, ends):
    """The id before each, or the begin."""
    prev = np.concatenate([[BEGIN], ids[:-1]]).astype(np.int64)
    prev[ends[:-1]] = BEGIN
    return prev


def _pair_rows(batches):
    """Per slice: pairs of an id and the next one, with counts."""
    for part in (p for batch in batches for p in row_slices(batch, "ids", 2 * SLICE)):
        ids, ends = _joined(part.column("ids"))
        if len(ids):
            code, pairs, _ = distinct(_before(ids, ends) * PIECES + ids)
            yield pa.RecordBatch.from_arrays([pa.array(pairs // PIECES), pa.array(pairs % PIECES), pa.array(np.bincount(code))], names=["p", "q", "n"])


def _matrix(df: DataFrame, shape) -> np.ndarray:
    """(row, column, n) as a matrix; its size is fixed, whatever the corpus."""
    t = df.toArrow()
    out = np.zeros(shape)
    out[t.column(0).to_numpy(), t.column(1).to_numpy()] = t.column(2).to_numpy()
    return out


def start_net(pairs: DataFrame) -> Net:
    """The network before it has learned: classes, counted tables and embeddings from pairs (p, q, n) of ids."""
    spark = pairs.sparkSession
    total = lambda *by: pairs.groupBy(*by).agg(F.sum("n").alias("n"))
    near = lambda c: F.pmod(F.shiftright(F.col(c) * 2_654_435_761, 7), F.lit(BUCKETS))
    profile = np.concatenate([_matrix(total("p", near("q").alias("b")), (PIECES, BUCKETS)), _matrix(total("q", near("p").alias("b")), (PIECES, BUCKETS))], 1)
    classes, emb = lm_net.classes_and_places(profile)
    of = spark.createDataFrame(pa.table({"id": np.arange(PIECES), "c": classes}))  # 32,000 rows at any corpus
    after = _matrix(pairs.join(F.broadcast(of), F.col("q") == F.col("id")).groupBy("p", "c").agg(F.sum("n").alias("n")), (PIECES, CLASSES))
    into = _matrix(pairs.join(F.broadcast(of), F.col("p") == F.col("id")).groupBy("c", "q").agg(F.sum("n").alias("n")), (CLASSES, PIECES))
    return Net(classes, *lm_net.tables(classes, into.sum(0), after, into), emb)


# --- learning ----------------------------------------------------------------------------


def _stretch_rows(batches):
    """Per stretch of at most ``STRETCH`` ids of a text: a hash of it and of its place, and the ids, packed for the shuffle."""
    pack = zstandard.ZstdCompressor(1)
    for batch in batches:
        order, blobs = [], []
        for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
            for k in range(0, len(ids), 2 * STRETCH):
                own = ids[k: k + 2 * STRETCH]
                blobs.append(pack.compress(own))
                order.append(int.from_bytes(hashlib.blake2b(b"%d %s " % (k, str(doc).encode()) + own, digest_size=8).digest(), "big", signed=True))
        yield pa.RecordBatch.from_arrays([pa.array(order, pa.int64()), pa.array(blobs, pa.binary())], names=["order", "ids"])


def _learn_shard(shared):
    """What one shard has learned: embeddings times how often each id was seen, in strips, and the small arrays times its ids."""

    def run(rows: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor()
        ids, ends = _joined(pa.array([unpack.decompress(b) for b in rows.sort_by("order").column("ids").to_pylist()], pa.binary()))
        own = shared.value.copy()
        learner = lm_net.learn(own, ids, ends)
        out = {"s": np.append(np.concatenate([getattr(own, n).ravel() for n in NAMES]).astype(np.float64) * len(ids), len(ids))}
        for a in range(0, PIECES, STRIP):
            seen = learner.seen[a: a + STRIP, None]
            if seen.any():
                out[f"e{a}"] = np.concatenate([own.emb[a: a + STRIP] * seen, seen], 1).ravel()
        return pa.table({"part": list(out), "v": pa.array([v.astype(np.float32).tobytes() for v in out.values()], pa.binary())})

    return run


def averaged(net: Net, parts: dict) -> Net:
    """The network with the mean of what shards have learned; an embedding weighs by how often its shard has seen it."""
    new = net.copy()
    for part, v in parts.items():
        if part == "s":
            at, mean = 0, v[:-1] / v[-1]
            for n in NAMES:
                old = getattr(net, n)
                setattr(new, n, mean[at: at + old.size].reshape(old.shape).astype(np.float32))
                at += old.size
        else:
            block = v.reshape(-1, WIDTH + 1)
            used = block[:, WIDTH] > 0
            new.emb[int(part[1:]): int(part[1:]) + len(block)][used] = (block[used, :WIDTH] / block[used, WIDTH:]).astype(np.float32)
    return new


def trained(net: Net, texts: DataFrame, n_ids: int) -> Net:
    """The network after ``ROUNDS`` rounds over texts (doc_id, ids) of ``n_ids`` ids in all."""
    sc = texts.sparkSession.sparkContext
    stretches = texts.mapInArrow(_stretch_rows, "order long, ids binary")
    for k in range(ROUNDS):
        shards = max(1, round(n_ids / ROUNDS / SHARD))
        mine = stretches.where(F.pmod("order", F.lit(ROUNDS)) == k).withColumn("shard", F.pmod(F.xxhash64("order"), F.lit(shards)))
        bare = copy.copy(net)
        bare.inside = None  # learning doesn't look at it
        with lent(sc, bare) as shared:
            rows = mine.groupBy("shard").applyInArrow(_learn_shard(shared), "part string, v binary")
            net = averaged(net, {r["part"]: np.frombuffer(r["v"], np.float32).astype(np.float64) for r in sum_vectors(rows, kind=np.float32).collect()})
    return net


# --- scoring -----------------------------------------------------------------------------


def _score_rows(shared):
    """Per row: the network's score, and of each phrase its key and natural score."""

    def run(batches):
        net = shared.value
        for part in (p for batch in batches for p in row_slices(batch, "ids", 2 * SLICE)):
            ids, ends = _joined(part.column("ids"))
            total = np.concatenate([[0], np.cumsum(net.log_scores(ids, ends))])
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            until = part.column("until")
            row = np.repeat(np.arange(len(ends)), np.diff(until.offsets.to_numpy()))
            last = until.flatten().to_numpy() + begins[row]
            first = np.concatenate([[0], last[:-1]])
            own = total[ends] - total[begins]
            lists = pa.ListArray.from_arrays(pa.array((until.offsets.to_numpy() - until.offsets[0].as_py()).astype(np.int32)), pa.array((total[last] - total[first]).astype(np.float32)))
            keep = ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "rare", "often", "phrase"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], lists, pa.array(own)], names=[*keep, "logs", "own"])

    return run


def most_frequent(counts: DataFrame, most: int):
    """Sorted keys and counts of at most ``most`` words: all whose count reaches the least bin of counts that still fits.

    The bins are sixteenths of a doubling, about a thousand at any size; so what
    reaches the driver is bounded by ``most``, however many tasks there are.
    """
    of = F.floor(F.log2("n") * 16)
    bins = counts.groupBy(of.alias("bin")).agg(F.count("*").alias("keys")).orderBy(F.desc("bin")).collect()
    least, room = None, most
    for b in bins:
        room -= b["keys"]
        if room < 0:
            break
        least = b["bin"]
    t = counts.where(F.lit(False) if least is None else of >= least).select("key", "n").toArrow()
    key, n = (t.column(c).to_numpy() for c in ("key", "n"))
    order = np.argsort(key)
    return key[order], n[order]


def score_texts(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, net_score (of the network alone)."""
    sc = docs.sparkSession.sparkContext
    own = docs.select(F.col(doc_id).alias("doc_id"), (bucket_of(F.col(doc_id), FOLDS) == HELD_OUT).alias("held_out"), F.col(text).alias("text"))
    counts = own.where(~F.col("held_out")).select("text").mapInArrow(_count_rows, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    _, counts = written(counts.where(f"kind = {WORD} or n > 1"), "lm-counts")
    words = counts.where(f"kind = {WORD}")
    tokens, known = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    norm = tokens + 0.1 * (known + 1)
    kind = own.schema["doc_id"].dataType.simpleString()
    with lent(sc, (*most_frequent(words, HEAD), norm)) as shared:
        place, rows = written(own.mapInArrow(_encode_rows(shared), f"doc_id {kind}, {ENCODED}").withColumn("rid", F.monotonically_increasing_id()), "lm")
    train = rows.where(~F.col("held_out"))
    n_ids, phrases = train.agg(F.coalesce(F.sum(F.length("ids")) / 2, F.lit(0)), F.coalesce(F.sum(F.size("phrase")), F.lit(0))).first()
    of_pairs, pairs = written(train.select("ids").mapInArrow(_pair_rows, "p long, q long, n long").groupBy("p", "q").agg(F.sum("n").alias("n")), "lm-pairs")
    net = start_net(pairs)
    drop_table(docs.sparkSession, of_pairs)
    if n_ids:
        net = trained(net, train.select("doc_id", "ids"), int(n_ids))
    with lent(sc, net) as shared:
        _, scored = written(rows.mapInArrow(
            _score_rows(shared),
            f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, rare array<long>, often array<long>, phrase array<long>, logs array<float>, own double",
        ), "lm-scored")
    drop_table(docs.sparkSession, place)
    units = scored.select("rid", F.explode(F.concat(
        F.transform(F.arrays_zip("rare", "often"), lambda x: F.struct(F.lit(WORD).cast("byte").alias("kind"), x["rare"].alias("key"), x["often"].cast("double").alias("x"))),
        F.transform(F.arrays_zip("phrase", "logs"), lambda x: F.struct(F.lit(PHRASE).cast("byte").alias("kind"), x["phrase"].alias("key"), x["logs"].cast("double").alias("x"))),
    )).alias("u")).select("rid", "u.*")
    is_word = F.col("kind") == WORD
    gain = F.log(F.lit(WHOLE / (1 - WHOLE)) * (F.col("n") - DISCOUNT) / max(phrases, 1)) - F.col("x")
    found = units.join(counts, ["kind", "key"]).groupBy("rid").agg(
        F.sum(F.when(is_word, F.col("x"))).cast("long").alias("more_known"),
        F.sum(F.when(is_word, F.col("x") * F.log10((F.col("n") + 0.1) / 0.1))).alias("more_base"),
        F.sum(F.when(~is_word, F.when(gain > 30, gain).otherwise(F.log1p(F.exp(F.least(gain, F.lit(30.0))))))).alias("more"),
    )
    none = lambda c: F.coalesce(F.col(c), F.lit(0))
    whole = F.col("own") + F.col("n_phrases") * float(np.log(1 - WHOLE)) + none("more")
    slim = scored.select("rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "own", F.size("phrase").alias("n_phrases"))
    return slim.join(found, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + none("more_known")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + none("more_base")).alias("base_score"), (whole / float(np.log(10))).alias("score"), (F.col("own") / float(np.log(10))).alias("net_score"),
    )


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents under the model and under word counts."""
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op4_lm_score": op4_lm_score}
ORACLES: dict = {}
