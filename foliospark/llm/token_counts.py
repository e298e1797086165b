"""Token counts by prefix dynamic programming, exact for a sentencepiece BPE model.

No piece of the model joins a blank to what stands before it, or holds a line
feed, so tokens never cross the cuts "before a run of blanks" and "around a line
feed". A text is cut there into stretches; with t(s) the tokens of stretch s in its
place, the tokens of the prefix that ends with stretch i are
P[i] = P[i - 1] + t(s_i), exactly what the library gives for that prefix. Inside a stretch every run of its
first tokens is the encoding of its own text, so the table has an entry at every token that ends a character.
Distinct stretches of a block of rows are encoded once. The prefix table is
stored per document, so questions about budgets and truncation need no encoding
(``tokens_upto``, ``cut_at``). Texts with the model's own blank sign U+2581, which
would break the rule, form one stretch with one entry; so do stretches that the model normalises.

The tokenizer file is a parameter. Nulls: a null text is empty and has no
tokens. Repeated rows are counted one by one. Columns named as the results are replaced. Empty tables give empty results.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import distinct, hash_words, row_slices, table, utf8

LIMIT = 4096
NEW = ("n_bytes", "n_tokens", "cut_bytes", "prefix")
MODEL = "piece_bpe_32k.model"
#: Places of a stretch: at the start of a text, after a blank, after a line feed; a line feed itself.
START, BLANK, LINE, FEED = range(4)


def _model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _cuts(raw: np.ndarray, off: np.ndarray):
    """Starts of stretches, their places, and the row offsets among them."""
    n = len(raw)
    first = np.zeros(n + 1, bool)
    first[off] = True
    before = np.zeros(n, np.uint8)
    before[1:] = raw[:-1]
    feed, blank = raw == 10, raw == 32
    cut = first[:-1] | (blank & (before != 32)) | feed | (before == 10)
    starts = np.flatnonzero(cut)
    place = np.where(first[starts], START, np.where(feed[starts], FEED, np.where(blank[starts], BLANK, LINE)))
    return starts, place, np.searchsorted(starts, off)


def _whole_rows(raw, off):
    """Rows that hold U+2581."""
    at = np.flatnonzero((raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)) if len(raw) > 2 else np.empty(0, np.int64)
    return np.unique(np.searchsorted(off, at, "right") - 1)


def _piece_bytes(model) -> np.ndarray:
    """Bytes of text that each id stands for: a blank sign is one blank, a byte id one byte."""
    out = np.empty(model.get_piece_size(), np.int64)
    for i in range(len(out)):
        out[i] = 1 if model.is_byte(i) else len(model.id_to_piece(i).replace("\u2581", " ").encode("utf-8"))
    return out


def _tokens(model, stretches: list[str], place: np.ndarray):
    """(ids, how many each stretch has) of stretches in their places. A line feed before a stretch keeps the model from adding a blank to it."""
    fed = len(model.encode("\n"))
    asked = [p[1:] if k == BLANK else "\n" + p if k in (LINE, FEED) else p for p, k in zip(stretches, place)]
    lists = model.encode(asked, num_threads=1) if asked else []
    blank = model.piece_to_id("\u2581")
    lists = [x[fed:] if k in (LINE, FEED) else [blank] if k == BLANK and p == " " else x for x, k, p in zip(lists, place, stretches)]
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum())), size


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all elements of runs that begin at ``begin``."""
    return np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def _entries(raw, starts, ends, place, ids, size, widths):
    """(bytes, tokens, how many each stretch has) of the entries of stretches ``raw[starts:ends]`` with ``size`` of the ids each.

    An entry ends at every token that ends a character and isn't a blank: cut there, a text has exactly the
    tokens up to there. A stretch whose text the model normalises has one entry.
    """
    of = np.repeat(np.arange(len(size)), size)
    first = np.cumsum(size) - size
    width = widths[ids]
    width[first[(place == START) & (size > 0)]] -= 1  # the blank that the model adds
    upto = np.cumsum(width)
    before = np.concatenate([[0], upto])[first]
    end = starts[of] + upto - before[of]
    plain = np.bincount(of, width, len(size)).astype(np.int64) == ends - starts
    last = np.zeros(len(ids), bool)
    last[(first + size - 1)[size > 0]] = True
    byte = lambda at: raw[np.clip(at, 0, len(raw) - 1)]
    good = plain[of] & (width > 0) & (end < ends[of]) & ((byte(end) & 0xC0) != 0x80) & (byte(end - 1) != 32) if len(raw) else last
    kept = np.flatnonzero(good | last)
    owner = of[kept]
    n = np.bincount(owner, minlength=len(size))
    stop = np.where(last[kept], ends[owner], end[kept])
    new = np.ones(len(kept), bool)
    new[1:] = owner[1:] != owner[:-1]
    from_byte = np.where(new, starts[owner], np.concatenate([[0], stop[:-1]]))
    from_token = np.where(new, first[owner], np.concatenate([[0], kept[:-1] + 1]))
    lengths, tokens = stop - from_byte, kept + 1 - from_token
    empty = np.flatnonzero(size == 0)  # text without tokens still has its bytes
    if len(empty):
        at = np.searchsorted(owner, empty)
        lengths, tokens = np.insert(lengths, at, (ends - starts)[empty]), np.insert(tokens, at, 0)
        n[empty] = 1
    return lengths, tokens, n


def stretch_counts(model, texts: pa.Array, widths=None):
    """(byte lengths, tokens, row offsets) of all entries of a batch of texts."""
    widths = _piece_bytes(model) if widths is None else widths
    raw, off = utf8(texts)
    starts, place, rows = _cuts(raw, off)
    if len(whole := _whole_rows(raw, off)):  # one stretch each
        keep = np.ones(len(starts), bool)
        for r in whole:
            keep[rows[r] + 1: rows[r + 1]] = False
        starts, place = starts[keep], place[keep]
        rows = np.searchsorted(starts, off)
    ends = np.append(starts[1:], len(raw))[: len(starts)]
    key = hash_words(raw, starts, ends) ^ (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    code, _, once = distinct(key.view(np.int64))
    data = raw.tobytes()
    ids, size = _tokens(model, [data[starts[i]: ends[i]].decode("utf-8") for i in once], place[once])
    lengths, tokens, n = _entries(raw, starts[once], ends[once], place[once], ids, size, widths)
    at = _spread((np.cumsum(n) - n)[code], n[code]) if len(code) else np.empty(0, np.int64)
    return lengths[at], tokens[at], np.concatenate([[0], np.cumsum(n[code])])[rows] if len(code) else np.zeros(len(off), np.int64)


def pack(lengths: np.ndarray, tokens: np.ndarray) -> bytes:
    """A prefix table: the width of its numbers, then all byte lengths, then all token counts."""
    most = max(lengths.max(initial=0), tokens.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + lengths.astype(f"<u{width}").tobytes() + tokens.astype(f"<u{width}").tobytes()


def unpack(prefix: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(byte end, tokens up to there) of every stretch."""
    both = np.frombuffer(prefix, f"<u{prefix[0]}", offset=1).reshape(2, -1).astype(np.int64)
    return both[0].cumsum(), both[1].cumsum()


def tokens_upto(prefix: bytes, end: int) -> int:
    """Tokens of the longest stored prefix of at most ``end`` bytes."""
    ends, counts = unpack(prefix)
    k = int(np.searchsorted(ends, end, "right"))
    return int(counts[k - 1]) if k else 0


def cut_at(prefix: bytes, budget: int) -> int:
    """Bytes of the longest stored prefix of at most ``budget`` tokens."""
    ends, counts = unpack(prefix)
    k = int(np.searchsorted(counts, budget, "right"))
    return int(ends[k - 1]) if k else 0


def prefix_counts(docs: DataFrame, model_path: str | None = None, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens, ``cut_bytes`` (of the longest stored prefix of ``LIMIT`` tokens at most) and ``prefix``, the packed prefix table.

    ``model_path`` is a sentencepiece file that every executor can open; by
    default the public 32k model, found on each executor.
    """

    def rows(batches):
        import public_tokenizers

        model = _model(model_path or public_tokenizers.path(MODEL))
        widths = _piece_bytes(model)
        for batch in batches:
            for part in row_slices(batch, text):
                column = part.column(part.schema.get_field_index(text))
                lengths, tokens, at = stretch_counts(model, column, widths)
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[at])
                packed = [pack(lengths[a:b], tokens[a:b]) for a, b in zip(at, at[1:])]
                n_bytes, n_tokens = sums(lengths), sums(tokens)
                cut = [b if n <= LIMIT else cut_at(p, LIMIT) for b, n, p in zip(n_bytes.tolist(), n_tokens.tolist(), packed)]
                new = [pa.array(n_bytes), pa.array(n_tokens), pa.array(cut, pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *NEW])

    own = docs.drop(*[c for c in NEW if c != text])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return own.mapInArrow(rows, f"{schema}, n_bytes long, n_tokens long, cut_bytes long, prefix binary")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents under the 32k model, and which exceed the limit."""
    rows = prefix_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "cut_bytes")


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict = {}
