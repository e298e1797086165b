"""Secret scans with a recursive decoding worklist.

Each text is scanned for the three base kinds. Then its encoded stretches
(percent escapes, Unicode escapes and numeric character references, base64, and what
gzip, zlib, zstd, bzip2, xz and bare deflated data base64 holds) are unwrapped, each layer is scanned and unwrapped
in turn until nothing new appears; layers already seen at the same place are not
visited again, so layers that decode to each other end. The same encoded stretch at two
places is mapped to both. A hit in a layer is mapped back to
the text: through escapes character by character, through base64 and
compression to the whole encoded stretch.

Decoding one text needs that text alone, so the work is spread by rows and
any lost task is simply run again. Compressed layers are unpacked in a stream and scanned
in overlapping blocks of ``BLOCK`` bytes, whatever their size. Decoded bytes are scanned even
where they are no clean text; base64 that is wrapped over lines is also read as one stretch.

A place that only looks like the beginning of packed data is left at once, so the work follows the bytes. Of stretches without a blank that are longer than a
block, a block and an overlap are in memory, unless they hold packed data in base64 themselves: that is kept whole until it ends.

Null texts are empty and have no secrets. Repeated rows are scanned one by one; spans that two layers give are one. Equal starts stand by kind. Empty tables give
empty results. Columns named ``base`` and ``found`` are replaced; all others are kept.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_slices, table

KINDS = ("assign", "access", "hex")
BLOCK, OVERLAP, STEP = 16 << 20, 1 << 16, 64
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones can be left out at once
_ASSIGN_WORDS = ("passw", "secret", "token", "api")

_BAD = re.compile("[\udc80-\udcff]")
# An escape of its own first sign (%2525...41) is undone to the end at once, so chains of them take one pass.
_PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
_ONE_PERCENT = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
_ESCAPE = re.compile(
    r"\\(?:u005[cC])*(?:u([dD][89abAB][0-9A-Fa-f]{2})\\(?:u005[cC])*u([dD][c-fC-F][0-9A-Fa-f]{2})|u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|x([0-9A-Fa-f]{2}))"
    r"|&(?:#38;)*(?:#([0-9]{1,7});|#[xX]([0-9A-Fa-f]{1,6});)"
    r"|\\(?:u005[cC])*U([0-9A-Fa-f]{8})|%(?:25)*u([0-9A-Fa-f]{4})"
)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:(?:[\x20\t]*\r?\n[\x20\t]*|(?:\\r)?\\n)[A-Za-z0-9+/_-]++)+(?:(?:[\x20\t]*\r?\n[\x20\t]*|(?:\\r)?\\n)?=){0,2}")
_LINE = re.compile(r"(?:\\r)?\\n|[A-Za-z0-9+/_-]+={0,2}")
# How compressed data begins, and what decoded bytes must hold to be worth a scan.
_PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|\x28\xb5\x2f\xfd|BZh[1-9]|\xfd7zXZ\0")
_WORTH = re.compile(rb"(?i)passw|secret|token|api|AKIA|[0-9a-f]{16}|[A-Za-z0-9+/_-]{16}|[%\\\0]|&#")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base secrets of a text."""
    out = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return out


class Layer:
    """A text that a document unwraps to, and where each of its characters begins and ends in the document."""

    def __init__(self, text: str, begin=None, end=None):
        self.text = text
        self.begin, self.end = (np.arange(len(text)), np.arange(1, len(text) + 1)) if begin is None else (begin, end)

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The stretch of the document behind some characters."""
        return int(self.begin[a]), int(self.end[b - 1])

    def mark(self) -> bytes:
        """A digest of the text and its places."""
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass") + self.begin.tobytes() + self.end.tobytes(), digest_size=16).digest()

    def replaced(self, parts):
        """The layer with stretches replaced: parts are (plain, cuts), where cuts are each plain character's (from, to) here; None without parts."""
        texts, begins, ends, last = [], [], [], 0
        for plain, cuts in parts:
            a = cuts[0][0]
            texts += [self.text[last:a], plain]
            begins += [self.begin[last:a], self.begin[[x for x, _ in cuts]]]
            ends += [self.end[last:a], self.end[[y - 1 for _, y in cuts]]]
            last = cuts[-1][1]
        if not last:
            return None
        return Layer("".join(texts) + self.text[last:], np.concatenate([*begins, self.begin[last:]]), np.concatenate([*ends, self.end[last:]]))


def _percents(text):
    """Runs of percent escapes as UTF-8; a byte that is none becomes a character of its own."""
    for m in _PERCENT.finditer(text):
        signs = list(_ONE_PERCENT.finditer(text, m.start(), m.end()))
        plain = bytes(int(x[1], 16) for x in signs).decode("utf-8", "surrogateescape")
        cuts, at = [], 0
        for ch in plain:
            n = len(ch.encode("utf-8", "surrogateescape"))
            cuts.append((signs[at].start(), signs[at + n - 1].end()))
            at += n
        yield _BAD.sub("\ufffd", plain), cuts


def _escapes(text):
    """Unicode escapes and numeric references; a pair of surrogates is one character."""
    for m in _ESCAPE.finditer(text):
        if m[1]:
            code = 0x10000 + ((int(m[1], 16) - 0xD800) << 10) + int(m[2], 16) - 0xDC00
        else:
            code = int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16)
        if code <= 0x10FFFF:
            yield chr(code), [m.span()]


_FAULTS = (zlib.error, zstandard.ZstdError, lzma.LZMAError, OSError, EOFError)


def _decoder(head: bytes):
    """A decoder for gzip, zlib, zstd, bzip2 or xz data that begins so, else None."""
    if head[:2] == b"\x1f\x8b" or head[:1] == b"\x78":
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:4] == b"\xfd7zX":
        return lzma.LZMADecompressor(lzma.FORMAT_XZ)
    return zstandard.ZstdDecompressor().decompressobj() if head[:4] == b"\x28\xb5\x2f\xfd" else None


def _gzip_body(raw: bytes, at: int, zeros: np.ndarray) -> int:
    """Where the deflated data behind a head of gzip begins; -1 where the head doesn't end. ``zeros`` are the places of zero bytes, which end names."""
    flags, at = raw[at + 3] if at + 3 < len(raw) else 0xE0, at + 10
    if flags & 0xE0:
        return -1
    if flags & 4:
        at += 2 + int.from_bytes(raw[at: at + 2], "little")
    for name in (8, 16):
        if flags & name:
            k = int(np.searchsorted(zeros, at))
            if k == len(zeros):
                return -1
            at = int(zeros[k]) + 1
    return at + (flags & 2)


def _gives(raw: bytes, at: int, zeros: np.ndarray) -> bool:
    """Whether what begins like compressed data at a place goes on like it, for as long as it takes to give a first byte."""
    d = _decoder(raw[at: at + 4])
    if raw[at: at + 2] == b"\x1f\x8b":
        d, at = zlib.decompressobj(-15), _gzip_body(raw, at, zeros)
    try:
        while 0 <= at < len(raw):
            if d.decompress(raw[at: at + STEP]) or d.eof:
                return True
            at += STEP
    except _FAULTS:
        pass
    return False


def _packed_starts(raw: bytes):
    """Where compressed data begins in some bytes."""
    zeros = None
    for m in _PACKED.finditer(raw):
        if zeros is None:
            zeros = np.flatnonzero(np.frombuffer(raw, np.uint8) == 0)
        if _gives(raw, m.start(), zeros):
            yield m.start()


def _bare(raw: bytes) -> bool:
    """Whether the bytes as a whole are deflated data without a head."""
    d, at, got = zlib.decompressobj(-15), 0, False
    try:
        while at < len(raw) and not d.eof:
            got |= bool(d.decompress(raw[at: at + STEP]))
            at += STEP
    except zlib.error:
        return False
    return got and d.eof and not d.unused_data and at >= len(raw)


def _inflate(chunks):
    """What compressed data holds, up to its end or first fault; ``STEP`` bytes at a time keep the outputs to some MB."""
    d, left = None, b""
    for chunk in chunks:
        for a in range(0, len(chunk), STEP):
            data, left = left + chunk[a: a + STEP], b""
            while data:
                if d is None:
                    if len(data) < 4:
                        left = data
                        break
                    if (d := _decoder(data)) is None:
                        return
                try:
                    out = d.decompress(data)
                except _FAULTS:
                    return
                if out:
                    yield out
                data, d = (d.unused_data, None) if d.eof else (b"", d)


def _unpack(chunks, heads=()):
    """Chunks of bytes, inflated again and again; data that holds itself ends."""
    chunks = iter(chunks)
    first = next(chunks, b"")
    rest = [first]
    if (head := first[:OVERLAP]) not in heads and _decoder(first) is not None:

        def noted():
            yield first
            for more in chunks:
                rest.append(more)
                yield more

        inner = _unpack(_inflate(noted()), (*heads, head))
        if begin := next(inner, b""):
            rest.clear()
            yield begin
            for more in inner:
                rest.clear()
                yield more
            return
    yield from rest
    yield from chunks


def _blocks(chunks):
    """(block, whether it is the last) of data, all but the last of ``BLOCK`` bytes."""
    held = bytearray()
    for chunk in chunks:
        held += chunk
        while len(held) > BLOCK:
            yield bytes(held[:BLOCK]), False
            del held[:BLOCK]
    yield bytes(held), True


def _holds_packed(text: str) -> bool:
    """Whether base64 in a text holds data that can only be unpacked whole."""
    return any(True for m in _BASE64.finditer(text) for raw in _unbase64(m[0]) for _ in _packed_starts(raw))


def _tail(text: str) -> str:
    """The end of a block that is scanned again with the next one: from the last blank within a line, so no stretch is cut.

    Of a stretch longer than a block the last ``OVERLAP`` characters are enough, unless there is packed data in it.
    """
    at = text.rfind(" ", 0, max(0, len(text) - OVERLAP))
    while at > 0 and text[at - 1] in " \t\r\n":
        at = text.rfind(" ", 0, at)
    at = max(at, 0)
    if len(text) - at >= BLOCK and not _holds_packed(text[at:]):
        at = len(text) - OVERLAP
    return text[at:]


def _inflate_bare(raw: bytes):
    """What deflated data without a head holds."""
    d = zlib.decompressobj(-15)
    for at in range(0, len(raw), STEP):
        if out := d.decompress(raw[at: at + STEP]):
            yield out


def _readings(raw: bytes):
    """The streams that decoded bytes may be: as they are, unless they are packed from their first byte on, and unpacked from wherever compressed data begins.

    What only looks like a beginning gives no stream, so bytes full of beginnings are read once.
    """
    good = list(_packed_starts(raw))
    if good[:1] != [0]:
        yield [raw]
        if not good and _bare(raw):
            yield _unpack(_inflate_bare(raw))
    for at in good:
        yield _unpack([raw[at:]])


def _texts(raw: bytes):
    """The texts that decoded bytes may be, in overlapping blocks."""
    for stream in _readings(raw):
        tails: dict = {}
        for block, last in _blocks(stream):
            if not tails and not _WORTH.search(block):
                if not last:  # what begins in it may end in the next
                    tails["utf-8"] = _tail(block.decode("utf-8", "replace"))
                continue
            wide = ("utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be") if b"\0" in block else ()
            for name in ("utf-8", *wide):
                text = tails.pop(name, "") + block.decode(name, "replace")
                if not last:
                    tails[name] = _tail(text)
                yield text


def _unbase64(body: str):
    """The bytes that a stretch of base64 may hold: it may begin at any of its first four signs, as after a path."""
    body = body.rstrip("=").replace("-", "+").replace("_", "/")
    for skip in range(4):
        part = body[skip:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        raw = binascii.a2b_base64(part + "=" * (-len(part) % 4))
        if _WORTH.search(raw) or _PACKED.search(raw) or _bare(raw):
            yield raw


def _base64_layers(text):
    """(start, end, bytes) of stretches of base64, and of lines of it that belong together."""
    for m in _BASE64.finditer(text):
        for raw in _unbase64(m[0]):
            yield m.start(), m.end(), raw
    for m in _WRAPPED.finditer(text):
        lines = [x for x in _LINE.finditer(text, m.start(), m.end()) if x[0][0] != "\\"]
        size = [len(x[0]) for x in lines]
        first = 0
        while first < len(lines):  # lines of one length, with a shorter one after them
            last = first
            while last + 1 < len(lines) and size[last + 1] == size[first]:
                last += 1
            end = last + (last + 1 < len(lines) and size[last + 1] < size[first])
            for begin in {first, max(0, first - 1)}:  # what stands before the first whole line may belong to it
                if end > begin:
                    for raw in _unbase64("".join(x[0] for x in lines[begin: end + 1])):
                        yield lines[begin].start(), lines[end].end() if end + 1 < len(lines) else m.end(), raw
            first = last + 1


UNWRAPS = (("%", _percents), ("\\", _escapes), ("&#", _escapes), ("%u", _escapes), ("%25", _escapes))


def _plain(text: str, parts) -> str | None:
    """A text with stretches replaced, without their places."""
    out, last = [], 0
    for plain, cuts in parts:
        out += [text[last: cuts[0][0]], plain]
        last = cuts[-1][1]
    return "".join(out) + text[last:] if last else None


def _kinds(raw: bytes, seen: set[bytes] | None = None) -> set[int]:
    """Kinds of the secrets of decoded bytes at any layer; all of them lie in one encoded stretch of the document.

    What a layer holds is followed at once, so one layer of each depth is in memory.
    """
    mark = lambda data: hashlib.blake2b(data, digest_size=16).digest()
    seen = {mark(raw)} if seen is None else seen
    out: set[int] = set()
    for text in _texts(raw):
        layers, known = [text], {hash(text)}
        while layers:
            layer = layers.pop()
            out |= {k for _, k, _ in scan(layer)}
            for sign, unwrap in UNWRAPS:
                if sign in layer and (got := _plain(layer, unwrap(layer))) is not None and hash(got) not in known:
                    known.add(hash(got))
                    layers.append(got)
            for _, _, inner in _base64_layers(layer):
                if (key := mark(inner)) not in seen:
                    seen.add(key)
                    out |= _kinds(inner, seen)
    return out


def scan_layers(text: str) -> tuple[list, list]:
    """Base secrets and all secrets of a text, as sorted (start, kind, end)."""
    base = sorted(scan(text))
    found, kinds, seen = set(base), {}, set()
    work = [Layer(text)]
    while work:
        layer = work.pop()
        for a, kind, b in scan(layer.text) if seen else ():
            start, end = layer.span(a, b)
            found.add((start, kind, end))
        seen.add(layer.mark() if seen or "%" in text or "\\" in text or "&#" in text else b"")
        for sign, unwrap in UNWRAPS:
            if sign in layer.text and (got := layer.replaced(unwrap(layer.text))) is not None and (mark := got.mark()) not in seen:
                seen.add(mark)
                work.append(got)
        for a, b, raw in _base64_layers(layer.text):
            if raw not in kinds:
                kinds[raw] = _kinds(raw)
            if kinds[raw]:
                start, end = layer.span(a, b)
                found |= {(start, kind, end) for kind in kinds[raw]}
    return base, sorted(found)


def _scan_rows(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    for batch in batches:
        for part in row_slices(batch):
            both = [scan_layers(t or "") for t in part.column("text").to_pylist()]
            as_rows = lambda spans: [{"start": a, "kind": k, "end": b} for a, k, b in spans]
            cols = [pa.array([as_rows(x[i]) for x in both], kind) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in part.schema.names], *cols], names=[*part.schema.names, "base", "found"])


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``found``: arrays of (start, kind, end) in code points, by start and kind."""
    spans = "array<struct<start:bigint,kind:int,end:bigint>>"
    rows = docs.drop("base", "found") if text not in ("base", "found") else docs
    rows = rows if text == "text" else rows.withColumnRenamed(text, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(_scan_rows, f"{schema}, base {spans}, found {spans}")


def _redact(batches):
    for batch in batches:
        for part in row_slices(batch):
            out = []
            for t in part.column("text").to_pylist():
                spans = scan_layers(t)[1] if t else []
                at, kept = 0, []
                for a, _, b in spans:
                    if b > at:
                        if a >= at:
                            kept += [t[at:a], MASK]
                        at = b
                out.append("".join(kept) + t[at:] if spans else t)
            i = part.schema.get_field_index("text")
            part = part.set_column(i, part.schema.field(i), pa.array(out, part.schema.field(i).type))
            if (j := part.schema.get_field_index("n_chars")) >= 0:
                sizes = pa.array([None if t is None else len(t) for t in out]).cast(part.schema.field(j).type)
                part = part.set_column(j, part.schema.field(j), sizes)
            yield part


MASK = "[SECRET]"


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret, at any layer, replaced in its text; ``n_chars`` follows where it exists."""
    return docs.mapInArrow(_redact, docs.schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, at every layer."""
    rows = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    line = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(line("base"), 256).alias("base_sha256"), line("found").alias("spans"),
    )


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLES: dict = {}
