"""Personal data: base patterns, and what bootstrapped contexts find beyond them.

The base kinds are found by their rules. They are the seeds: the words around them induce lexical patterns
(the one to three words before, or the word before and the one behind), and each pattern extracts whatever
identifier stands in the same context elsewhere in the corpus. Spark scores the graph of patterns and instances in
``ROUNDS`` rounds. A pattern's confidence for a kind is the share of its distinct instances that are known to be of that kind, where
instances of other kinds and those that can't be of this kind count against it and unsettled ones weigh ``DOUBT``; it needs the
support of ``SUPPORT`` known instances. An instance's confidence is the chance that not
all patterns that extract it are wrong. What reaches ``SURE`` is an identifier wherever it stands, and supports further patterns in the next round.

Candidates are runs that look like identifiers without passing a base rule: numbers with separators, groups of hexadecimal
digits, masked or spelled-out mail addresses. They never overlap a base span or each other. One that
has several kinds at once takes the surest, then the first as listed.

A text is read once, alone; what leaves it are its base spans and its candidates with their contexts. A pattern
with very many instances (the word "the") is a sum over map-side counts, and unless it is sure it never meets an instance again.

Null texts are empty. Repeated rows are each scanned on their own, and count once as evidence, as only distinct
instances count. Null ids are kept. Empty tables give empty results. Other columns of the documents are left alone by ``find_personal``;
columns named ``base`` and ``found`` are replaced. Texts of any length take linear work.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_name, row_slices, shared_dir, small, table, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS, SUPPORT, SURE, DOUBT = 3, 3, 0.8, 0.25

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# Runs are taken whole, so no start inside one is tried again.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

# What an identifier may look like that passes no base rule.
_AT = re.compile(r"@|\x20?(?:\(at\)|\[at\]|\{at\})\x20?|\x20at\x20", re.I)
_PLACE = re.compile(r"[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\]|\{dot\})\x20?|\x20dot\x20)[A-Za-z0-9-]++)*+", re.I)
_GROUPS = re.compile(r"(?<![A-Za-z0-9:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![A-Za-z0-9:])")
_NUMBER = re.compile(r"(?<![A-Za-z0-9*])[+(]{0,2}[0-9*](?:[\x20().:/_-]{0,2}[0-9*])++")
_DOT = re.compile(r"\.|\bdot\b", re.I)
_WORD = re.compile(r"[^\W_]+|[^\w\s]")
LEFT, RIGHT = 64, 32


def luhn(digits: str) -> bool:
    """Whether the digits pass the check sum by doubling every second one from the right."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _run_before(text: str, at: int, low: int) -> int:
    """Where the run of a mail address's first part begins that ends at ``at``, from ``low`` on."""
    while at > low and text[at - 1] in _LOCAL:
        at -= 1
    return at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds: leftmost, non-overlapping by kind, failing ones dropped."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:  # each sign has one run before it, so this is linear
        start, host = _run_before(text, at, last), _HOST.match(text, at + 1)
        last = at + 1
        if start < at and host:
            out.append((start, 0, last := host.end()))
        at = text.find("@", last)
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.groups()):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def could_be(found: str) -> int:
    """A bit for each kind that a candidate's form allows."""
    if _AT.search(found):
        return 1
    digits, signs, joints = sum(c in "0123456789" for c in found), found.count("*"), found.count(".") + found.count(":")
    number = digits >= 4 and all(c in "0123456789*+()./:_ -" for c in found)
    return 2 * (joints >= 2 and (number or ":" in found)) + 4 * (number and 12 <= digits + signs <= 19) + 8 * (number and 6 <= digits + signs <= 15)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of runs that look like identifiers, from left to right, apart from ``taken`` and from each other."""
    runs, low = [], 0
    for m in _AT.finditer(text):
        start, place = _run_before(text, m.start(), low), _PLACE.match(text, m.end())
        if start < m.start() and place and (m[0].strip().lower() != "at" or _DOT.search(place[0])):
            runs.append((start, place.end()))
        low = m.end()
    if _DIGITS.search(text):
        runs += [m.span() for m in _GROUPS.finditer(text)]
        runs += [m.span() for m in _NUMBER.finditer(text) if not text[m.end(): m.end() + 1].isalnum()]
    out, k, reach, taken = [], 0, 0, sorted((a, b) for a, _, b in taken)
    for a, b in sorted(runs, key=lambda r: (r[0], -r[1])):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if a >= reach and not any(t < b and a < e for t, e in taken[k: k + 4]) and could_be(text[a:b]):
            out.append((a, b))
            reach = b
    return out


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns around a run: its line's last three, two and one words before it, and the last before with the first behind; digits count as 0."""
    before = text[max(0, start - LEFT): start]
    before = before[before.rfind("\n") + 1:]
    behind = text[end: end + RIGHT].split("\n", 1)[0]
    if before[-1:].isalnum() or behind[:1].isalnum():
        return []  # part of a longer word
    left = [_DIGITS.sub("0", w.lower()) for w in _WORD.findall(before)]
    right = [_DIGITS.sub("0", w.lower()) for w in _WORD.findall(behind)[:1]]
    if not left:
        return [f"^ _ {right[0]}"] if right else []
    out = [" ".join([*left[-n:], "_"]) for n in (1, 2, 3) if n <= len(left)]
    return out + [f"{left[-1]} _ {right[0]}"] if right else out


def _key(found: str) -> bytes:
    return hashlib.blake2b(found.lower().encode("utf-8", "replace"), digest_size=16).digest()


_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"
_SEEN = "array<struct<start:bigint,end:bigint,kind:int,could:int,instance:binary,patterns:array<string>>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_SEEN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("could", pa.int32()), ("instance", pa.binary()), ("patterns", pa.list_(pa.string()))]))


def read_text(text: str):
    """(base spans, all runs with their contexts): kind is -1 for candidates."""
    base = base_spans(text)
    seen = []
    for a, b, kind, could in sorted([(a, b, k, 1 << k) for a, k, b in base] + [(a, b, -1, could_be(text[a:b])) for a, b in candidates(text, base)]):
        patterns = contexts(text, a, b)
        if patterns or kind < 0:
            seen.append({"start": a, "end": b, "kind": kind, "could": could, "instance": _key(text[a:b]), "patterns": patterns})
    return base, seen


def _reader(text: str, keep: list[str]):
    def read(batches):
        for batch in batches:
            for part in row_slices(batch, text):
                both = [read_text(t or "") for t in part.column(text).to_pylist()]
                base = pa.array([[{"start": a, "kind": k, "end": b} for a, k, b in x[0]] for x in both], _SPAN_TYPE)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], base, pa.array([x[1] for x in both], _SEEN_TYPE)], names=[*keep, "base", "seen"])

    return read


def graph(seen: DataFrame) -> DataFrame:
    """(pattern, instance, kind, could): each edge once; kind is -1 unless a base rule names the instance."""
    edges = seen.select(F.explode("patterns").alias("pattern"), "instance", "kind", "could")
    return edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"), F.max("could").alias("could"))


def score_patterns(edges: DataFrame, known: DataFrame, support: float = SUPPORT, sure: float = SURE) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that are sure, from the edges and what is known of candidates (instance, kind, confidence)."""
    kinds = range(len(KINDS))
    seed = [F.count_if(F.col("kind") == k).cast("double") for k in kinds]
    open_ = [F.count_if((F.col("kind") == -1) & (F.col("could").bitwiseAND(1 << k) != 0)).cast("double") for k in kinds]
    sums = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.array(*seed).alias("seed"), F.array(*open_).alias("open"))
    each = sums.select("pattern", "n", F.posexplode(F.arrays_zip("seed", "open")).alias("kind", "c")).select("pattern", "kind", "n", "c.seed", "c.open")
    gained = edges.where("kind = -1").select("pattern", "instance").join(known, "instance").groupBy("pattern", "kind").agg(F.sum("confidence").alias("gained"), F.count("*").alias("settled"))
    each = each.join(gained, ["pattern", "kind"], "left").fillna(0, ["gained", "settled"])
    held, doubt = F.col("seed") + F.col("gained"), DOUBT * (F.col("open") - F.col("gained"))
    against = F.col("n") - F.col("seed") - F.col("open")
    return each.where(F.col("seed") + F.col("settled") >= support).select("pattern", "kind", (held / (held + against + doubt)).alias("confidence")).where(F.col("confidence") >= sure)


def score_instances(edges: DataFrame, patterns: DataFrame, sure: float = SURE) -> DataFrame:
    """(instance, kind, confidence) of the candidates that sure patterns extract: one kind each."""
    fits = F.expr("could & shiftleft(1, kind) <> 0")
    met = edges.where("kind = -1").select("pattern", "instance", "could").join(small(patterns), "pattern").where(fits)
    each = met.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(0.999)))))).alias("confidence")).where(F.col("confidence") >= sure)
    best = each.groupBy("instance").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b"))
    return best.select("instance", (-F.col("b.k")).alias("kind"), F.col("b.confidence").alias("confidence"))


def bootstrap(seen: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances) that are sure after some rounds over the graph of all runs."""
    _, edges = written(graph(seen), "pii-graph")
    known = edges.sparkSession.createDataFrame([], "instance binary, kind int, confidence double")
    patterns = None
    for _ in range(rounds):
        patterns = shared_dir(score_patterns(edges, known))
        known = shared_dir(score_instances(edges, patterns))
    return patterns, known


def scanned(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of each row with ``base`` and ``found``: its base spans, and all of them with those that contexts add."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = docs.mapInArrow(_reader(text, keep), f"{schema}, base {_SPANS}, seen {_SEEN}")
    key = fresh_name(docs, "_row")
    _, rows = written(rows.withColumn(key, F.monotonically_increasing_id()), "pii-seen")
    seen = rows.select(key, F.inline("seen"))
    _, known = bootstrap(seen)
    new = seen.where("kind = -1").select(key, "start", "end", "instance").join(small(known.select("instance", F.col("kind").cast("int"))), "instance")
    new = new.groupBy(key).agg(F.collect_list(F.struct("start", "kind", "end")).alias("new"))
    open_ = F.exists("seen", lambda s: s["kind"] == -1)
    found = F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "new"))).alias("found")
    settled = rows.where(~open_).select(*keep, "base", F.col("base").alias("found"))
    return settled.unionByName(rows.where(open_).drop("seen").join(new, key, "left").select(*keep, "base", found))


def find_personal(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``found``: arrays of (start, kind, end) in code points, by start and kind."""
    docs = docs.drop(*[c for c in ("base", "found", "seen") if c != text])
    return scanned(docs, text, docs.columns)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents, by the base rules and by bootstrapped contexts."""
    rows = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"])
    names = F.array(*[F.lit(k) for k in KINDS])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    line = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(line("base"), 256).alias("base_sha256"), line("found").alias("spans"),
    )


QUERIES = {"op12_pii": op12_pii}
ORACLES: dict = {}
