"""Diff, merge, patch and review operators.

Keyed comparisons are full outer joins. Sequence comparisons match lines by grouped counts and joins;
what is left between matches is aligned in Python, one gap at a time.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def entry_diff(before: DataFrame, after: DataFrame, key: str, content: str) -> DataFrame:
    """Added, Removed and Modified entries of two versions by key; equal means same length and digest."""
    side = lambda df, s: df.select(F.col(key), F.length(content).alias(f"len_{s}"), F.sha2(F.col(content), 256).alias(f"sha_{s}"))
    both = side(before, "a").join(side(after, "b"), key, "full")
    kind = (
        F.when(F.col("sha_a").isNull(), "Added").when(F.col("sha_b").isNull(), "Removed")
        .when((F.col("len_a") != F.col("len_b")) | (F.col("sha_a") != F.col("sha_b")), "Modified")
    )
    return both.withColumn("difference", kind).where("difference is not null").select(key, "difference", "sha_a", "sha_b")


def three_way_merge(ancestor: DataFrame, left: DataFrame, right: DataFrame, key: str, value: str, resolutions: DataFrame | None = None, texts: bool = False) -> DataFrame:
    """Outcome and merged value per key; a null value means that the key is absent.

    ``resolutions`` (key, choice) settles conflicts by UseAncestor, UseLeft or UseRight. With ``texts``, values that both sides changed are
    merged line by line first: TextMerged where that settles them, else the conflict says whether the lines themselves were changed
    differently (ModifiedDifferently) or their number (StructureConflict).
    """
    side = lambda df, s: df.select(F.col(key), F.col(value).alias(s))
    rows = side(ancestor, "a").join(side(left, "l"), key, "full").join(side(right, "r"), key, "full")
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    outcome = F.when(same("l", "r"), F.when(same("a", "l"), "Unchanged").otherwise("Shared")).when(same("a", "l"), "Right").when(same("a", "r"), "Left").otherwise("Conflict")
    rows = rows.withColumn("outcome", outcome)
    conflict = (
        F.when(F.col("a").isNull(), "AddedDifferently").when(F.col("l").isNull(), "DeletedOnLeftModifiedOnRight")
        .when(F.col("r").isNull(), "ModifiedOnLeftDeletedOnRight").otherwise("ModifiedDifferently")
    )
    rows = rows.withColumn("conflict", F.when(F.col("outcome") == "Conflict", conflict))
    merged = F.when(F.col("outcome").isin("Unchanged", "Shared", "Left"), F.col("l")).when(F.col("outcome") == "Right", F.col("r"))
    if texts:
        both = F.when(F.col("conflict") == "ModifiedDifferently", merge_texts(F.col("a"), F.col("l"), F.col("r")))
        rows = rows.withColumn("_lines", both)
        settled = F.coalesce(F.col("_lines.outcome") == "TextMerged", F.lit(False))
        structure = F.col("_lines.outcome") == "StructureConflict"
        rows = rows.withColumns({
            "outcome": F.when(settled, "TextMerged").otherwise(F.col("outcome")), "conflict": F.when(structure, "StructureConflict").when(~settled, F.col("conflict")), "_text": F.col("_lines.text"),
        }).drop("_lines")
        merged = F.when(F.col("outcome") == "TextMerged", F.col("_text")).otherwise(merged)
        rows = rows.withColumn("_merged", merged).drop("_text")
        merged = F.col("_merged")
    if resolutions is None:
        return rows.withColumn("merged", merged).drop("_merged")
    rows = rows.join(resolutions, key, "left")
    chosen = F.when(F.col("choice") == "UseAncestor", F.col("a")).when(F.col("choice") == "UseLeft", F.col("l")).when(F.col("choice") == "UseRight", F.col("r"))
    settled = (F.col("outcome") == "Conflict") & F.col("choice").isNotNull()
    return rows.withColumn("merged", F.when(settled, chosen).otherwise(merged)).withColumn("outcome", F.when(settled, "Resolved").otherwise(F.col("outcome"))).drop("choice", "_merged")


def merge_texts(ancestor: Column, left: Column, right: Column) -> Column:
    """A struct (outcome, text) of three versions of a text of lines, none of them null.

    Where all three have equally many lines, each line is merged by itself; the outcome is TextMerged if no line was changed
    differently on both sides, else Conflict. With other numbers of lines it is StructureConflict. Conflicts have no text.
    """
    a, l, r = (F.split(c, "\n") for c in (ancestor, left, right))
    three = F.arrays_zip(a.alias("a"), l.alias("l"), r.alias("r"))
    line = lambda x: F.when(x["l"] == x["r"], x["l"]).when(x["a"] == x["l"], x["r"]).when(x["a"] == x["r"], x["l"])
    merged = F.transform(three, line)
    same = (F.size(a) == F.size(l)) & (F.size(a) == F.size(r))
    clash = F.exists(merged, lambda x: x.isNull())
    outcome = F.when(~same, "StructureConflict").when(clash, "Conflict").otherwise("TextMerged")
    return F.struct(outcome.alias("outcome"), F.when(same & ~clash, F.array_join(merged, "\n")).alias("text"))


def map_changes(before: Column, after: Column) -> Column:
    """Sorted structs (name, change, old, new) of what differs between two maps: Added, Removed or Changed."""
    names = F.array_sort(F.array_union(F.map_keys(before), F.map_keys(after)))
    old, new = lambda k: F.try_element_at(before, k), lambda k: F.try_element_at(after, k)
    change = lambda k: F.when(~F.map_contains_key(before, k), "Added").when(~F.map_contains_key(after, k), "Removed").when(~old(k).eqNullSafe(new(k)), "Changed")
    rows = F.transform(names, lambda k: F.struct(k.alias("name"), change(k).alias("change"), old(k).alias("old"), new(k).alias("new")))
    return F.filter(rows, lambda x: x["change"].isNotNull())


def create_patch(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Operations Add, Replace and Delete with the values before and after, so a patch has an exact inverse."""
    rows = before.select(key, F.col(value).alias("old")).join(after.select(key, F.col(value).alias("new")), key, "full")
    op = F.when(F.col("old").isNull(), "Add").when(F.col("new").isNull(), "Delete").when(F.col("old") != F.col("new"), "Replace")
    return rows.withColumn("op", op).where("op is not null")


def reverse_patch(patch: DataFrame) -> DataFrame:
    """The inverse of a patch."""
    swapped = F.when(F.col("op") == "Add", "Delete").when(F.col("op") == "Delete", "Add").otherwise(F.col("op"))
    return patch.select(*[c for c in patch.columns if c not in ("old", "new", "op")], F.col("new").alias("old"), F.col("old").alias("new"), swapped.alias("op"))


def apply_patch(rows: DataFrame, patch: DataFrame, key: str, value: str) -> DataFrame:
    """``rows`` after a patch; ``failed`` marks keys whose value isn't the one that the patch expects."""
    both = rows.select(key, F.col(value).alias("have")).join(patch, key, "full")
    failed = F.col("op").isNotNull() & ~F.col("have").eqNullSafe(F.col("old"))
    out = both.withColumn("failed", failed).withColumn(value, F.when(F.col("op").isNull() | F.col("failed"), F.col("have")).otherwise(F.col("new")))
    return out.where(F.col(value).isNotNull()).select(key, value, "failed")


def stays(kind: Column, accept: bool = True, author: Column | None = None, authors: list[str] | None = None) -> Column:
    """Whether a piece (kind keep, ins or del) is in the text once changes are accepted, or rejected.

    With ``authors`` only their changes are decided; of all others, insertions and deletions stay as they are.
    """
    gone = kind == ("del" if accept else "ins")
    return ~(gone if authors is None else gone & author.isin(authors))


def accept_changes(changes: DataFrame, accept: bool = True, authors: list[str] | None = None) -> DataFrame:
    """Text pieces (kind keep, ins or del, and author) after accepting or rejecting all changes, or those of some authors."""
    mine = F.lit(True) if authors is None else F.col("author").isin(authors)
    rows = changes.where(stays(F.col("kind"), accept, F.col("author") if authors else None, authors))
    return rows.withColumn("kind", F.when(mine, "keep").otherwise(F.col("kind")))


def merge_reviews(changes: DataFrame) -> DataFrame:
    """Changes (reviewer, ord, kind, preceding, text) of several reviewers as one set.

    A repeated (kind, first 40 characters before, text) is Skipped; another text at the
    same place is a Conflict with the first, which wins.
    """
    rows = changes.withColumn("place", F.substring("preceding", 1, 40)).withColumn("turn", F.struct("reviewer", "ord"))
    # the first of each text and of each place are grouped minima, so a busy place is no single task
    texts = rows.groupBy("kind", "place", "text").agg(F.min("turn").alias("first_turn"))
    places = texts.groupBy("kind", "place").agg(F.min_by("text", "first_turn").alias("first_text"))
    rows = rows.join(texts, ["kind", "place", "text"]).join(places, ["kind", "place"])
    outcome = F.when(F.col("turn") != F.col("first_turn"), "Skipped").when(F.col("text") != F.col("first_text"), "Conflict").otherwise("Applied")
    return rows.withColumn("outcome", outcome).drop("turn", "first_turn", "first_text")


def shingle_dice(pairs: DataFrame, a: str, b: str, n: int = 3):
    """Dice similarity of the distinct n-character shingles of two text columns; a shorter text has its characters, a null one a null."""
    def grams(t):
        if not isinstance(t, str):
            return {None}
        return {t[i : i + n] for i in range(len(t) - n + 1)} if len(t) >= n else set(t)

    def one(x, y):
        gx, gy = grams(x), grams(y)
        return 2.0 * len(gx & gy) / (len(gx) + len(gy)) if gx or gy else 1.0

    @F.pandas_udf(DoubleType())
    def dice(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([one(*t) for t in zip(x, y)], dtype="float64")

    return pairs.withColumn("dice", dice(a, b))


def normalise(text, ignore_case=True, collapse=True):
    """Text for comparison: lower-cased, white space collapsed and trimmed."""
    out = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")) if collapse else text
    return F.lower(out) if ignore_case else out


# --- sequence comparisons -------------------------------------------------------------------
#
# Lines are rows. Lines that occur once on both sides are matched by a grouped count, those of them that keep
# their order are anchors, and only what lies between two anchors on both sides is aligned in Python.

_TOKENS = re.compile(r"(\s+)")


def longest_increasing(values: list[int]) -> list[int]:
    """Positions of a longest strictly increasing subsequence, by patience sorting."""
    tops, at, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        tops[k:k + 1], at[k:k + 1] = [v], [i]
        back[i] = at[k - 1] if k else -1
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _reach(a: list[int], codes: np.ndarray) -> np.ndarray:
    """How long a common subsequence of ``a`` and each beginning of b is, of 0 to n elements; ``codes`` are b's n elements as numbers from 0.

    One row of the table at a time, as the bits of a number: a bit that is 0 says that the length grows at that place.
    """
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    key = codes[order] * (n // 8 + 1) + (order >> 3)
    starts = np.flatnonzero(np.diff(key, prepend=-1))  # where a byte of an element's mask begins
    byte, value = order[starts] >> 3, np.bitwise_or.reduceat((1 << (order & 7)).astype(np.uint8), starts)
    first = np.searchsorted(codes[order][starts], np.arange(int(codes.max()) + 2)).tolist()
    row = full = (1 << n) - 1
    held: dict[int, int] = {}
    for x in a:
        if (mask := held.get(x)) is None:
            bits = np.zeros(n // 8 + 1, np.uint8)
            bits[byte[first[x]: first[x + 1]]] = value[first[x]: first[x + 1]]
            mask = int.from_bytes(bits.tobytes(), "little")
            if (first[x + 1] - first[x]) * 64 >= n:  # so at most 64 are held
                held[x] = mask
        both = row & mask
        row = ((row + both) | (row - both)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _common(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, out: list) -> None:
    """Add the places of a longest common subsequence: cut ``a`` in halves, and b where both halves together reach farthest."""
    most = min(len(a), len(b))
    differ = np.flatnonzero(a[:most] != b[:most])
    head = int(differ[0]) if len(differ) else most
    differ = np.flatnonzero(a[::-1][: most - head] != b[::-1][: most - head])
    tail = int(differ[0]) if len(differ) else most - head
    out += zip(at_a[:head].tolist(), at_b[:head].tolist())
    end_a, end_b = len(a) - tail, len(b) - tail
    ends = list(zip(at_a[end_a:].tolist(), at_b[end_b:].tolist()))
    a, b, at_a, at_b = a[head:end_a], b[head:end_b], at_a[head:end_a], at_b[head:end_b]
    keep_a, keep_b = np.isin(a, b), np.isin(b, a)
    a, b, at_a, at_b = a[keep_a], b[keep_b], at_a[keep_a], at_b[keep_b]
    if len(a) and len(b):
        names, codes = np.unique(b, return_inverse=True)
        mine = np.searchsorted(names, a).tolist()
        if len(a) * len(b) <= 4096 or len(a) == 1:
            where: dict[int, list[int]] = {}
            for j, x in enumerate(codes.tolist()):
                where.setdefault(x, []).append(j)
            hits = [(i, j) for i, x in enumerate(mine) for j in reversed(where[x])]
            out += [(int(at_a[i]), int(at_b[j])) for i, j in (hits[k] for k in longest_increasing([j for _, j in hits]))]
        else:
            half = len(a) // 2
            cut = int(np.argmax(_reach(mine[:half], codes) + _reach(mine[half:][::-1], codes[::-1])[::-1]))
            _common(a[:half], b[:cut], at_a[:half], at_b[:cut], out)
            _common(a[half:], b[cut:], at_a[half:], at_b[cut:], out)
    out += ends


def common_sequence(a: list, b: list) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in memory that grows with the sequences and not with their product."""
    codes: dict = {}
    x, y = (np.array([codes.setdefault(v, len(codes)) for v in side], np.int64) for side in (a, b))
    out: list[tuple[int, int]] = []
    _common(x, y, np.arange(len(x)), np.arange(len(y)), out)
    return out


def blocks(a: list, b: list) -> list[tuple[int, int, int, int]]:
    """What a longest common subsequence leaves between its elements: (from, to) in a and in b."""
    edges = [(-1, -1), *common_sequence(a, b), (len(a), len(b))]
    return [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:]) if (i + 1, j + 1) != (k, m)]


def changed_spans(a: str, b: str) -> int:
    """In how many places the words of two lines differ."""
    return len(blocks(_TOKENS.split(a), _TOKENS.split(b)))


def side_lines(pairs: DataFrame) -> DataFrame:
    """(doc_id, revised, ord, line) of both texts of (doc_id, base, revised); a null text has no lines."""
    side = lambda c, flag: pairs.select("doc_id", F.lit(flag).alias("revised"), F.posexplode(F.split(c, "\n")).alias("ord", "line"))
    return side("base", False).unionByName(side("revised", True)).withColumn("ord", F.col("ord").cast("long"))


def single_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, a, b, kept): lines that occur once on each side, and whether they belong to the longest run that keeps its order."""
    n = lambda flag: F.count_if(F.col("revised") == flag)
    at = lambda flag: F.max(F.when(F.col("revised") == flag, F.col("ord")))
    once = lines.groupBy("doc_id", "line").agg(n(False).alias("na"), n(True).alias("nb"), at(False).alias("a"), at(True).alias("b")).where("na = 1 and nb = 1")
    ordered = once.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("ab"))

    def run(batches):
        for batch in batches:
            docs, ab = batch.column("doc_id").to_pylist(), batch.column("ab").to_pylist()
            rows = [(doc, x["a"], x["b"], i in kept) for doc, xs in zip(docs, ab) for kept in [set(longest_increasing([x["b"] for x in xs]))] for i, x in enumerate(xs)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["doc_id", "a", "b", "kept"])

    return ordered.mapInArrow(run, "doc_id long, a long, b long, kept boolean")


def gaps(lines: DataFrame, anchors: DataFrame, used: DataFrame) -> DataFrame:
    """(doc_id, gap, base, revised): the lines between anchors (doc_id, a, b), as arrays of (ord, line), without the used ones (doc_id, revised, ord)."""
    marks = anchors.select("doc_id", F.lit(False).alias("revised"), F.col("a").alias("ord")).unionByName(anchors.select("doc_id", F.lit(True).alias("revised"), F.col("b").alias("ord")))
    marked = lines.join(marks.withColumn("mark", F.lit(1)), ["doc_id", "revised", "ord"], "left")
    gap = F.count("mark").over(W.partitionBy("doc_id", "revised").orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    rest = marked.withColumn("gap", gap).join(used, ["doc_id", "revised", "ord"], "left_anti")
    side = lambda flag: F.sort_array(F.collect_list(F.when(F.col("revised") == flag, F.struct("ord", "line"))))
    return rest.groupBy("doc_id", "gap").agg(side(False).alias("base"), side(True).alias("revised"))


def _changes(base: list, revised: list):
    """(change, base place, revised place, spans) of one gap: a block of one line on each side is modified, others are deleted and inserted."""
    for a0, a1, b0, b1 in blocks([x["line"] for x in base], [x["line"] for x in revised]):
        if a1 - a0 == b1 - b0 == 1:
            yield "modified", base[a0]["ord"], revised[b0]["ord"], changed_spans(base[a0]["line"], revised[b0]["line"])
            continue
        yield from (("deleted", x["ord"], None, 1) for x in base[a0:a1])
        yield from (("inserted", None, x["ord"], 1) for x in revised[b0:b1])


def compare_documents(pairs: DataFrame) -> DataFrame:
    """Paragraph changes of (doc_id, base, revised): one-for-one replacements are word diffs, others deletions and insertions."""
    lines = side_lines(pairs)
    anchors = single_lines(lines).where("kept").select("doc_id", "a", "b")
    used = anchors.select("doc_id", F.lit(False).alias("revised"), F.col("a").alias("ord")).unionByName(anchors.select("doc_id", F.lit(True).alias("revised"), F.col("b").alias("ord")))
    between = gaps(lines, anchors, used)
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    names = ["doc_id", "change", "base_ord", "revised_ord", "n_spans"]

    def run(batches):
        for batch in batches:
            doc, base, revised = (batch.column(c).to_pylist() for c in ("doc_id", "base", "revised"))
            rows = [(d, *r) for d, x, y in zip(doc, base, revised) for r in _changes(x, y)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    one_sided = lambda mine, other, change: between.where((F.size(mine) > 0) & (F.size(other) == 0)).select(
        "doc_id", F.lit(change).alias("change"), F.explode(mine).alias("x")
    )
    ord_or = lambda change: F.when(F.col("change") == change, F.col("x.ord"))
    alone = one_sided("base", "revised", "deleted").unionByName(one_sided("revised", "base", "inserted")).select(
        "doc_id", "change", ord_or("deleted").alias("base_ord"), ord_or("inserted").alias("revised_ord"), F.lit(1).cast("long").alias("n_spans")
    )
    both = between.where((F.size("base") > 0) & (F.size("revised") > 0)).select("doc_id", "base", "revised")
    return alone.unionByName(both.mapInArrow(run, "doc_id long, change string, base_ord long, revised_ord long, n_spans long"))


def diff_text(changes: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, text): the changes of each document as a numbered list, in order of place, deletions before insertions."""
    line = lambda flag, c: lines.where(F.col("revised") == flag).select("doc_id", F.col("ord").alias(c), F.col("line").alias(f"{c}_line"))
    rows = changes.join(line(False, "base_ord"), ["doc_id", "base_ord"], "left").join(line(True, "revised_ord"), ["doc_id", "revised_ord"], "left")
    place = F.coalesce("revised_ord", "base_ord")
    n = F.row_number().over(W.partitionBy("doc_id").orderBy(place, F.col("change"), "base_ord"))
    said = (
        F.when(F.col("change") == "deleted", F.concat(F.lit("DELETION: "), F.col("base_ord_line")))
        .when(F.col("change") == "inserted", F.concat(F.lit("INSERTION: "), F.col("revised_ord_line")))
        .otherwise(F.concat(F.lit("REPLACEMENT: "), F.col("base_ord_line"), F.lit(" -> "), F.col("revised_ord_line")))
    )
    numbered = rows.select("doc_id", n.alias("n"), said.alias("said"))
    entry = F.concat(F.col("n").cast("string"), F.lit(". "), F.col("said"))
    return numbered.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", entry.alias("e")))).alias("es")).select(
        "doc_id", F.array_join(F.transform("es", lambda e: e["e"]), "\n").alias("text")
    )


LEAST_RATIO = 0.7  # fixed value: headings less alike than this are never the same clause


@F.pandas_udf(DoubleType())
def heading_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """How alike two headings are: twice the characters in matching blocks over all characters; both empty 1, one empty 0."""
    return pd.Series([float(x == y) if not x or not y else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def compare_clauses(pairs: DataFrame) -> DataFrame:
    """Clause alignment of (doc_id, ours, theirs), both arrays of (heading, body) in order.

    All pairs of headings that can be alike enough are rated; a document's ratings, sorted by our place, then the best, then
    their place, are taken in turn where both places are still free. So each of our clauses gets the best that its
    predecessors left, the earliest among equals.
    """
    side = lambda c, i: pairs.select("doc_id", F.posexplode(c).alias(i, "x")).select(
        "doc_id", F.col(i).cast("long").alias(i), F.coalesce("x.heading", F.lit("")).alias(f"h{i}"), F.col("x.body").alias(f"b{i}")
    )
    ours, theirs = side("ours", "i"), side("theirs", "j")
    n, m = F.length("hi"), F.length("hj")
    can = (2 * F.least(n, m) >= LEAST_RATIO * (n + m))  # no more characters than the shorter has can match
    rated = ours.join(theirs, "doc_id").where(can).withColumn("ratio", F.when(F.col("hi") == F.col("hj"), 1.0).otherwise(heading_ratio("hi", "hj"))).where(F.col("ratio") >= LEAST_RATIO)
    turn = F.sort_array(F.collect_list(F.struct("i", (-F.col("ratio")).alias("worse"), "j")))
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["i"] == x["i"]) | (y["j"] == x["j"]))
    none = F.array().cast("array<struct<i:bigint,worse:double,j:bigint>>")
    taken = rated.groupBy("doc_id").agg(F.aggregate(turn, none, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc)).alias("t"))
    taken = taken.select("doc_id", F.inline("t")).select("doc_id", "i", "j", (-F.col("worse")).alias("ratio"))
    mine = ours.join(taken, ["doc_id", "i"], "left").join(theirs, ["doc_id", "j"], "left")
    kind = F.when(F.col("j").isNull(), "DELETED").when(F.col("ratio") < 1, "RENAMED").when(F.col("bi").eqNullSafe(F.col("bj")), "MATCHED").otherwise("CHANGED")
    furthest = F.max("j").over(W.partitionBy("doc_id").orderBy("i").rowsBetween(W.unboundedPreceding, -1))
    mine = mine.select("doc_id", "i", kind.alias("kind"), F.col("hi").alias("heading"), F.col("hj").alias("other_heading"), "ratio", F.coalesce(F.col("j") <= furthest, F.lit(False)).alias("reordered"))
    added = theirs.join(taken.select("doc_id", "j"), ["doc_id", "j"], "left_anti").select(
        "doc_id", F.lit(None).cast("long").alias("i"), F.lit("ADDED").alias("kind"), F.lit(None).cast("string").alias("heading"), F.col("hj").alias("other_heading"),
        F.lit(None).cast("double").alias("ratio"), F.lit(False).alias("reordered"),
    )
    return mine.unionByName(added)


def moved_children(children: DataFrame, parent: str, before: str, after: str) -> DataFrame:
    """Children (with places before and after) outside the longest run that kept its order: the moved ones."""
    grouped = children.groupBy(parent).agg(F.sort_array(F.collect_list(F.struct(before, after))).alias("cs"))

    def run(batches):
        for batch in batches:
            rows = []
            for p, cs in zip(batch.column(parent).to_pylist(), batch.column("cs").to_pylist()):
                kept = set(longest_increasing([c[after] for c in cs]))
                rows += [(p, c[before], c[after]) for i, c in enumerate(cs) if i not in kept]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], names=[parent, before, after])

    return grouped.mapInArrow(run, f"{parent} long, {before} long, {after} long")
