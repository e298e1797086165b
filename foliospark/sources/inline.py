"""Inline marks of Markdown: emphasis, deleted text, code, links, images, notes and escapes, as a plain text and spans over it.

One pass over a line with a stack of openers. A run of ``*``, ``_`` or ``~~`` opens where no white space follows it and closes
where none precedes it; ``_`` does neither inside a word; a closer takes the nearest opener of its sign, two signs as strong where both have two. A run
that could do both doesn't match one whose lengths add up to a multiple of three, unless both are multiples. Code goes first, then links. What has no partner is text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
_TICKS, _RUN = re.compile("`+"), re.compile(r"\*+|_+|~+")
_NOTE = re.compile(r"\[\^([^\s\[\]]+)\]")
_TARGET = re.compile(r"\(\s*(<[^<>\n]*>|[^\s()]*+(?:\([^\s()]*\)[^\s()]*+)*+)(?:\s+(?:\"[^\"]*\"|'[^']*'))?\s*\)")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]+:[^\s<>]*)>")


class _Line:
    def __init__(self, text: str):
        self.text, self.out, self.size, self.spans = text, [], 0, []
        self.runs: list[dict] = []
        self.brackets: list[dict] = []
        self.opened = self.dead = 0  # brackets so far, and how many of them a link that ended has made plain text

    def put(self, piece: str) -> int:
        """Add plain text; the place of the piece among all."""
        self.out.append(piece)
        self.size += len(piece)
        return len(self.out) - 1

    def run(self, at: int, end: int) -> None:
        sign, before, behind = self.text[at], self.text[at - 1: at], self.text[end: end + 1]
        opens, closes = bool(behind) and not behind.isspace(), bool(before) and not before.isspace()
        flat = lambda c: not c or c.isspace() or c in _PUNCTUATION
        opens, closes = opens and not (behind in _PUNCTUATION and not flat(before)), closes and not (before in _PUNCTUATION and not flat(behind))
        if sign == "_":
            opens, closes = opens and (not closes or before in _PUNCTUATION), closes and (not opens or behind in _PUNCTUATION)
        if sign == "~" and end - at != 2:
            opens = closes = False
        piece = self.put(self.text[at:end])
        if opens or closes:
            self.runs.append({"sign": sign, "left": end - at, "size": end - at, "opens": opens, "closes": closes, "piece": piece})

    def emphasis(self, low: int) -> None:
        """Match the runs from ``low`` on; spans are kept as pairs of pieces until all places are known."""
        runs, stack, none = self.runs[low:], [], {}
        for r in runs:
            while r["closes"] and r["left"]:
                key = (r["sign"], r["opens"], r["size"] % 3)
                k = len(stack) - 1
                while k >= none.get(key, 0):
                    o = stack[k]
                    odd = (o["closes"] or r["opens"]) and (o["size"] + r["size"]) % 3 == 0 and (o["size"] % 3 or r["size"] % 3)
                    if o["sign"] == r["sign"] and not odd:
                        break
                    k -= 1
                if k < none.get(key, 0):
                    none[key] = len(stack)
                    break
                o = stack[k]
                del stack[k + 1:]
                n = 2 if o["left"] >= 2 and r["left"] >= 2 else 1
                kind = "deleted" if r["sign"] == "~" else "strong" if n == 2 else "emphasis"
                o["left"] -= n
                r["left"] -= n
                self.spans.append((kind, (o["piece"], o["left"], "after"), (r["piece"], r["size"] - r["left"] - n, "used"), None))
                for x in (o, r):
                    self.out[x["piece"]] = x["sign"] * x["left"]
                if not o["left"]:
                    stack.pop()
                none = {x: min(v, len(stack)) for x, v in none.items()}
            if r["opens"] and r["left"]:
                stack.append(r)
        del self.runs[low:]

    def close(self, at: int) -> int:
        """A closing bracket at ``at``: a link or an image if an opener and a target fit; where to go on."""
        if not self.brackets:
            self.put("]")
            return at + 1
        o = self.brackets.pop()
        target = _TARGET.match(self.text, at + 1) if o["image"] or o["number"] >= self.dead else None
        if target is None:
            self.put("]")
            return at + 1
        self.emphasis(o["runs"])
        self.out[o["piece"]] = ""
        end = self.put("")
        self.spans.append(("image" if o["image"] else "link", (o["piece"], 0, "after"), (end, 0, "after"), target[1].strip("<>")))
        if not o["image"]:
            self.dead = self.opened  # a link holds no link
        return target.end()

    def read(self):
        text, at = self.text, 0
        plain = re.compile(r"[^\\`*_~\[\]!<]+")
        ticks: dict[int, list[int]] = {}
        for m in _TICKS.finditer(text):
            ticks.setdefault(len(m[0]), []).append(m.start())
        for found in ticks.values():
            found.reverse()
        while at < len(text):
            c = text[at]
            if m := plain.match(text, at):
                self.put(m[0])
                at = m.end()
            elif c == "\\" and text[at + 1: at + 2] in _PUNCTUATION and at + 1 < len(text):
                self.put(text[at + 1])
                at += 2
            elif m := _TICKS.match(text, at):
                ends = ticks[len(m[0])] if len(m[0]) in ticks else []
                while ends and ends[-1] < m.end():
                    ends.pop()
                if ends:
                    code = text[m.end(): ends[-1]]
                    code = code[1:-1] if len(code) > 2 and code[0] == code[-1] == " " and code.strip() else code
                    piece = self.put(code)
                    self.spans.append(("code", (piece, 0, "before"), (piece, 0, "after"), None))
                    at = ends.pop() + len(m[0])
                else:
                    self.put(m[0])
                    at = m.end()
            elif m := _NOTE.match(text, at):
                piece = self.put("")
                self.spans.append(("note", (piece, 0, "after"), (piece, 0, "after"), m[1]))
                at = m.end()
            elif m := _AUTO.match(text, at):
                piece = self.put(m[1])
                self.spans.append(("link", (piece, 0, "before"), (piece, 0, "after"), m[1]))
                at = m.end()
            elif c == "[" or c == "!" and text[at + 1: at + 2] == "[":
                sign = "![" if c == "!" else "["
                self.brackets.append({"piece": self.put(sign), "runs": len(self.runs), "image": c == "!", "number": self.opened})
                self.opened += 1
                at += len(sign)
            elif c == "]":
                at = self.close(at)
            elif m := _RUN.match(text, at):
                self.run(at, m.end())
                at = m.end()
            else:
                self.put(c)
                at += 1
        self.emphasis(0)
        starts = [0]
        for piece in self.out:
            starts.append(starts[-1] + len(piece))
        place = lambda p: starts[p[0]] if p[2] == "before" else starts[p[0] + 1] if p[2] == "after" else starts[p[0]]
        spans = sorted((place(a), -place(b), kind, target) for kind, a, b, target in self.spans)
        return "".join(self.out), [(kind, a, -b, target) for a, b, kind, target in spans]


def inline(text: str) -> tuple[str, list[tuple[str, int, int, str | None]]]:
    """(plain text, spans (kind, start, end, target)) of a line, outer spans first."""
    return _Line(text).read()


_SPANS = "array<struct<kind:string,start:int,end:int,target:string>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("target", pa.string())]))


def inline_marks(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines with ``plain`` and ``spans`` of a text column; null texts have neither."""

    def run(batches):
        for batch in batches:
            both = [(None, None) if t is None else inline(t) for t in batch.column(text).to_pylist()]
            spans = [None if x is None else [dict(zip(("kind", "start", "end", "target"), s)) for s in x] for _, x in both]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p for p, _ in both], pa.string()), pa.array(spans, _TYPE)], names=[*batch.schema.names, "plain", "spans"])

    rows = lines.drop("plain", "spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, plain string, spans {_SPANS}")


def tasks_and_notes(lines: DataFrame) -> DataFrame:
    """Markdown lines (kind, text) with ``checked`` for task items and ``note``, the key that a line defines; their texts lose the mark."""
    text = F.col("text")
    box = F.when(F.col("kind") == "list", F.regexp_extract(text, r"^\[([ xX])\]\s+", 1))
    key = F.when(F.col("kind") == "paragraph", F.regexp_extract(text, r"^\[\^([^\s\[\]]+)\]:\s*", 1))
    return lines.withColumns({
        "checked": F.when(box != "", box != " "), "note": F.when(key != "", key),
        "text": F.when(box != "", F.regexp_replace(text, r"^\[[ xX]\]\s+", "")).when(key != "", F.regexp_replace(text, r"^\[\^[^\s\[\]]+\]:\s*", "")).otherwise(text),
    })
