"""CSV against Python's reader, inline Markdown by hand, in round trips and over long lines, task items and notes."""

import csv
import io
import random
import time

import pytest

from foliospark.sources import markup
from foliospark.sources.inline import inline, inline_marks, tasks_and_notes


def test_csv_equals_another_reader(spark):
    rng = random.Random(13)
    texts = ["".join(rng.choice(['a', 'b', ',', '"', '""', '\n', '\r\n', ' ', 'é', '","', '"\n']) for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    texts += ["", "\n", "\n\n", '""', '"', ',', 'a\n', 'a\r\n\r\nb', '"a"b"c,d', '"never closed,\nat all', 'x"y,"z""', '"' + "q" * 200_000 + '\n""",' + '"', ('"a ""b"" c",' * 20_000) + "end"]
    rows = markup.csv_cells(spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, {}).setdefault(r.row, []).append((r.column, r.value))
    for i, t in enumerate(texts):
        csv.field_size_limit(10**9)
        want = {k: list(enumerate(cells)) for k, cells in enumerate(csv.reader(io.StringIO(t, newline=""))) if cells}
        assert {k: sorted(v) for k, v in got.get(i, {}).items()} == want, t[:80]
    assert len(texts) not in got


@pytest.mark.parametrize("text,plain,spans", [
    ("a **b** c", "a b c", [("strong", 2, 3)]), ("***x***", "x", [("emphasis", 0, 1), ("strong", 0, 1)]), ("**a *b* c**", "a b c", [("strong", 0, 5), ("emphasis", 2, 3)]), ("*a**b*c**", "a**bc**", [("emphasis", 0, 4)]),
    ("a_b_c _d_", "a_b_c d", [("emphasis", 6, 7)]), ("x ** y", "x ** y", []), ("**open", "**open", []), ("~~gone~~ ~one~", "gone ~one~", [("deleted", 0, 4)]), (r"\*no\* \a", r"*no* \a", []), ("``a`b``", "a`b", [("code", 0, 3)]),
    ("`a **b`**", "a **b**", [("code", 0, 5)]), ("` a `", "a", [("code", 0, 1)]), ("`open", "`open", []), ("*foo*bar*", "foobar*", [("emphasis", 0, 3)]), ("**foo*", "*foo", [("emphasis", 1, 4)]), ("*foo**", "foo*", [("emphasis", 0, 3)]), ("", "", []), ("é *ß*", "é ß", [("emphasis", 2, 3)]),
])
def test_marks(text, plain, spans):
    got = inline(text)
    assert (got[0], [s[:3] for s in got[1]]) == (plain, spans)


@pytest.mark.parametrize("text,plain,spans", [
    ("[la *b* el](http://x) y", "la b el y", [("link", 0, 7, "http://x"), ("emphasis", 3, 4, None)]), ("![alt](i.png \"t\")", "alt", [("image", 0, 3, "i.png")]), ("see [^1] and[^n-2]", "see  and", [("note", 4, 4, "1"), ("note", 8, 8, "n-2")]),
    ("<http://u.v> <b>", "http://u.v <b>", [("link", 0, 10, "http://u.v")]), ("[x [y](z) w](q)", "[x y w](q)", [("link", 3, 4, "z")]), ("[![a](b)](c)", "a", [("image", 0, 1, "b"), ("link", 0, 1, "c")]), ("[a](b) [c](d", "a [c](d", [("link", 0, 1, "b")]),
    ("[a](<b c>)", "a", [("link", 0, 1, "b c")]), ("[a](b(c)d)", "a", [("link", 0, 1, "b(c)d")]), ("*[a*](b)", "*a*", [("link", 1, 3, "b")]),
])
def test_links_images_and_notes(text, plain, spans):
    got, found = inline(text)
    assert (got, sorted(found, key=str)) == (plain, sorted(spans, key=str))


def render(rng, depth):
    """(Markdown, plain text, spans) of random nested marks that follow each other apart from blanks."""
    text, plain, spans = [], [], []
    for _ in range(rng.randint(1, 4)):
        kind = rng.choice(["word", "strong", "deleted", "code", "link"]) if depth else "word"
        at = sum(map(len, plain)) + (1 if plain else 0)
        if kind in ("word", "code"):
            w = "".join(rng.choice("abc*_[]!é") for _ in range(rng.randint(1, 5)))
            text.append(f"`{w}`" if kind == "code" else "".join("\\" + c if c in "*_[]!" else c for c in w))
            inner, own = w, [("code", 0, len(w), None)] if kind == "code" else []
        else:
            t, inner, own = render(rng, depth - 1)
            text.append({"strong": f"**{t}**", "deleted": f"~~{t}~~", "link": f"[{t}](u{at})"}[kind])
            if any(s[0] == kind for s in own):  # a mark inside its own kind could be read either way
                return render(rng, depth)
            own = [(kind, 0, len(inner), f"u{at}" if kind == "link" else None), *own]
        spans += [(k, a + at, b + at, x) for k, a, b, x in own]
        plain.append((" " if plain else "") + inner)
    return " ".join(text), "".join(plain), spans


def test_round_trips():
    rng = random.Random(14)
    for _ in range(2000):
        text, plain, spans = render(rng, 3)
        got, found = inline(text)
        if "****" in text or "~~~~" in text:  # two marks that meet are one run
            continue
        assert got == plain and sorted(found, key=str) == sorted(spans, key=str), text


@pytest.mark.parametrize("piece", ["*a ", "a* ", "`", "[", "**a* ", "_a*b", "](", "![", "[a](", "a**b", "[a](b)", "``a`", "<http://a", "[^", "\\", "[[a](b)"])
def test_long_lines_take_linear_work(piece):
    def took(n):
        began = time.process_time()
        inline(piece * n)
        return time.process_time() - began

    assert took(32_000) < 24 * took(4000) + 1


def test_null_lines_tasks_and_notes(spark):
    lines = spark.createDataFrame([(1, "list", "[x] done *now*"), (2, "list", "[ ] open"), (3, "list", "[y] no"), (4, "paragraph", "[^n1]: a note"), (5, "paragraph", "text"), (6, "paragraph", None)], "ord int, kind string, text string")
    rows = {r.ord: r for r in inline_marks(tasks_and_notes(lines)).collect()}
    assert [(rows[k].checked, rows[k].note, rows[k].text) for k in range(1, 7)] == [(True, None, "done *now*"), (False, None, "open"), (None, None, "[y] no"), (None, "n1", "a note"), (None, None, "text"), (None, None, None)]
    assert rows[1].plain == "done now" and rows[6].plain is None and rows[6].spans is None
