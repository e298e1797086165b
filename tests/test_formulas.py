"""Formula expressions: what can't be read, ranks of signs by hand, and random trees against plain arithmetic."""

import math
import random

import pytest

from foliospark.operators import formulas as f

CELLS = [("t", r, c, v) for r, row in enumerate([[4.0, 2.5, None, 7.0], [10.0, -3.0, 0.0, 1.0], [6.0, None, 8.0, None]], 1) for c, v in enumerate(row, 1)]


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame(CELLS + [("u", 1, 1, 3.0), ("u", 1, 2, None)], "t string, r int, c int, v double")


def one(cells, text, at="D3", replace=False):
    rows = f.evaluate(cells.where("t = 't'"), {at: text}, "t", "r", "c", "v", replace).collect()
    return rows[0].result, rows[0].status


@pytest.mark.parametrize("text", [
    "", "=", "1 + 2", "D3 + 1", "A1 +", "(A1", "A1)", "A1 A2", "FOO(A1)", "A1 ? 2", "AND(A1)", "IF(A1, 2)", "SUM(ABOVE, ABOVE)", "SUM(ABOVE, LEFT, BELOW)", "SUM(ABOVE, A1)", "A1:B2", "SUM(A1:2)", "A201", "AZ1", "SUM(C1:D4)", "A1 & B1",
    "(" * 33 + "A1" + ")" * 33, "A1" + "+1" * 600, "ABOVE + 1", "ABS(A1:B2)", "IF", "A1..2", "1A + A1",
])
def test_what_cannot_be_read_is_an_error(text):
    with pytest.raises(f.FormulaError):
        f.parse(text, (3, 4))


def test_a_batch_has_each_cell_once_and_at_most_two_hundred(cells):
    with pytest.raises(f.FormulaError):
        f.evaluate(cells, {"D3": "A1", "d3": "A2"}, "t", "r", "c", "v")
    with pytest.raises(f.FormulaError):
        f.evaluate(cells, {}, "t", "r", "c", "v")
    with pytest.raises(f.FormulaError):
        f.evaluate(cells, {f"{chr(65 + k % 26)}{1 + k // 26}": "Z200" for k in range(201)}, "t", "r", "c", "v")


@pytest.mark.parametrize("text,want", [
    ("a1 + b1 * 2", 9.0), ("(A1 + B1) * 2", 13.0), ("A1 - 1 - 1", 2.0), ("A1 / 2 / 2", 1.0), ("-A1 ^ 2", 16.0), ("2 ^ 3 ^ 2 + A1 * 0", 64.0), ("50% * A1", 2.0), ("A1%%", 0.0004), ("- -A1", 4.0),
    ("A1 > B1 = TRUE", 1.0), ("A1 >= 4", 1.0), ("A1 <> 4", 0.0), ("C1 + 1", 1.0), ("SUM(A1:B3)", 19.5), ("SUM(B3:A1)", 19.5), ("AVERAGE(A1:C1)", 3.25), ("COUNT(A1:D2)", 7.0), ("MAX(B1:B3)", 2.5),
    ("MIN(A1:D2, -9)", -9.0), ("PRODUCT(A1:B1, 2)", 20.0), ("PRODUCT(C1)", 0.0), ("MAX(C1)", 0.0), ("COUNT(C1, 5)", 1.0), ("SUM(C1, 5)", 5.0), ("SUM(ABOVE, LEFT)", 22.0), ("COUNT(LEFT)", 2.0), ("SUM(RIGHT)", 0.0),
    ("ROUND(B1, 0) + A1*0", 3.0), ("ROUND(-2.5 + A1 * 0, 0)", -3.0), ("ROUND(1234.5 + A1*0, -2)", 1200.0), ("INT(-7 / 2 + A1 * 0)", -3.0), ("MOD(-7 + A1 * 0, 3)", -1.0), ("SIGN(B2)", -1.0), ("NOT(A1)", 0.0), ("AND(A1, B1, C1)", 0.0), ("OR(C1, B1)", 1.0),
    ("IF(A1 > 5, A1 / 0, 7)", 7.0), (".5 * A1", 2.0), ("2. * A1", 8.0),
])
def test_values(cells, text, want):
    value, status = one(cells, text)
    assert status == "Exact" and value == pytest.approx(want)


@pytest.mark.parametrize("text,at,status", [
    ("A1 / C1", "D3", "DivisionByZero"), ("MOD(A1, C2)", "D3", "DivisionByZero"), ("AVERAGE(C1)", "D3", "DivisionByZero"), ("(0 - A1) ^ 0.5", "D3", "NotANumber"), ("10 ^ 400 * A1", "D3", "NotANumber"), ("A4", "D3", "OutsideTable"), ("SUM(A1:E1)", "D3", "OutsideTable"),
    ("A1", "D4", "OutsideTable"), ("A1", "D2", "Occupied"), ("1 + IF(A1, B1 / C2, 1)", "D3", "DivisionByZero"), ("SUM(A1, 1 / C2)", "D3", "DivisionByZero"), ("A1 / C1 + (0-A1) ^ 0.5", "D3", "DivisionByZero"),
])
def test_statuses(cells, text, at, status):
    assert one(cells, text, at) == (None, status)


def test_tables_of_other_sizes_and_replaced_cells(cells):
    got = {(r.t, r.cell): (r.result, r.status) for r in f.evaluate(cells, {"D2": "A1 * 2", "B1": "A1 + 1"}, "t", "r", "c", "v", replace=True).collect()}
    assert got == {("t", "D2"): (8.0, "Exact"), ("t", "B1"): (5.0, "Exact"), ("u", "D2"): (None, "OutsideTable"), ("u", "B1"): (4.0, "Exact")}


class Fault(Exception):
    pass


def finite(x):
    if isinstance(x, complex) or math.isnan(x) or math.isinf(x):
        raise Fault("NotANumber")
    return float(x)


GRID = {(r, c): v for _, r, c, v in CELLS}


def random_tree(rng, depth):
    """(text, function) of a random expression, the function by plain Python."""
    if depth == 0 or rng.random() < 0.15:
        if rng.random() < 0.4:
            n = rng.choice([0, 1, 2, 0.5, 3.25])
            return str(n), lambda: float(n)
        r, c = rng.choice([k for k in GRID if k != (3, 4)])
        return f"{chr(64 + c)}{r}", lambda: GRID[r, c] or 0.0
    kind = rng.randrange(5)
    (ta, a), (tb, b), (tc, c) = (random_tree(rng, depth - 1) for _ in range(3))
    if kind < 2:
        sign = rng.choice("+-*/")

        def both():
            x, y = a(), b()
            if sign == "/" and y == 0:
                raise Fault("DivisionByZero")
            return finite({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y}[sign]())

        return f"({ta} {sign} {tb})", both
    if kind == 2:
        sign = rng.choice(["<", ">", "<=", ">=", "=", "<>"])

        def compared():
            x, y = a(), b()
            return float({"<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y, "=": x == y, "<>": x != y}[sign])

        return f"({ta} {sign} {tb})", compared
    if kind == 3:
        return f"IF({ta}, {tb}, {tc})", lambda: b() if a() != 0 else c()
    name = rng.choice(["MAX", "MIN", "SUM", "AND", "OR"])
    if name in ("AND", "OR"):

        def truth():
            x = [a() != 0, b() != 0]
            return float(all(x) if name == "AND" else any(x))

        return f"{name}({ta}, {tb})", truth

    def over():
        x = [v for (r, c), v in GRID.items() if r <= 2 and c <= 3 and v is not None] + [a() + 0.0, b() + 0.0]
        return finite({"MAX": max, "MIN": min, "SUM": sum}[name](x))

    return f"{name}(A1:C2, ({ta}) + 0, ({tb}) + 0)", over


def test_random_trees_equal_plain_arithmetic(cells):
    rng = random.Random(11)
    batch = {f"{chr(65 + k % 26)}{10 + k // 26}": random_tree(rng, 4) for k in range(120)}
    batch = {at: x for at, x in batch.items() if len(x[0]) <= 900 and f._TOKEN.search(x[0]) and any(ch in x[0] for ch in "ABCD")}
    wide = cells.where("t = 't'").unionByName(cells.sparkSession.createDataFrame([("t", 200, 50, None)], "t string, r int, c int, v double"))
    readable = {}
    for at, (text, fn) in batch.items():
        try:
            f.parse(text, f.cell(at))
            readable[at] = (text, fn)
        except f.FormulaError:
            assert not any(ch.isdigit() and text[i - 1].isalpha() for i, ch in enumerate(text) if i)
    assert len(readable) > 60
    got = {r.cell: (r.result, r.status) for r in f.evaluate(wide, {at: t for at, (t, _) in readable.items()}, "t", "r", "c", "v").collect()}
    for at, (text, fn) in readable.items():
        try:
            want = (pytest.approx(fn(), rel=1e-9, abs=1e-9), "Exact")
        except Fault as e:
            want = (None, str(e))
        assert got[at] == want, text
