"""Formulas in table cells: read once into a tree, computed for all tables as columns.

An expression has numbers, cells (``B3``), ranges inside functions (``A1:C4``), the signs ``+ - * / ^ %``,
comparisons, TRUE and FALSE, and the functions of ``FUNCTIONS``; the directions ABOVE, BELOW, LEFT and RIGHT, one or two
of them, name the cells that lie that way from the formula's own cell. ``%`` behind a value is a hundredth; a sign before a value
binds more tightly than ``^``, and operators of one rank are taken from the left.

Every cell or range that a batch of formulas names becomes one conditional aggregate, so all tables take one
grouping, summed up before the shuffle, whatever the number of formulas; tables of any number of rows are never gathered.

A cell without a number is 0 in arithmetic and doesn't count in a range. What can't be computed has a status and
no value: ``DivisionByZero``, ``NotANumber`` (a power or overflow without a finite value), ``OutsideTable`` (the formula's cell or one that it
names isn't in that table) and ``Occupied`` (its cell holds a number and ``replace`` isn't set). Only the branch that IF takes can fail it.
Formulas of a batch don't see each other's results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .template import cell

# What an expression may hold at most.
MOST_ROWS, MOST_COLUMNS, MOST_CHARS, MOST_DEPTH, MOST_FORMULAS = 200, 50, 1000, 32, 200
DIRECTIONS = ("ABOVE", "BELOW", "LEFT", "RIGHT")
OVER_CELLS = ("SUM", "AVERAGE", "COUNT", "MAX", "MIN", "PRODUCT")
#: Functions of values, and how many they take (at least, at most).
FUNCTIONS = {"ABS": (1, 1), "AND": (2, 16), "IF": (3, 3), "INT": (1, 1), "MOD": (2, 2), "NOT": (1, 1), "OR": (2, 16), "ROUND": (2, 2), "SIGN": (1, 1)}
_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d*)?|\.\d+)|(?P<name>[A-Za-z]+(?![A-Za-z0-9_]))|(?P<cell>[A-Za-z]{1,2}[1-9][0-9]{0,2}(?![A-Za-z0-9_]))|(?P<sign><=|>=|<>|[-+*/^%(),:<>=]))")
#: Signs between two values by rank, the loosest first.
RANKS = (("=", "<>", "<", "<=", ">", ">="), ("+", "-"), ("*", "/"), ("^",))


class FormulaError(ValueError):
    """A formula that can't be read."""


@dataclass(frozen=True)
class Node:
    """A tree: ``op`` is number, cell, area, direction, a sign, or a function; ``parts`` are its trees, or its number or place."""

    op: str
    parts: tuple = ()


def tokens(text: str) -> list[tuple[str, str]]:
    """(kind, token) of an expression."""
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        if not (m := _TOKEN.match(text, at)):
            raise FormulaError(f"{text[at:at + 10]!r} can't be read")
        out.append((m.lastgroup, m[m.lastgroup].upper()))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str):
        self.left, self.depth = tokens(text), 0

    def next(self) -> tuple[str, str]:
        return self.left[0] if self.left else ("end", "")

    def take(self, *signs: str) -> str | None:
        kind, token = self.next()
        return self.left.pop(0)[1] if kind == "sign" and token in signs else None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise FormulaError(f"{sign!r} is missing before {self.next()[1]!r}")

    def value(self, rank: int = 0) -> Node:
        if rank == len(RANKS):
            return self.one()
        out = self.value(rank + 1)
        while sign := self.take(*RANKS[rank]):
            out = Node(sign, (out, self.value(rank + 1)))
        return out

    def one(self) -> Node:
        if sign := self.take("-", "+"):
            out = Node("0" + sign, (self.one(),))
        else:
            out = self.plain()
            while self.take("%"):
                out = Node("%", (out,))
        return out

    def plain(self) -> Node:
        kind, token = self.next()
        if self.take("("):
            self.deeper()
            out = self.value()
            self.need(")")
            self.depth -= 1
            return out
        if kind in ("end", "sign"):
            raise FormulaError(f"a value is missing before {token!r}")
        self.left.pop(0)
        if kind == "number":
            return Node("number", (float(token),))
        if kind == "cell":
            return Node("cell", _bounded(token))
        if token in ("TRUE", "FALSE"):
            return Node("number", (float(token == "TRUE"),))
        if token not in FUNCTIONS and token not in OVER_CELLS:
            raise FormulaError(f"{token} is no function")
        self.need("(")
        self.deeper()
        parts = [self.argument(token)]
        while self.take(","):
            parts.append(self.argument(token))
        self.need(")")
        self.depth -= 1
        least, most = FUNCTIONS.get(token, (1, 64))
        if not least <= len(parts) <= most:
            raise FormulaError(f"{token} takes {least} to {most} values")
        ways = [p.parts[0] for p in parts if p.op == "direction"]
        if ways and (len(ways) != len(parts) or len(ways) > 2 or len(set(ways)) < len(ways)):
            raise FormulaError("a function takes one or two different directions and nothing else beside them")
        return Node(token, tuple(parts))

    def argument(self, function: str) -> Node:
        kind, token = self.next()
        if function in OVER_CELLS:
            if kind == "name" and token in DIRECTIONS:
                self.left.pop(0)
                return Node("direction", (token,))
            if kind == "cell" and self.left[1:2] == [("sign", ":")]:
                del self.left[:2]
                kind, last = self.next()
                if kind != "cell":
                    raise FormulaError("a range ends with a cell")
                self.left.pop(0)
                (r0, c0), (r1, c1) = _bounded(token), _bounded(last)
                return Node("area", (min(r0, r1), min(c0, c1), max(r0, r1), max(c0, c1)))
        return self.value()

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise FormulaError(f"parentheses are nested more than {MOST_DEPTH} deep")


def _bounded(ref: str) -> tuple[int, int]:
    row, column = cell(ref)
    if row > MOST_ROWS or column > MOST_COLUMNS:
        raise FormulaError(f"{ref} lies beyond {MOST_ROWS} rows or {MOST_COLUMNS} columns")
    return row, column


def references(node: Node) -> list[tuple[int, int, int, int]]:
    """The areas (first row, first column, last row, last column) that a tree names."""
    if node.op == "cell":
        return [node.parts * 2]
    if node.op == "area":
        return [node.parts]
    return [r for p in node.parts if isinstance(p, Node) for r in references(p)]


def _has(node: Node, op: str) -> bool:
    return node.op == op or any(isinstance(p, Node) and _has(p, op) for p in node.parts)


def parse(text: str, at: tuple[int, int]) -> Node:
    """The tree of a formula in the cell ``at`` (row, column); what can't be read or names its own cell or none is an error."""
    text = text.strip().removeprefix("=").strip()
    if not 1 <= len(text) <= MOST_CHARS:
        raise FormulaError(f"a formula has 1 to {MOST_CHARS} characters")
    reader = _Reader(text)
    tree = reader.value()
    if reader.left:
        raise FormulaError(f"{reader.next()[1]!r} is one too many")
    areas = references(tree)
    if not areas and not _has(tree, "direction"):
        raise FormulaError("a formula names at least one cell")
    if any(a <= at[0] <= c and b <= at[1] <= d for a, b, c, d in areas):
        raise FormulaError("a formula can't name its own cell")
    return tree


class _Sheet:
    """The aggregates that trees need, each area and measure once, and the steps over them: equal subtrees are one column."""

    def __init__(self, row: str, column: str, value: str):
        self.row, self.column, self.number = F.col(row), F.col(column), F.col(value).cast("double")
        self.aggregates: dict[str, Column] = {}
        self.steps: list[dict[str, Column]] = []
        self.known: dict[tuple, tuple[Column, Column, int]] = {}

    def measure(self, kind: str, area: tuple) -> Column:
        a, b, c, d = area
        inside = self.row.between(a, c) & self.column.between(b, d)
        fold = {"SUM": F.sum, "COUNT": F.count, "MAX": F.max, "MIN": F.min, "PRODUCT": F.product}[kind]
        name = f"{kind.lower()}_{a}_{b}_{c}_{d}"
        self.aggregates[name] = fold(F.when(inside, self.number)).alias(name)
        return F.col(name)

    def tree(self, node: Node, at: tuple[int, int]) -> tuple[Column, Column, int]:
        """(value, error, height): a tree's columns, which the step of its height computes from those below."""
        key = (node, at if _has(node, "direction") else None)
        if key not in self.known:
            below = [self.tree(p, at) for p in node.parts if isinstance(p, Node) and p.op not in ("area", "direction")]
            height = 1 + max((h for _, _, h in below), default=-1)
            value, error = compiled(node, self, at, [x[:2] for x in below])
            if height >= len(self.steps):
                self.steps.append({})
            k = len(self.known)
            self.steps[height] |= {f"v{k}": value, f"e{k}": error}
            self.known[key] = (F.col(f"v{k}"), F.col(f"e{k}"), height)
        return self.known[key]


def _sided(way: str, at: tuple[int, int]) -> tuple[int, int, int, int]:
    r, c = at
    far = 1 << 30
    return {"ABOVE": (1, c, r - 1, c), "BELOW": (r + 1, c, far, c), "LEFT": (r, 1, r, c - 1), "RIGHT": (r, c + 1, r, far)}[way]


def _first(*errors: Column) -> Column:
    return F.coalesce(*errors) if errors else F.lit(None).cast("string")


def _finite(value: Column, error: Column) -> tuple[Column, Column]:
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(error.isNull() & ~bad, value), F.coalesce(error, F.when(bad, F.lit("NotANumber")))


def compiled(node: Node, sheet: _Sheet, at: tuple[int, int], each: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """(value, error) of a tree from those of its parts; true is 1, false 0, the value of an error is null."""
    fine = F.lit(None).cast("string")
    if node.op == "number":
        return F.lit(node.parts[0]), fine
    if node.op == "cell":
        return F.coalesce(sheet.measure("SUM", node.parts * 2), F.lit(0.0)), fine
    if node.op in OVER_CELLS:
        return _over_cells(node, sheet, at, each)
    values, error = [v for v, _ in each], _first(*[e for _, e in each])
    as_number = lambda c: c.cast("double")
    if node.op == "IF":
        chosen = values[0] != 0
        return F.when(chosen, values[1]).otherwise(values[2]), _first(each[0][1], F.when(chosen, each[1][1]).otherwise(each[2][1]))
    if node.op in ("/", "MOD"):
        zero = values[1] == 0
        error = _first(error, F.when(zero, F.lit("DivisionByZero")))
        by = F.when(~zero, values[1])
        return _finite(values[0] / by if node.op == "/" else values[0] % by, error)
    simple = {
        "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "^": F.pow, "0-": lambda a: -a, "0+": lambda a: a, "%": lambda a: a / 100.0,
        "=": lambda a, b: as_number(a == b), "<>": lambda a, b: as_number(a != b), "<": lambda a, b: as_number(a < b), "<=": lambda a, b: as_number(a <= b),
        ">": lambda a, b: as_number(a > b), ">=": lambda a, b: as_number(a >= b), "ABS": F.abs, "SIGN": F.signum, "NOT": lambda a: as_number(a == 0),
        "INT": lambda a: F.signum(a) * F.floor(F.abs(a)).cast("double"), "ROUND": _rounded,
        "AND": lambda *v: as_number(reduce(lambda a, b: a & b, [x != 0 for x in v])), "OR": lambda *v: as_number(reduce(lambda a, b: a | b, [x != 0 for x in v])),
    }
    value = simple[node.op](*values)
    return _finite(value, error) if node.op in ("+", "-", "*", "^", "ROUND") else (F.when(error.isNull(), value), error)


def _rounded(value: Column, digits: Column) -> Column:
    """Rounded to so many digits, halves away from zero."""
    scale = F.pow(F.lit(10.0), F.signum(digits) * F.floor(F.abs(digits)).cast("double"))
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5).cast("double") / scale


def _over_cells(node: Node, sheet: _Sheet, at: tuple[int, int], each: list[tuple[Column, Column]]) -> tuple[Column, Column]:
    """SUM, AVERAGE, COUNT, MAX, MIN or PRODUCT of areas, directions and values; a single cell counts as an area."""
    areas = [p.parts * 2 if p.op == "cell" else p.parts if p.op == "area" else _sided(p.parts[0], at) for p in node.parts if p.op in ("cell", "area", "direction")]
    each = [x for p, x in zip([p for p in node.parts if p.op not in ("area", "direction")], each) if p.op != "cell"]
    values, error = [v for v, _ in each], _first(*[e for _, e in each])
    kind = node.op
    n = reduce(lambda a, b: a + b, [sheet.measure("COUNT", a) for a in areas], F.lit(float(len(values))))
    if kind == "COUNT":
        return F.when(error.isNull(), n.cast("double")), error
    total = lambda k, start, join: reduce(join, [F.coalesce(sheet.measure(k, a), F.lit(start)) for a in areas] + values, F.lit(start))
    if kind in ("SUM", "AVERAGE"):
        value = total("SUM", 0.0, lambda a, b: a + b)
        if kind == "AVERAGE":
            error = _first(error, F.when(n == 0, F.lit("DivisionByZero")))
            value = value / F.when(n != 0, n)
    elif kind == "PRODUCT":
        value = F.when(n == 0, 0.0).otherwise(total("PRODUCT", 1.0, lambda a, b: a * b))
    else:
        found = [sheet.measure(kind, a) for a in areas] + values
        pick = F.greatest if kind == "MAX" else F.least
        value = F.coalesce(pick(*found) if len(found) > 1 else found[0], F.lit(0.0))
    return _finite(value, error)


def evaluate(cells: DataFrame, formulas: dict[str, str], table: str, row: str, column: str, value: str, replace: bool = False) -> DataFrame:
    """(table, cell, result, status) of every formula, given by its cell such as D2, in every table of cells (table, row, column, value)."""
    if not 1 <= len(formulas) <= MOST_FORMULAS:
        raise FormulaError(f"a batch has 1 to {MOST_FORMULAS} formulas")
    places = {name: _bounded(name.upper()) for name in formulas}
    if len(set(places.values())) < len(places):
        raise FormulaError("two formulas have the same cell")
    sheet, rows = _Sheet(row, column, value), []
    height, width = F.col("height"), F.col("width")
    for name, at in places.items():
        tree = parse(formulas[name], at)
        result, error, _ = sheet.tree(tree, at)
        own = sheet.measure("COUNT", at * 2)
        beyond = reduce(lambda a, b: a | b, [(height < c) | (width < d) for _, _, c, d in [*references(tree), at * 2]])
        status = F.when(beyond, "OutsideTable").when((own > 0) & F.lit(not replace), "Occupied").otherwise(F.coalesce(error, F.lit("Exact")))
        rows.append(F.struct(F.lit(name.upper()).alias("cell"), F.when(status == "Exact", result).alias("result"), status.alias("status")))
    sized = cells.groupBy(table).agg(F.max(row).alias("height"), F.max(column).alias("width"), *sheet.aggregates.values())
    for step in sheet.steps:
        sized = sized.withColumns(step)
    return sized.select(table, F.inline(F.array(*rows)))
