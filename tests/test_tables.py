"""Table grids against a row-by-row machine, and the faults of a table made by hand."""

import random

import pytest

from foliospark.operators import tables

ROWS, CELLS = "table long, row long, grid_before int, grid_after int, header boolean", "table long, row long, cell long, span long, merge string"


def machine(rows, cells):
    """(issues, chains) of one table by a machine that goes through its rows and keeps the open chains."""
    out, done, active = [], {}, {}
    for _, row, before, _, _ in rows:
        at, kept = max(0, before), {}
        for _, r, cell, span, merge in cells:
            if r != row:
                continue
            end = at + (span if span is not None and 1 <= span <= 63 else 1)
            if merge == "restart":
                active.pop((at, end), None)
                kept[at, end] = row
                done[at, end, row] = 1
            elif merge == "continue":
                if (at, end) in active:
                    kept[at, end] = active[at, end]
                    done[at, end, active[at, end]] += 1
                else:
                    near = any(a < end and at < e for a, e in active)
                    out.append((row, cell, "VERTICAL_MERGE_SPAN_MISMATCH" if near else "VERTICAL_MERGE_ORPHAN_CONTINUATION"))
            at = end
        active = kept
    return sorted(out), {k: n for k, n in done.items()}


def test_merges_equal_a_row_by_row_machine(spark):
    rng = random.Random(12)
    rows, cells = [], []
    for t in range(40):
        for r in range(rng.randint(1, 8)):
            rows.append((t, r, rng.choice([0, 0, 0, 1, -2]), 0, False))
            for c in range(rng.randint(0, 5)):
                cells.append((t, r, c, rng.choice([1, 1, 1, 2, 3, 0, 99, None]), rng.choice(["restart", "continue", "continue", None])))
    placed = tables.placed_cells(spark.createDataFrame(rows, ROWS), spark.createDataFrame(cells, CELLS))
    chained = tables.merge_chains(placed).cache()
    found = [tuple(r) for r in tables.unchained(chained).collect()]
    held = {(r.table, r.start_col, r.end_col, r.first_row): r.n_cells for r in tables.chains(chained).collect()}
    for t in range(40):
        issues, chains = machine([r for r in rows if r[0] == t], [c for c in cells if c[0] == t])
        assert sorted((r, c, i) for x, r, c, i in found if x == t) == issues
        assert {k[1:]: n for k, n in held.items() if k[0] == t} == chains


def test_faults_of_a_table(spark):
    rows = spark.createDataFrame([(1, 0, 0, 0, False), (1, 1, 0, 0, False), (1, 2, 3, 0, True), (1, 3, -1, -1, False), (1, 4, 1, 1, False), (2, 0, 0, 0, True), (2, 1, 0, 0, True), (2, 2, 0, 9, False)], ROWS)
    cells = spark.createDataFrame([(1, 0, 0, 2, "restart"), (1, 1, 0, 1, "continue"), (1, 1, 1, 0, None), (1, 2, 0, 1, None), (1, 3, 0, 1, "continue"), (2, 0, 0, 5, None)], CELLS)
    got = sorted((r.table, r.row, r.cell, r.issue) for r in tables.issues(spark.createDataFrame([(1, 2), (2, 0)], "table long, grid_columns int"), rows, cells).fillna(-1, ["cell"]).collect())
    assert got == sorted([
        (1, 1, 0, "VERTICAL_MERGE_SPAN_MISMATCH"), (1, 1, 1, "GRID_SPAN_INVALID"), (1, 2, -1, "HEADER_NOT_CONTIGUOUS"), (1, 2, -1, "ROW_GRID_OVERFLOW"), (1, 2, -1, "ROW_GRID_SKIP_OUT_OF_RANGE"),
        (1, 3, -1, "GRID_BEFORE_INVALID"), (1, 3, -1, "GRID_AFTER_INVALID"), (1, 3, 0, "VERTICAL_MERGE_ORPHAN_CONTINUATION"), (1, 3, -1, "ROW_GRID_UNDERFLOW"),
    ])


@pytest.mark.parametrize("span,end", [(1, 1), (63, 63), (64, 1), (0, 1), (-1, 1), (None, 1)])
def test_spans_out_of_bounds_count_as_one(spark, span, end):
    row = tables.placed_cells(spark.createDataFrame([(1, 0, 0, 0, False)], ROWS), spark.createDataFrame([(1, 0, 0, span, None)], CELLS)).first()
    assert (row.start_col, row.end_col) == (0, end)
