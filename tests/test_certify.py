"""Certificates: every line of a table under a header path of its own."""

import pytest

from tablewright.operators import certify

RASTERS = {
    "plain": [[0, 1], [2, 3], [4, 5]],
    "levels": [[0, 1, 1], [2, 3, 4], [5, 6, 7]],
    "shared": [[0, 1, 1], [2, 3, 4]],
    # the second row's middle cell is under two others: six paths for four columns
    "overlap": [[0, 0, 1, 1], [2, 3, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12]],
    "tall": [[0, 1], [0, 2], [3, 4]],
    "odd": [[0, 0], [0, 1], [2, 3]],
    "deep": [[0, 1, 2], [0, 3, 3], [0, 4, 5], [6, 7, 8]],
}


@pytest.fixture(scope="module")
def certified(spark):
    slots = spark.createDataFrame([(n, r, c, x) for n, m in RASTERS.items() for r, row in enumerate(m) for c, x in enumerate(row)], "table_uid string, row_idx int, col_idx int, cell_id int")
    targets = spark.createDataFrame([(n, h, v) for n, m in RASTERS.items() for h in range(len(m) + 1) for v in range(len(m[0]) + 1)], "table_uid string, hmd int, vmd int")
    return slots, targets, {tuple(r)[:3]: tuple(r)[3:] for r in certify.certify(slots, targets).collect()}


def test_claims_and_reasons(certified):
    got = certified[2]
    assert got["plain", 1, 0] == ("columns", None, None) and got["plain", 0, 1] == ("rows", certify.NO_HEADER, None)
    assert got["plain", 0, 0] == (None, certify.NO_HEADER, certify.NO_HEADER) and got["plain", 3, 0][1] == certify.OUT_OF_RANGE == got["plain", 3, 0][2]
    assert got["levels", 2, 0] == ("columns", None, None) and got["levels", 1, 0] == (None, certify.SHARED_PATH, certify.NO_HEADER)
    assert got["shared", 1, 1] == ("rows", certify.SHARED_PATH, None)
    assert got["overlap", 3, 0] == (None, certify.MORE_PATHS, certify.NO_HEADER) and got["overlap", 3, 1][0] == "rows"
    assert got["tall", 1, 0] == (None, certify.CROSSES_HMD, certify.CROSSES_HMD) and got["levels", 0, 2] == (None, certify.CROSSES_VMD, certify.CROSSES_VMD)
    assert {w[1] for k, w in got.items() if k[0] == "odd"} == {certify.NOT_RECTANGLE}


def test_path_counts_equal_enumeration(certified):
    slots, targets, _ = certified

    def enumerate_paths(m, h, v):
        edges = {(m[r][c], m[r + 1][c]) for r in range(h - 1) for c in range(v, len(m[0])) if m[r][c] != m[r + 1][c]}
        walk = lambda x: sum(walk(b) for a, b in edges if a == x) or 1
        return sum(walk(x) for x in set(m[0][v:]))

    tables = {n: m for n, m in RASTERS.items() if n != "odd"}
    asked = targets.where("table_uid <> 'odd'")
    got = {tuple(r)[:3]: r["n_paths"] for r in certify.header_path_counts(slots, asked).collect()}
    assert got == {(n, h, v): enumerate_paths(m, h, v) for n, m in tables.items() for h in range(1, len(m) + 1) for v in range(len(m[0])) if h <= len(m)}
    assert certify.header_path_counts(slots, asked.where("hmd = 0")).count() == 0


def test_counts_saturate(spark, monkeypatch):
    """Cells over two columns, each row shifted by one: the paths double with every row."""
    rows, width = 12, 40
    slots = spark.createDataFrame([("t", r, c, 1000 * r + (c + r % 2) // 2) for r in range(rows) for c in range(width)], "table_uid string, row_idx int, col_idx int, cell_id int")
    target = spark.createDataFrame([("t", rows, 0)], "table_uid string, hmd int, vmd int")
    assert certify.header_path_counts(slots, target).first()["n_paths"] > 10_000
    monkeypatch.setattr(certify, "MOST_PATHS", 100)
    assert certify.header_path_counts(slots, target).first()["n_paths"] == 100
