"""Blank cells joined to labels: evidence, refusals, rounds, chains of merges, re-checks."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import repair

#: Tables drawn as rows of texts; a text that begins with < or ^ goes on the cell left of or above it.
TABLES = {
    "repeats": (1, 2, ["Farm", "Crop", "Tons"], ["North", "oats", "1"], ["", "rye", "2"], ["South", "oats", "3"], ["", "rye", "4"]),
    "no repeat": (1, 2, ["Farm", "Crop", "Tons"], ["North", "oats", "1"], ["", "rye", "2"], ["South", "oats", "3"], ["", "hay", "4"]),
    "three rows": (1, 2, ["Farm", "Crop", "Tons"], ["North", "oats", "1"], ["", "rye", "2"], ["", "hay", "3"], ["South", "OATS", "4"], ["", "Rye", "5"], ["", "hay", "6"]),
    "blank on top": (1, 2, ["Farm", "Crop", "Tons"], ["", "oats", "1"], ["North", "rye", "2"], ["", "oats", "3"], ["South", "rye", "4"], ["", "oats", "5"]),
    "under a title": (1, 2, ["Farm", "Crop", "Tons"], ["Fields", "<", "<"], ["", "oats", "1"], ["", "rye", "2"]),
    "parent splits": (1, 3, ["Farm", "Field", "Crop", "Tons"], ["North", "", "oats", "1"], ["South", "", "rye", "2"], ["West", "", "hay", "3"]),
    "header": (2, 1, ["", "Oats", "", "Rye", ""], ["Farm", "tons", "euro", "tons", "euro"], ["North", "1", "2", "3", "4"]),
    "header apart": (2, 1, ["Farm", "Oats", "Rye", "", ""], ["", "tons", "euro", "rank", "note"], ["North", "1", "2", "3", "4"]),
    "header blank": (2, 0, ["", "Oats", "", "Rye"], ["Farm", "a", "b", "c"], ["North", "1", "2", "3"]),
    "group row": (1, 1, ["Farm", "Crop", "Tons"], ["Fields", "<", ""], ["North", "oats", "1"], ["South", "rye", "2"]),
    "group text": (1, 1, ["Farm", "Crop", "Tons"], ["Fields", "<", "9"], ["North", "oats", "1"], ["South", "rye", "2"]),
    "stuck": (1, 2, ["Farm", "Crop", "Tons"], ["North", "oats", "1"], ["", "rye", "2"], ["South", "oats", "3"], ["", "rye", "4"], ["West", "none", "<"]),
    "offered": (1, 1, ["Farm", "Crop", "Tons"], ["North", "oats", "1"], ["South", "rye", "2"]),
    "outside": (9, 9, ["a", "b"], ["c", "d"]),
    "levels": (1, 3, ["Land", "Farm", "Crop", "Tons"], ["Hill", "North", "oats", "1"], ["", "", "rye", "2"], ["", "South", "oats", "3"], ["", "", "rye", "4"], ["Vale", "North", "oats", "5"], ["", "", "rye", "6"], ["", "South", "oats", "7"], ["", "", "rye", "8"]),
}
STATUS = {
    "repeats": "repaired", "no repeat": "refused", "three rows": "repaired", "blank on top": "refused", "under a title": "not_applicable", "parent splits": "not_applicable",
    "header": "repaired", "header apart": "refused", "header blank": "refused", "group row": "repaired", "stuck": "not_repaired", "group text": "not_applicable", "offered": "already_offered", "levels": "repaired",
}


@pytest.fixture(scope="module")
def tables(spark):
    slots, cells, targets = [], [], []
    for name, (h, v, *rows) in TABLES.items():
        ids, n = {}, 0
        for r, row in enumerate(rows):
            for c, text in enumerate(row):
                if text == "<" or text == "^":
                    ids[r, c] = ids[(r, c - 1) if text == "<" else (r - 1, c)]
                else:
                    ids[r, c], n = n, n + 1
                    cells.append((name, ids[r, c], text))
                slots.append((name, r, c, ids[r, c]))
        targets.append((name, h, v))
    return (
        spark.createDataFrame(slots, "table_uid string, row_idx int, col_idx int, cell_id int"), spark.createDataFrame(cells, "table_uid string, cell_id int, text string"),
        spark.createDataFrame(targets, "table_uid string, hmd int, vmd int"),
    )


@pytest.fixture(scope="module")
def mended(tables):
    return tuple(map(repair.kept, repair.repairs(*tables)))


def merges_of(made, name):
    return [(r["cell_id"], r["into"], r["direction"]) for r in made.where(F.col("table_uid") == name).orderBy("n").collect()]


def test_status_of_every_table(mended):
    got = {r["table_uid"]: (r["status"], r["matched"]) for r in mended[0].collect()}
    assert {n: s for n, (s, _) in got.items()} == STATUS
    assert got["repeats"][1] == got["header"][1] == "boundary" and got["group row"][1] == "layout" and got["no repeat"][1] is None and "outside" not in got


def test_merges_and_their_order(mended):
    made = mended[1]
    assert merges_of(made, "repeats") == [(6, 3, "up"), (12, 9, "up")]
    assert merges_of(made, "three rows") == [(6, 3, "up"), (9, 3, "up"), (15, 12, "up"), (18, 12, "up")]
    assert merges_of(made, "header") == [(2, 1, "left"), (4, 3, "left")]
    assert merges_of(made, "group row") == [(4, 3, "left")]
    # both columns in one round, the parent column first
    assert merges_of(made, "levels") == [(8, 4, "up"), (12, 4, "up"), (16, 4, "up"), (24, 20, "up"), (28, 20, "up"), (32, 20, "up"), (9, 5, "up"), (17, 13, "up"), (25, 21, "up"), (33, 29, "up")]
    one = made.where("table_uid = 'repeats' AND cell_id = 6").first()
    assert (one["first_row"], one["last_row"], one["first_col"], one["last_col"]) == (2, 2, 0, 0)


def test_refusals(mended):
    got = {}
    for r in mended[2].orderBy("table_uid", "n").collect():
        got.setdefault(r["table_uid"], []).append((r["line"], r["index"], r["into"], r["cells"], r["reason"]))
    assert got["no repeat"] == [("column", 0, 3, [6], repair.NOT_REPEATED), ("column", 0, 9, [12], repair.NOT_REPEATED)]
    assert got["blank on top"] == [("column", 0, None, [9, 15], repair.NO_LABEL_ON_TOP)]
    assert got["header apart"] == [("row", 0, 2, [3, 4], repair.NOT_REPEATED)]
    assert got["header blank"] == [("row", 0, None, [2], repair.NO_LABEL_ON_TOP)]
    assert set(got) == {"no repeat", "blank on top", "header apart", "header blank"}


def test_mended_tables(tables, mended):
    slots, cells, _ = tables
    after = repair.merged_slots(slots, mended[1]).where("table_uid = 'repeats'").orderBy("row_idx", "col_idx").collect()
    assert [r["cell_id"] for r in after] == [0, 1, 2, 3, 4, 5, 3, 7, 8, 9, 10, 11, 9, 13, 14]
    assert repair.merged_cells(cells, mended[1]).where("table_uid = 'repeats'").count() == 13


def test_chains_of_merges(spark):
    slots = spark.createDataFrame([("t", 0, c, c) for c in range(9)], "table_uid string, row_idx int, col_idx int, cell_id int")
    chain = spark.createDataFrame([("t", c, c - 1) for c in range(1, 9)], "table_uid string, cell_id int, into int")
    assert {r["cell_id"] for r in repair.merged_slots(slots, chain).collect()} == {0}
    assert repair.merged_slots(slots, chain.limit(0)).count() == 9
    with pytest.raises(ValueError):
        repair.merged_slots(slots, spark.createDataFrame([("t", 1, 2), ("t", 2, 1)], "table_uid string, cell_id int, into int"))


def test_rechecks(mended):
    made = mended[1]
    assert repair.recheck(made, made).isEmpty()
    edited = made.withColumn("into", F.when((F.col("table_uid") == "header") & (F.col("cell_id") == 4), 1).otherwise(F.col("into"))).where("NOT (table_uid = 'repeats' AND cell_id = 12)")
    assert sorted(tuple(r) for r in repair.recheck(edited, made).collect()) == [("header", 1, 1), ("repeats", 0, 1)]


def test_decisions(spark, mended):
    decided = spark.createDataFrame([("repeats", "unparseable", None), ("no repeat", "unparseable", None), ("offered", "valid", "h1_v1"), ("header", "unreviewed", None)], "table_uid string, final_status string, candidate_id string")
    got = {r["table_uid"]: tuple(r)[1:] for r in repair.decided_by_repair(decided, mended[0]).collect()}
    assert got == {"repeats": ("valid", "repaired/h1_v2", "repair"), "no repeat": ("unparseable", None, "answer"), "offered": ("valid", "h1_v1", "answer"), "header": ("unreviewed", None, "answer")}
