"""Explanations of refused boundaries, on small tables."""

import pytest
from pyspark.sql import functions as F

from tablewright.operators import explain, geometry, repair

#: Rows of cells; a number repeats over the places of one cell.
RASTERS = {
    "spans": [[0, 0, 1], [2, 3, 4], [5, 5, 6], [7, 8, 9]],
    "title": [[0, 1, 2], [3, 3, 3], [4, 5, 6], [7, 8, 9]],
    "many": [[c for c in range(7)]] + [[10 * r + 10 + min(c, 0 if c < 2 else c) for c in range(7)] for r in range(5)],
    "only titles": [[0, 1, 1], [2, 3, 3], [4, 5, 6]],
}
TEXTS = {("spans", 5): "Total of all farms in the northern hills", ("spans", 3): "  "}


@pytest.fixture(scope="module")
def explained(spark):
    slots = repair.kept(spark.createDataFrame([(n, r, c, x) for n, m in RASTERS.items() for r, row in enumerate(m) for c, x in enumerate(row)], "table_uid string, row_idx int, col_idx int, cell_id int"))
    cells = spark.createDataFrame([(n, x, TEXTS.get((n, x), f"c{x}")) for n, m in RASTERS.items() for x in {x for row in m for x in row}], "table_uid string, cell_id int, text string")
    targets = spark.createDataFrame([("spans", 1, 1), ("spans", 3, 0), ("spans", 1, 2), ("spans", 2, 0), ("spans", 9, 0), ("spans", None, 0), ("title", 2, 1), ("title", 0, 0), ("title", 4, 3), ("many", 1, 1), ("only titles", 0, 1)], "table_uid string, hmd int, vmd int")
    found = repair.marginal_counts(slots).withColumn("candidate_id", F.format_string("h%d_v%d", "hmd", "vmd")).withColumn("ord", F.col("hmd") * 10 + F.col("vmd"))
    rows = explain.explain(slots, cells, targets, found)
    return {(r["table_uid"], r["hmd"], r["vmd"]): r for r in rows.collect()}


def test_categories_and_words(explained):
    one = explained["spans", 1, 1]
    assert one["category"] == "boundary_cuts_merged_cell" and one["categories"] == ["boundary_cuts_merged_cell", "spanning_cell_in_last_header_row"]
    assert one["summary"] == (
        'H = 1, V = 1 is not a parser candidate. The line between the row-header columns and the data, left of column 1, runs through cell 5 "Total of all farms in the nort..." (row 2, columns 0-1) (rule 0). '
        'Row 0 is the last header row, so each of its cells must label a single column, but cell 0 "c0" (row 0, columns 0-1) spans several (rule 6).'
    )
    cell = one["violations"][0]["cells"][0]
    assert (cell["cell_id"], cell["empty"], cell["first_row"], cell["first_col"], cell["last_col"]) == (5, False, 2, 0, 1)
    assert explained["spans", 2, 0]["summary"] == "H = 2, V = 0 is candidate h2_v0." and explained["spans", 2, 0]["violations"] == []
    assert explained["spans", 9, 0]["category"] == "out_of_range" and explained["spans", 9, 0]["kept_hmd"] is None
    assert ("spans", None, 0) not in explained


def test_lines_without_evidence(explained):
    rows = explained["spans", 3, 0]["violations"][0]
    assert (rows["rule"], rows["rows"], rows["columns"], rows["count"]) == (2, [1], [], 1) and rows["cells"][0]["cell_id"] == 3 and rows["cells"][0]["empty"]
    assert rows["message"].endswith("nothing shows that it heads the header row below (rule 2). One of the cells there is empty.")
    columns = explained["spans", 1, 2]["violations"][0]
    assert (columns["rule"], columns["columns"], columns["count"], columns["cells"]) == (3, [0], 0, None)


def test_rows_set_aside(explained):
    """The title takes no part: a header that ends on it is read without it."""
    ends = explained["title", 2, 1]
    assert ends["category"] == "not_offered" and ends["set_aside"] == [1] and ends["kept_hmd"] == 1 and ends["violations"][0]["rows"] == [1] and ends["violations"][0]["rule"] is None
    assert ends["summary"].endswith("The header ends on row 1, which the parser sets aside because a single cell covers it; it reads the boundary as H = 1, V = 1, which is candidate h1_v1.")
    assert "The parser sets aside row 1 (covered by a single cell), so it checks 1 header row(s). " in ends["summary"]
    assert explained["title", 0, 0]["categories"] == ["no_headers_or_no_data"]
    assert explained["title", 4, 3]["violations"][0]["message"].startswith("This leaves no data: every row the parser keeps would be a header row and every column")
    assert [c["candidate_id"] for c in explained["title", 0, 0]["nearest"]] == ["h0_v1", "h1_v0", "h1_v1"]


def test_many_cells(explained):
    many = explained["many", 1, 1]["violations"][0]
    assert many["rule"] == 0 and many["count"] == 5 and len(many["cells"]) == 5 and "and 2 more (rule 0)" in many["message"]


def test_counts(spark):
    rows = spark.createDataFrame([("a", 1, 1, "x", [0, 6]), ("b", 1, 1, "x", [0]), ("c", 1, 0, "y", [])], "table_uid string, hmd int, vmd int, category string, rules array<int>")
    shown = rows.withColumn("violations", F.transform("rules", lambda r: F.struct(r.alias("rule"))))
    targets = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", None)], "table_uid string, hmd int").withColumn("vmd", F.lit(1))
    repaired = rows.select("table_uid", "hmd", "vmd", F.when(F.col("table_uid") == "a", "repaired").otherwise("refused").alias("status"))
    got = {tuple(r)[:3]: r["n"] for r in explain.explained_counts(shown, targets, repaired).collect()}
    assert got == {("explained", None, None): 3, ("excluded", None, None): 1, ("category", "x", None): 2, ("category", "y", None): 1, ("rule", "0", None): 2, ("rule", "6", None): 1, ("repair", "x", "repaired"): 1, ("repair", "x", "refused"): 1, ("repair", "y", "refused"): 1}


def test_witnesses_agree_with_the_rules(spark):
    import random

    rng = random.Random(3)
    rasters = {f"r{k}": [[rng.randrange(5) for _ in range(c)] for _ in range(r)] for k, (r, c) in enumerate((rng.randrange(1, 5), rng.randrange(1, 5)) for _ in range(50))}
    slots = spark.createDataFrame([(n, r, c, x) for n, m in rasters.items() for r, row in enumerate(m) for c, x in enumerate(row)], "table_uid string, row_idx int, col_idx int, cell_id int")
    targets = spark.createDataFrame([(n, h, v) for n, m in rasters.items() for h in range(len(m) + 1) for v in range(len(m[0]) + 1)], "table_uid string, hmd int, vmd int")
    found = {tuple(r)[:3]: r for r in repair.witnesses(slots, targets).collect()}
    for r in geometry.rule_checks(slots, targets).collect():
        w = found[r["table_uid"], r["hmd"], r["vmd"]]
        got = [bool(w[f"cells_{n}"]) if n in (0, 1, 4, 5, 6, 9) else bool(w["rows_2"]) if n == 2 else bool(w["columns_3"]) if n == 3 else w["no_header"] if n == 7 else w["no_rows"] or w["no_columns"] for n in range(10)]
        assert got == [r[f"rule_{n}"] for n in range(10)]
