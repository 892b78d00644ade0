"""Layouts: rows set aside, headers in the middle, several subtables."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.operators import export, geometry, layouts, review, scoring

#: Rasters drawn with a letter for each cell; a cell of several places repeats its letter.
TABLES = {
    "grid": ["abc", "def", "ghi"],
    "refused": ["aab", "cdd", "efg"],
    "sections": ["aaaa", "bcde", "ffff", "ghij", "klmn"],
    "data title": ["abcd", "efgh", "ijjj", "klmn", "opqr"],
    "second band": ["abcd", "efgh", "ijkk", "lmno", "pqrs"],
    "second column": ["abcd", "efgh", "ijgk", "lmno"],
    "both": ["abcde", "fghij", "kmhno", "pqqrr", "stuvw", "xyzAB"],
    "two bands": ["abcd", "efgh", "ijjk", "lmno", "pqrs", "tuvv", "wxyz", "ABCD"],
    "no data left": ["abcd", "efgh", "ijjk"],
    "one column": ["a", "b", "c"],
}
EXPECTED = {
    "grid": ["vdd/vdd/vdd", "hhh/ddd/ddd", "hhh/vdd/vdd"],
    "refused": [],
    "sections": ["ssss/vddd/ssss/vddd/vddd", "ssss/hhhh/ssss/dddd/dddd", "ssss/hhhh/ssss/vddd/vddd"],
    # without a header column the title begins a band of two header rows; with one it is set aside
    "data title": ["hhhh/dddd/hhhh/hhhh/dddd", "hhhh/dddd/dddd/dddd/dddd", "hhhh/vddd/ssss/vddd/vddd"],
    "second band": ["hhhh/dddd/hhhh/hhhh/dddd", "hhhh/vddd/hhhh/hhhh/vddd", "hhhh/dddd/dddd/dddd/dddd", "hhhh/vddd/vddd/vddd/vddd"],
    "second column": ["hhhh/ddvd/ddvd/ddvd", "hhhh/vdvd/vdvd/vdvd", "hhhh/dddd/dddd/dddd", "hhhh/vddd/vddd/vddd"],
    "no data left": ["hhhh/dddd/dddd", "hhhh/vddd/vddd"],
    "one column": ["h/d/d"],
}


def raster(drawn):
    ids = {}
    return [[ids.setdefault(x, len(ids)) for x in row] for row in drawn]


def slots_of(spark, tables):
    rows = [(n, r, c, x) for n, m in tables.items() for r, row in enumerate(m) for c, x in enumerate(row)]
    return spark.createDataFrame(rows, "table_uid string, row_idx int, col_idx int, cell_id int")


@pytest.fixture(scope="module")
def found(spark):
    all_ = layouts.kept(slots_of(spark, {n: raster(t) for n, t in TABLES.items()}))
    return all_, layouts.kept(layouts.table_candidates(all_))


def drawn_labels(all_, candidates):
    named = layouts.layout_labels(all_, candidates).join(candidates.select("table_uid", "candidate_id", "ord"), ["table_uid", "candidate_id"])
    out = {}
    for r in named.orderBy("table_uid", "ord").collect():
        out.setdefault(r["table_uid"], []).append("/".join(r["labels"]))
    return out


def test_labels_of_all_layouts(found):
    got = drawn_labels(*found)
    for name, expected in EXPECTED.items():
        assert got.get(name, []) == expected, name
    assert len(got["two bands"]) == 8 and "hhhh/vddd/hhhh/hhhh/vddd/hhhh/hhhh/vddd" in got["two bands"][:2]
    assert "hhhhh/vdvdd/vdvdd/hhhhh/hhhhh/vdddd" in got["both"] and "hhhhh/vdddd/vdddd/hhhhh/hhhhh/vdddd" in got["both"]


def test_names_separators_and_subtables(found):
    rows = {(r["table_uid"], r["candidate_id"]): r for r in found[1].collect()}
    assert {k[1] for k in rows if k[0] == "data title"} == {"layout1", "h1_v0", "layout2"}
    title = rows["data title", "layout2"]
    assert [(s["row_idx"], s["columns"]) for s in title["separators"]] == [(2, [0, 1, 2, 3])]
    assert [(s["rows"], s["columns"], s["hmd"], s["vmd"]) for s in title["subtables"]] == [([0, 1, 3, 4], [0, 1, 2, 3], 1, 1)]
    assert [(s["rows"], s["columns"], s["hmd"], s["vmd"]) for s in rows["second column", "layout2"]["subtables"]] == [([0, 1, 2, 3], [0, 1], 1, 1), ([0, 1, 2, 3], [2, 3], 1, 1)]
    assert rows["sections", "layout1"]["subtables"][0]["rows"] == [1, 3, 4]
    classes = {r["table_uid"]: r["class"] for r in layouts.complexity(found[1]).collect()}
    assert classes["grid"] == "simple" and classes["sections"] == "separator_rows" and classes["both"] == "subtables"


def test_layouts_part_their_tables(found):
    all_, candidates = found
    assert layouts.partition_checks(all_, candidates).where("uncovered + overlapping + disagreeing + shared + several_roles + split_data > 0").isEmpty()
    one = candidates.where("table_uid = 'second column' AND candidate_id = 'h1_v0'")
    part = lambda rows, cols, h: F.struct(F.array(*map(F.lit, rows)).alias("rows"), F.array(*map(F.lit, cols)).alias("columns"), F.lit(h).alias("hmd"), F.lit(0).alias("vmd"))
    check = lambda *parts: layouts.partition_checks(all_, one.withColumn("subtables", F.array(*parts))).first()
    assert check(part([0, 1, 2, 3], [0, 1, 2], 1))["uncovered"] == 4
    assert check(part([0, 1, 2, 3], [0, 1, 2, 3], 1), part([3], [0, 1, 2, 3], 0))["shared"] == 4
    assert check(part([0, 1, 2, 3], [0, 1, 2, 3], 1), part([3], [0], 1))["disagreeing"] == 1
    assert check(part([0, 1], [0, 1, 2, 3], 1), part([2, 3], [0, 1, 2, 3], 0))["split_data"] == 1  # the tall cell
    assert check(part([0, 1], [0, 1, 2, 3], 2), part([2, 3], [0, 1, 2, 3], 0))["several_roles"] == 1
    aside = F.array(F.struct(F.lit(0).alias("row_idx"), F.array(F.lit(0)).alias("columns")))
    assert layouts.partition_checks(all_, one.withColumn("separators", aside)).first()["overlapping"] == 1


def test_random_tables(spark):
    """Every subtable reads under the rules by itself, no table has over sixteen layouts with cuts, those with most cuts
    come first, and no two label a table alike."""
    rng = random.Random(5)
    tables = {}
    for k in range(60):
        n, m = rng.randrange(2, 8), rng.randrange(2, 6)
        grid = [[r * m + c for c in range(m)] for r in range(n)]
        for _ in range(rng.randrange(4)):
            r, c = rng.randrange(n), rng.randrange(m)
            r2, c2 = (r, min(m - 1, c + 1)) if rng.random() < 0.5 else (min(n - 1, r + 1), c)
            if grid[r][c] == r * m + c and grid[r2][c2] == r2 * m + c2:
                grid[r2][c2] = grid[r][c]
        tables[f"t{k:02d}"] = grid
    tables["bands"] = [[0, 1, 2]] + [[100 * b + 10 * r + (min(c, 1) if r == 1 else c) + 1000 for c in range(3)] for b in range(7) for r in range(3)]
    all_ = layouts.kept(slots_of(spark, tables))
    candidates = layouts.kept(layouts.table_candidates(all_))
    views, chosen = layouts.as_tables(all_, candidates)
    broken = geometry.rule_checks(views, chosen)
    assert broken.where(" OR ".join(f"rule_{n}" for n in range(9))).isEmpty()
    assert layouts.partition_checks(all_, candidates).where("uncovered + overlapping + disagreeing + shared + several_roles + split_data > 0").isEmpty()
    cuts = {}
    for r in candidates.orderBy("table_uid", "ord").select("table_uid", F.size("subtables").alias("n")).collect():
        cuts.setdefault(r["table_uid"], []).append(r["n"])
    assert all(c == sorted(c, reverse=True) and sum(n > 1 for n in c) <= layouts.MOST for c in cuts.values())
    assert sum(n > 1 for n in cuts["bands"]) == layouts.MOST and any(n > 1 for t, c in cuts.items() for n in c if t != "bands")
    assert all(len(set(x)) == len(x) for x in drawn_labels(all_, candidates.where("size(subtables) > 1")).values())
    plain = candidates.where("size(subtables) = 1 AND size(separators) = 0").select("table_uid", "hmd", "vmd")
    whole = geometry.boundaries(all_).join(geometry.separators(all_).select("table_uid").distinct(), "table_uid", "left_anti")
    assert plain.join(whole, ["table_uid", "hmd", "vmd"], "left_anti").isEmpty()


def test_empty_and_no_layouts(spark):
    nothing = slots_of(spark, {"x": [[0]]}).limit(0)
    assert layouts.table_candidates(nothing).count() == 0


def test_reviewed_counts_and_segmentations(found):
    all_, candidates = found
    sections = candidates.where("table_uid = 'sections'")
    counts = {r["candidate_id"]: (r["hmd"], r["vmd"]) for r in review.reviewable_counts(sections).collect()}
    assert counts == {"layout1": (0, 1), "layout2": (2, 0), "layout3": (2, 1)}  # the title row counts with the header row below it
    assert review.reviewable_counts(candidates.where("size(subtables) > 1")).count() == 0
    known = review.segmentations(sections, geometry.shape(all_))
    verdict = review.segmentation_verdicts(known.where("candidate_id = 'layout2'").drop("candidate_id"), known).first()
    assert (verdict["final_status"], verdict["candidate_id"]) == ("valid", "layout2")


def test_lines_and_headers_by_subtable(spark, found):
    all_, candidates = found
    one = candidates.where("table_uid = 'second band' AND candidate_id = 'layout2'")
    held = layouts.roles(all_, one)
    lines = layouts.subtable_lines(held)
    n = {(r["axis"], r["line"]["k"], r["line"]["at"]): r["n"] for r in lines.groupBy("axis", "line").agg(F.count("*").alias("n")).collect()}
    assert n[("hmd", 0, 0)] == 4 and n[("hmd", 1, 0)] == 7 and n[("vmd", 1, 0)] == 1 and n[("col", 0, 1)] == 1 and n[("row", 1, 4)] == 3
    kinds = all_.where("table_uid = 'second band'").select("table_uid", "cell_id", F.when(F.col("row_idx").isin(0, 2, 3) | (F.col("col_idx") == 0), "Text").otherwise("Numeric").alias("family")).distinct().withColumn("type", F.col("family"))
    assert scoring.bit_costs(lines, kinds, model_cost=False).first()["bits"] == 0
    views, chosen = layouts.as_tables(all_, one)
    nodes = {(r["table_uid"][-1], r["first_col"], r["last_col"]): r["n_parents"] for r in export.header_nodes(views, chosen).collect()}
    assert nodes[("0", 1, 1)] == 0 and nodes[("1", 2, 3)] == 0 and nodes[("1", 3, 3)] == 1
    assert {r["n_parents"] for r in export.corner_nodes(views, chosen).where("table_uid LIKE '%#1'").collect()} == {0, 1}
    texts = all_.select("table_uid", "cell_id").distinct().withColumn("text", F.concat(F.lit("c"), "cell_id"))
    title = candidates.where("table_uid = 'data title' AND candidate_id = 'layout2'")
    assert [tuple(r) for r in export.layout_separator_texts(layouts.roles(all_, title), texts).select("row_idx", "text").collect()] == [(2, "c8 | c9")]
