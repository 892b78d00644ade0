"""Small cases with known results."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions import ids
from tablewright.functions.text import and_list, index_ranges, normalized
from tablewright.operators import evaluate, geometry, rules, scoring
from tablewright.sources import records


def slots(spark, rasters):
    rows = [(name, r, c, x) for name, raster in rasters.items() for r, row in enumerate(raster) for c, x in enumerate(row)]
    return spark.createDataFrame(rows, "table_uid string, row_idx int, col_idx int, cell_id int")


RASTERS = {
    "plain": [[0, 1], [2, 3], [4, 5], [6, 7]],
    "merged": [[0, 0, 0, 1], [2, 3, 4, 5], [6, 7, 8, 9]],
    "side": [[0, 1, 2], [3, 4, 5], [3, 6, 7], [3, 8, 9]],
    "none": [[0, 0], [1, 1]],
}
EXPECTED = {"plain": {(0, 1), (1, 0), (1, 1)}, "merged": {(2, 0), (2, 1)}, "side": {(1, 0), (1, 1), (1, 2)}, "none": set()}


def test_known_boundaries(spark):
    found = {}
    for r in geometry.boundaries(slots(spark, RASTERS)).collect():
        found.setdefault(r["table_uid"], set()).add((r["hmd"], r["vmd"]))
    assert {k: found.get(k, set()) for k in RASTERS} == EXPECTED


def test_search_agrees_with_the_rules_on_random_rasters(spark):
    rng = random.Random(11)
    rasters = {f"r{k}": [[rng.randrange(4) for _ in range(c)] for _ in range(r)] for k, (r, c) in enumerate(itertools.product(range(1, 5), range(1, 5), range(4)) and [(rng.randrange(1, 5), rng.randrange(1, 5)) for _ in range(80)])}
    all_ = slots(spark, rasters)
    targets = spark.createDataFrame([(n, h, v) for n, m in rasters.items() for h in range(len(m) + 1) for v in range(len(m[0]) + 1)], "table_uid string, hmd int, vmd int")
    by_rules = {(r["table_uid"], r["hmd"], r["vmd"]) for r in geometry.rule_checks(all_, targets).where("first_broken = -1").collect()}
    assert by_rules == {(r["table_uid"], r["hmd"], r["vmd"]) for r in geometry.boundaries(all_).collect()}


def test_separators(spark):
    all_ = slots(spark, {"t": [[0, 1], [2, 2], [3, 4], [5, 5], [6, 7]]})
    assert sorted(r["row_idx"] for r in geometry.separators(all_).collect()) == [1, 3]
    assert [r["source_row"] for r in geometry.strip_separators(all_).select("row_idx", "source_row").distinct().orderBy("row_idx").collect()] == [0, 2, 4]


CASES = [("17", "Integer"), ("3.05bc", "AnnotatedNumber"), ("12.4 ± 0.8 c", "MeanSD"), ("56 (18.2%)", "ValueParen"), ("≤0.05", "Inequality"), ("1.2–3.4", "NumberRange"), ("—", "Dash"), ("N/A", "NotAvailable"), ("Meyer et al. (2004)", "Citation"), ("Phase 3", "Phrase"), ("NCT12345678", "TrialID"), ("Wheat", "Word"), ("Height, cm", "LabelWithUnit"), ("", "empty"), ("1999-12-31", "untyped")]


@pytest.mark.parametrize("split", [1, 4])
def test_cell_types(spark, split):
    df = spark.createDataFrame([("t", i, t) for i, (t, _) in enumerate(CASES)], "table_uid string, cell_id int, text string").repartition(split)
    got = {r["text"]: r["type"] for r in rules.type_cells(rules.SCIENCE, df).collect()}
    assert got == dict(CASES)


def test_subtypes_come_before_order(spark):
    for first, second in (("N", "I"), ("I", "N")):
        program = rules.Program((rules.Rule(first, "[0-9]+"), rules.Rule(second, "[0-9]+")), (("I", "N"),))
        assert rules.type_cells(program, spark.createDataFrame([("t", 0, " 12 ")], "table_uid string, cell_id int, text string")).first()["type"] == "I"
    program = rules.Program((), (("Q", "T"), ("F", "Q"), ("I", "N")))
    assert [program.group(k) for k in "FTI"] == ["Q", "T", "N"]


def test_bit_costs(spark):
    grid = slots(spark, {"t": [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]})
    cells = grid
    kinds = grid.select("table_uid", "cell_id", F.when((F.col("row_idx") == 0) | (F.col("col_idx") == 0), "Text").otherwise("Numeric").alias("family")).withColumn("type", F.col("family"))
    found = geometry.candidate_ids(geometry.boundaries(grid))
    lines = scoring.lines(grid, geometry.labels(found, cells))
    costs = {r["candidate_id"]: r["bits"] for r in scoring.bit_costs(lines, kinds, model_cost=False).collect()}
    assert costs["h1_v1"] == 0 and min(v for k, v in costs.items() if k != "h1_v1") > 0
    chosen = scoring.select(scoring.bit_costs(lines, kinds).withColumnRenamed("bits", "score"), found).first()
    assert chosen["selected_candidate_id"] == "h1_v1"


def test_information_and_p(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "x string, y string")
    assert abs(evaluate.mutual_information(pairs([("a", "x"), ("b", "y")] * 4)).first()["mi"] - 1) < 1e-12
    assert abs(evaluate.mutual_information(pairs([("a", "x"), ("a", "y")])).first()["mi"]) < 1e-12
    assert round(evaluate.exact_p(2, 12), 3) == 0.013


def test_texts(spark):
    row = spark.range(1).select(
        normalized(F.lit(" a  \n b ")), index_ranges(F.array(*[F.lit(i) for i in (1, 2, 3, 7)])), index_ranges(F.array().cast("array<int>")), and_list(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), and_list(F.array(F.lit("a"))),
        ids.article_ids(F.lit("(PMC0012), pmc7; PMC0 PMC12 'PMC5'."), 5), ids.article_name(F.lit("0042")), ids.article_name(F.lit("4x")),
    ).first()
    assert list(row) == ["a b", "1-3, 7", "", "a, b and c", "a", ["12", "7", "5"], "PMC42", None]


def test_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    one = spark.createDataFrame([("PMC1", "a"), ("PMC2", "b")], "pmc_id string, x string")
    records.write_by_article(one, path)
    records.write_by_article(spark.createDataFrame([("PMC2", "c")], "pmc_id string, x string"), path)
    assert {(r["pmc_id"], r["x"]) for r in spark.read.parquet(path).collect()} == {("PMC1", "a"), ("PMC2", "c")}
    lines = tmp_path / "r.jsonl"
    lines.write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in records.read_records(spark, str(lines), "a int").collect()) == [1, 2]
    (tmp_path / "x.xml").write_text("<article/>")
    assert records.read_articles(spark, str(tmp_path / "x.xml")).first()["bytes"] == 10


def test_header_json_and_permutations(spark):
    from tablewright.operators import export

    grid = slots(spark, {"t": [[0, 1, 1, 2], [3, 4, 5, 6], [7, 8, 9, 10]]})
    cells = grid.select("table_uid", "cell_id").distinct().withColumn("text", F.concat(F.lit("c"), F.col("cell_id").cast("string")))
    chosen = spark.createDataFrame([("t", 2, 1)], "table_uid string, hmd int, vmd int")
    got = export.header_json(export.header_nodes(grid, chosen), cells).first()["forest"]
    assert got == '[{"c1": [{"c4": []}, {"c5": []}]}, {"c2": [{"c6": []}]}]'
    pairs = spark.createDataFrame([("t", a, b) for a, b in [("a", "x"), ("b", "y")] * 20] + [("u", "a", "x")], "table_uid string, x string, y string")
    base = evaluate.permutation_baseline(1.0, evaluate.permuted_information(pairs, 19)).first()
    assert base["p"] == 0.05 and base["most"] < 0.5


def test_permutations_reach_small_probabilities_and_a_macro_baseline(spark):
    import inspect

    from tablewright.plans import record_queries

    assert "permuted_information(pairs, 1000)" in inspect.getsource(record_queries.a3_permutation_baseline)
    pairs = spark.createDataFrame([("t", a, b) for a, b in [("a", "x"), ("b", "y")] * 20] + [("u", "a", "x")] * 3 + [("v", a, b) for a in "ab" for b in "xy"] * 10, "table_uid string, x string, y string")
    permuted = evaluate.permuted_information(pairs, 1000)
    assert permuted.count() == 1000 and permuted.where("mi is null or macro is null").count() == 0
    seen = evaluate.macro_information(evaluate.mutual_information(pairs, ["table_uid"])).first()["mi"]
    base = evaluate.permutation_baseline(1.0, permuted, seen).first()
    assert abs(seen - 1 / 3) < 1e-9 and base["p"] == base["macro_p"] == 1 / 1001 and 0 < base["macro_mean"] < seen
    # a shuffle that changes nothing gives the observed values
    fixed = spark.createDataFrame([("t", "a", "x"), ("t", "b", "x"), ("u", "b", "y")], "table_uid string, x string, y string")
    pooled = evaluate.mutual_information(fixed).first()["mi"]
    one = evaluate.permutation_baseline(pooled, evaluate.permuted_information(fixed, 5), 0.0).first()
    assert abs(one["mean"] - pooled) < 1e-9 and one["p"] == one["macro_p"] == 1 and one["macro_mean"] == 0


@pytest.mark.parametrize("roles,model", [((), True), (("Text",), True), ((), False)])
def test_costs_from_places_equal_costs_from_lines(spark, roles, model):
    rng = random.Random(8)
    rasters = {}
    for k in range(30):
        n, m = rng.randrange(2, 7), rng.randrange(2, 6)
        grid = [[r * m + c for c in range(m)] for r in range(n)]
        if k % 3 == 0:
            grid[0][1] = grid[0][0]
        elif k % 3 == 1 and n > 2:
            grid[2][0] = grid[1][0]
        rasters[f"t{k}"] = grid
    all_ = slots(spark, rasters)
    kinds = all_.select("table_uid", "cell_id").distinct().withColumn("family", F.element_at(F.array(*[F.lit(x) for x in ("Text", "Numeric", "Symbol", "untyped", "Missing")]), (F.abs(F.xxhash64("table_uid", "cell_id")) % 5 + 1).cast("int"))).withColumn("type", F.col("family"))
    found = geometry.candidate_ids(geometry.boundaries(all_))
    first = all_.groupBy("table_uid", "cell_id").agg(F.min("row_idx").alias("row_idx"), F.min("col_idx").alias("col_idx"))
    lines = scoring.lines(all_, geometry.labels(found, first))
    show = lambda d: {(r["table_uid"], r["candidate_id"]): round(r["bits"], 9) for r in d.collect()}
    direct = show(scoring.boundary_costs(all_, found, kinds, roles=roles, model_cost=model))
    assert len(direct) > 40 and direct == show(scoring.bit_costs(lines, kinds, roles=roles, model_cost=model))
