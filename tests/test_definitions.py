"""Small cases of answers, measures, segmentations and samples, worked out by hand from their definitions."""

import json

import pytest
from pyspark.sql import functions as F

from tablewright.operators import evaluate, export, geometry, guidelines, review, rules, sampling


def slots(spark, raster, uid="t"):
    return spark.createDataFrame([(uid, r, c, x) for r, row in enumerate(raster) for c, x in enumerate(row)], "table_uid string, row_idx int, col_idx int, cell_id int")


def cells(spark, raster, texts, uid="t"):
    first = {}
    for r, row in enumerate(raster):
        for c, x in enumerate(row):
            first.setdefault(x, (r, c))
    return spark.createDataFrame([(uid, x, r, c, texts[x]) for x, (r, c) in first.items()], "table_uid string, cell_id int, row_idx int, col_idx int, text string")


ANSWERS = [
    ({"parse_correct": True}, ("confirmed", None, None)), ({"parse_correct": "true", "column_header_rows": 9}, ("confirmed", None, None)),
    ({"parse_correct": False, "column_header_rows": 2, "row_header_columns": 1}, ("counts", 2, 1)),
    ({"parse_correct": "false", "column_header_rows": "2", "row_header_columns": 1.0}, ("counts", 2, 1)),
    ({"parse_correct": False, "column_header_rows": 0, "row_header_columns": 0}, ("counts", 0, 0)),
    ({"parse_correct": "TRUE"}, ("retry", None, None)), ({"parse_correct": False, "column_header_rows": "2.0", "row_header_columns": 1}, ("retry", None, None)),
    ({"parse_correct": False, "column_header_rows": 1.5, "row_header_columns": 1}, ("retry", None, None)), ({"parse_correct": False, "column_header_rows": 6, "row_header_columns": 1}, ("retry", None, None)),
    ({"parse_correct": False, "column_header_rows": -1, "row_header_columns": 1}, ("retry", None, None)), ({"parse_correct": False, "header_rows": 1, "header_columns": 1}, ("retry", None, None)),
    ({"parse_correct": False, "column_header_rows": True, "row_header_columns": 1}, ("retry", None, None)), ("no object", ("retry", None, None)), (None, ("retry", None, None)),
]


def test_answers(spark):
    rows = [(i, json.dumps(a) if isinstance(a, dict) else a) for i, (a, _) in enumerate(ANSWERS)]
    fields = review.answer_fields(F.col("answer"), F.lit(5), F.lit(3))
    got = spark.createDataFrame(rows, "i int, answer string").select("i", *[c.alias(n) for n, c in fields.items()]).orderBy("i").collect()
    assert [(r["verdict"], r["hmd"], r["vmd"]) for r in got] == [want for _, want in ANSWERS]
    long = spark.createDataFrame([(json.dumps({"parse_correct": True, "reason": "r" * 501}),), (json.dumps({"parse_correct": True, "reason": 5}),)], "answer string")
    assert [r[0] for r in long.select(fields["reason"]).collect()] == ["r" * 500 + " [...]", ""]


def test_contrast_and_kinds(spark):
    raster = [[0, 1, 2], [3, 4, 5], [6, 7, 8], [9, 10, 11]]
    families = ["empty", "Text", "Missing", "Text", "Numeric", "Numeric", "untyped", "Numeric", "Text", "Text", "Text", "Missing"]
    types = spark.createDataFrame([("t", i, f) for i, f in enumerate(families)], "table_uid string, cell_id int, family string")
    regions = spark.createDataFrame([("t", x, "hmd" if r == 0 else "vmd" if c == 0 else "data") for r, row in enumerate(raster) for c, x in enumerate(row)], "table_uid string, cell_id int, region string")
    got = {r["axis"]: (r["differing"], r["n_lines"]) for r in evaluate.line_contrast(slots(spark, raster), regions, types).collect()}
    # column 1: Text over two Numeric; column 2 has no typed heading; rows 1 and 3 are headed Text, row 2 by an untyped cell
    assert got == {"col": (1, 1), "row": (1, 2)}
    kinds = evaluate.data_kinds(regions.join(types, ["table_uid", "cell_id"])).first()["kind"]
    assert kinds == "mostly_numeric"  # three of five typed data cells


def test_structural_metrics(spark):
    tables = spark.createDataFrame([("a", "ok"), ("b", "ok"), ("c", "ok"), ("d", "quarantined")], "table_uid string, status string")
    found = spark.createDataFrame([("a", 1, 0), ("b", 1, 0), ("b", 1, 1), ("c", 1, 0)], "table_uid string, hmd int, vmd int")
    gold = spark.createDataFrame([("a", 1, 0), ("b", 1, 1), ("c", None, None), ("d", 2, 0)], "table_uid string, hmd int, vmd int")
    m = evaluate.structural_metrics(tables, found, gold).first().asDict()
    assert m == {"candidate_recall": 2 / 3, "unique_precision": 0.5, "unique_coverage": 0.5, "exact_match": 0.25, "false_rate": 1.0, "abstention": 0.0, "ambiguity": 0.25}
    with pytest.raises(Exception, match="no prediction for z"):
        evaluate.structural_metrics(tables, found, spark.createDataFrame([("z", 1, 0)], "table_uid string, hmd int, vmd int")).collect()


def test_outcomes(spark):
    rows = [("valid", "x", True, "invalid_output"), ("valid", None, True, "correct"), ("valid", None, False, "wrong_accepted"), ("unparseable", "x", True, "rejected"), ("unreviewed", None, True, "not_reviewed")]
    df = spark.createDataFrame(rows, "s string, e string, c boolean, want string")
    assert df.where(evaluate.outcome_class(F.col("s"), F.col("e"), F.col("c")) != F.col("want")).count() == 0


def test_places_and_cell_accuracy(spark):
    raster = [[0, 0], [1, 2], [3, 3], [4, 5], [6, 7]]
    all_ = slots(spark, raster)
    rect = spark.createDataFrame([("t", 1, 3, 0, 1, 2, 1)], "table_uid string, first_row int, last_row int, first_col int, last_col int, head_rows int, side_cols int")
    aside = spark.createDataFrame([("t", 2)], "table_uid string, row_idx int")
    labels = evaluate.place_labels(all_, rect, aside)
    got = {(r["row_idx"], r["col_idx"]): r["region"] for r in labels.collect()}
    assert [got[r, 1] for r in range(5)] == ["uncovered", "hmd", "separator", "hmd", "uncovered"]
    other = evaluate.place_labels(all_, rect.withColumn("head_rows", F.lit(1)), aside)
    assert {(r["row_idx"], r["region"]) for r in other.where("row_idx = 3").collect()} == {(3, "vmd"), (3, "data")}
    known = cells(spark, raster, [""] * 8).withColumn("kind", F.when(F.col("cell_id") == 7, "synthetic_gap").otherwise("source"))
    assert evaluate.cell_accuracy(known, labels, other).first()["accuracy"] == pytest.approx(5 / 7)
    assert evaluate.cell_accuracy(known, labels.limit(0), other).first()["accuracy"] is None


POOL = [(f"A/t{k}", "A", "x") for k in range(3)] + [("B/t0", "B", "y"), ("A/t9", "A", "y"), ("C/t0", "C", "y"), ("C/t1", "C", "x"), ("D/t0", "D", "x")]


def test_samples(spark):
    pool = spark.createDataFrame(POOL, "table_uid string, pmc_id string, class string")
    drawn = sampling.quota(pool, "class", {"x": 4, "y": 1}, 3).collect()
    closed = {r["pmc_id"] for r in drawn if r["class"] == "x"}
    assert len(drawn) == 5 and not closed & {r["pmc_id"] for r in drawn if r["class"] == "y"}
    with pytest.raises(ValueError, match="only 1 y tables"):
        sampling.quota(pool, "class", {"x": 5, "y": 2}, 3)
    turns = sampling.round_robin(pool, "class", ["x", "y"], 4, 3).orderBy("place").collect()
    assert [r["class"] for r in turns][:2] == ["x", "y"] and len({r["pmc_id"] for r in turns}) == 4
    with pytest.raises(ValueError, match="only 4 of 5"):
        sampling.round_robin(pool, "class", ["x", "y"], 5, 3)
    later = sampling.next_batch(pool, spark.createDataFrame([("A",)], "pmc_id string"), "class", ["x", "y"], 3, 3)
    assert {r["pmc_id"] for r in later.collect()} == {"B", "C", "D"}


def test_first_new_excludes_what_was_kept_only(spark):
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "c"), (2, 2, "a"), (2, 3, "d")], "query_rank int, rank int, id string")
    got = sampling.first_new(found, spark.createDataFrame([("b",)], "id string"), 1)
    assert sorted(tuple(r) for r in got.collect()) == [("a", 1, 1), ("c", 2, 1)]


def test_running_sums_cross_ranges(spark):
    df = spark.createDataFrame([("g" if i % 3 else "h", i, 1) for i in range(500)], "g string, i int, one int")
    got = evaluate.running(df, ["g"], [F.col("i")], "one", parts=7).collect()
    for name in "gh":
        mine = sorted((r["i"], r["n"], r["total"]) for r in got if r["g"] == name)
        assert [n for _, n, _ in mine] == list(range(1, len(mine) + 1)) == [t for _, _, t in mine]


PROGRAM = rules.Program((rules.Rule("Word", "[a-z]+"),), (("Color", "Word"), ("Shape", "Word")), (("a color", "Color"), ("a shape", "Shape"), ("a hue", "Color")), "small")


def test_prompts_and_replies(spark):
    batched = spark.createDataFrame([("b/1", 1, 'r"ed', "Word", "Color|Shape"), ("b/1", 2, "box", "Word", "Color|Shape")], "batch_id string, item int, text string, rule_type string, allowed string")
    prompt = guidelines.prompts(batched, PROGRAM).first()["prompt"]
    assert "- Color: a color; or a hue\n- Shape: a shape" in prompt and '1. "r\\"ed"\n2. "box"' in prompt and '{"1": "Color", "2": "none"}' in prompt
    given = lambda reply: spark.createDataFrame([("b/1", reply)], "batch_id string, reply string")
    read = lambda reply: [(r["answer"], r["n_missing"], r["retry"]) for r in guidelines.replies(batched, given(reply)).orderBy("item").collect()]
    assert read('{"1": " Color ", "2": "Size"}') == [("Color", 1, None), (None, 1, None)]
    assert {r[2] for r in read('{"3": "Color"}')} == {'no cell got one of its allowed types or "none"'}
    assert {r[2] for r in read("[]")} == {"the answer is not a JSON object"} and {r[2] for r in read(None)} == {"the model call failed or returned nothing"}


def test_many_answers_are_joined_by_salt(spark, monkeypatch):
    routed = spark.createDataFrame([("t", k, "red" if k % 3 else "box", "Word", "Color|Shape") for k in range(60)], "table_uid string, cell_id int, text string, type string, allowed string")
    answers = spark.createDataFrame([("red", "Word", "Color"), ("box", "Word", "none")], "text string, rule_type string, answer string")
    few = sorted(tuple(r) for r in guidelines.apply(routed, answers).select("cell_id", "derivation", "guided_type").collect())
    monkeypatch.setattr(guidelines, "BROADCAST_ANSWERS", 0)
    assert sorted(tuple(r) for r in guidelines.apply(routed, answers).select("cell_id", "derivation", "guided_type").collect()) == few
    assert few[0] == (0, "kept", "Word") and few[1] == (1, "guided", "Color")


SECTIONED = [[0, 0, 0], [1, 2, 3], [4, 5, 6], [7, 7, 7], [8, 9, 10], [11, 12, 13]]


def test_separator_texts(spark):
    all_ = slots(spark, SECTIONED)
    texts = export.separator_texts(all_, cells(spark, SECTIONED, [f"c{k}" for k in range(14)]), geometry.separators(all_))
    assert sorted((r["row_idx"], r["text"]) for r in texts.collect()) == [(0, "c0"), (3, "c7")]


def test_entries(spark):
    raster = [[0, 0, 1], [2, 3, 3], [4, 5, 6]]
    found = spark.createDataFrame([("t", "h2_v0", 2, 0), ("t", "h9_v0", 9, 0), ("t", "h1_v0", 1, 0)], "table_uid string, candidate_id string, hmd int, vmd int")
    nodes = export.header_nodes_of(slots(spark, raster), found.where("hmd < 3"))
    reviews = lambda status, c: spark.createDataFrame([("t", status, c)], "table_uid string, final_status string, candidate_id string")
    got = [export.entries(reviews(s, c), found, geometry.shape(slots(spark, raster)), nodes).first()["export_error"] for s, c in (("valid", "h2_v0"), ("valid", "h9_v0"), ("valid", "h5_v5"), ("valid", "h1_v0"), ("unparseable", None))]
    assert got == ["not_a_forest", "out_of_range", "unknown_candidate", None, None]


def test_agreement_and_labelled_set(spark):
    given = spark.createDataFrame([("P/t0", 0, "A", "G"), ("Q/t0", 0, "B", "G")], "table_uid string, cell_id int, type string, group string")
    wanted = spark.createDataFrame([("P/t0", 0, "A", "G"), ("P/t0", 1, "A", "G"), ("Q/t0", 0, "A", "G")], "table_uid string, cell_id int, wanted_type string, wanted_group string")
    assert tuple(evaluate.agreement(given, wanted).first()) == (3, pytest.approx(1 / 3), pytest.approx(2 / 3))
    assert tuple(evaluate.agreement(given, wanted, ["P"]).first()) == (1, 0.0, 1.0)
    gold = spark.createDataFrame([("P/t0", "h1_v0", 2), ("Q/t0", None, 3), ("P/t1", "h1_v0", 1)], "table_uid string, gold_candidate string, confidence int")
    assert [r["table_uid"] for r in evaluate.labelled_set(given.select("table_uid").distinct(), gold, 2).collect()] == ["P/t0"]
    purity = lambda rows: spark.createDataFrame(rows, "table_uid string, axis string, purity double")
    got = evaluate.purity_comparison(purity([("t", "col", 0.9), ("u", "col", 0.5), ("w", "col", None)]), purity([("t", "col", 0.7), ("t", "col", 0.8), ("u", "col", 0.5)])).first()
    assert (got["tables"], got["gold_purest"], got["gold_tied"]) == (2, 0.5, 0.5) and got["other_purity"] == pytest.approx(0.625)


def test_running_numbers_all_rows_whatever_is_read_of_them(spark):
    """One deal serves the sums and the rows: more rows than are sampled for the ranges, and a column that only one side reads."""
    rows = spark.range(300_000).select(F.lit("g").alias("g"), F.xxhash64("id").alias("key"), F.lit(1).alias("one"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
    found = evaluate.running(rows, ["g"], [F.col("key")], "one").select("n", "key", "more")
    assert found.where(F.length("more") < 64).isEmpty()
    totals = found.agg(F.countDistinct("n").alias("places"), F.max("n").alias("most"), F.min("n").alias("least")).first()
    assert tuple(totals) == (300_000, 300_000, 1)
    from pyspark.sql import Window

    apart = found.withColumn("place", F.row_number().over(Window.orderBy("key"))).where("place <> n")
    assert apart.isEmpty()
