"""Runs, outputs, selection records and cleaned markup on small cases."""

import pytest
from pyspark.sql import functions as F

from tablewright.functions import ids
from tablewright.operators import evaluate, guidelines, scoring
from tablewright.sources import articles, markup, records


@pytest.mark.parametrize(
    "given, wanted",
    [
        ("<table><tr><td>a<td>b<tr><th scope=row>c</table>", '<table><tr><td>a</td><td>b</td></tr><tr><th scope="row">c</th></tr></table>'),
        ("<table><tr><td rowspan=0 colspan=0>x</td><td rowspan=100001 colspan='3 4'>y</td></tr></table>", '<table><tr><td rowspan="0">x</td><td>y</td></tr></table>'),
        ("<table><tr><td><form><b>gone</b><input><p>too</form>1 &lt; 2 &amp; <blink onclick=q()>3</blink></td></tr></table>", "<table><tr><td>1 &lt; 2 &amp; <span>3</span></td></tr></table>"),
        ("<table><colgroup span=2><col span=x></colgroup><tr><td scope=col>a<br/>b</td></tr></table>", '<table><colgroup span="2"><col></colgroup><tr><td>a<br>b</td></tr></table>'),
        ("<table><tr><td><table><tr><td>in</td></tr></table>out</td></tr></table>", "<table><tr><td><table><tr><td>in</td></tr></table>out</td></tr></table>"),
        ("<table><tr><th scope=everything>a</th></tr><script>never ended", "<table><tr><th>a</th></tr></table>"),
        ("", ""),
    ],
)
def test_cleaned_markup(given, wanted):
    assert markup.cleaned(given) == wanted
    assert markup.cleaned(wanted) == wanted


def test_clean_tables_keeps_nulls_and_other_columns(spark):
    df = spark.createDataFrame([(1, "<table><i>x</table>"), (2, None)], "id int, html string")
    assert [tuple(r) for r in markup.clean_tables(df, "html").sort("id").collect()] == [(1, "<table><i>x</i></table>"), (2, None)]
    assert markup.clean_tables(df.limit(0), "html").count() == 0


def test_header_models_agree_between_the_two_ways_of_scoring(spark):
    raster = [[0, 1, 1], [0, 2, 3], [4, 5, 6], [7, 8, 9]]
    slots = spark.createDataFrame([("t", r, c, x) for r, row in enumerate(raster) for c, x in enumerate(row)], "table_uid string, row_idx int, col_idx int, cell_id int")
    types = spark.createDataFrame([("t", x, k, k, k) for x, k in enumerate("ABACABBCBB")], "table_uid string, cell_id int, type string, family string, group string")
    found = spark.createDataFrame([("t", "h2_v1", 2, 1)], "table_uid string, candidate_id string, hmd int, vmd int")
    top = slots.groupBy("table_uid", "cell_id").agg(F.min("row_idx").alias("r"), F.min("col_idx").alias("c"))
    labels = top.select("table_uid", F.lit("h2_v1").alias("candidate_id"), "cell_id", F.when(F.col("r") < 2, "hmd").when(F.col("c") < 1, "vmd").otherwise("data").alias("region"))
    for model in ("region", "line"):
        for roles in ((), ("B",)):
            one = scoring.bit_costs(scoring.lines(slots, labels, model), types, roles=roles).first()["bits"]
            other = scoring.boundary_costs(slots, found, types, roles=roles, header_model=model).first()["bits"]
            assert one == pytest.approx(other)
    per_line = {r["line"]: r["n"] for r in scoring.lines(slots, labels, "line").where("axis = 'hmd'").groupBy("line").agg(F.count("*").alias("n")).collect()}
    assert per_line == {0: 2, 1: 3}  # the corner cell stands on both header rows


def test_tables_without_candidates_have_a_record(spark):
    tables = spark.createDataFrame([("a",), ("b",), ("c",)], "table_uid string")
    found = spark.createDataFrame([("a", "h1_v0", 1, 0), ("b", "h1_v1", 1, 1), ("b", "h1_v0", 1, 0)], "table_uid string, candidate_id string, hmd int, vmd int")
    scored = spark.createDataFrame([("a", "h1_v0", 3.0), ("b", "h1_v1", 2.0), ("b", "h1_v0", 4.0)], "table_uid string, candidate_id string, score double")
    types = spark.createDataFrame([("b", "Text"), ("b", "Text"), ("b", "empty")], "table_uid string, family string")
    got = {r["table_uid"]: (r["status"], r["selected_candidate_id"], r["selected_by"], r["margin"], [tuple(s) for s in r["scores"]]) for r in scoring.selections(tables, scored, found, types).collect()}
    assert got == {"a": ("unique", "h1_v0", "only_candidate", None, []), "b": ("selected", "h1_v1", "score", 1.0, [("h1_v0", 4.0), ("h1_v1", 2.0)]), "c": ("no_candidates", None, None, None, [])}
    assert scoring.selections(tables.where("table_uid = 'b'"), scored, found, types, "purity").first()["selected_candidate_id"] == "h1_v0"


def test_pools_refuse_a_table_scored_twice_and_mixed_models(spark):
    line = "run string, arm string, table_uid string"
    runs = spark.createDataFrame([("1", "m"), ("2", "m")], "run string, model string")
    lines = spark.createDataFrame([("1", "full", "t1"), ("1", "free", "t1"), ("2", "full", "t2")], line)
    assert {r["run"]: r["tables"] for r in evaluate.pool_runs(lines, runs)[1].collect()} == {"1": 1, "2": 1}
    with pytest.raises(ValueError, match="t1 \\(full\\) is in 2 lines"):
        evaluate.pool_runs(lines.unionByName(spark.createDataFrame([("2", "full", "t1")], line)), runs)
    with pytest.raises(ValueError, match="different models: m, n"):
        evaluate.pool_runs(lines, runs.unionByName(spark.createDataFrame([("3", "n")], "run string, model string")))


def test_outputs_replace_articles_and_refuse_what_lacks_columns(spark, tmp_path):
    schema = "table_uid string, review_status string, final_status string, decided_by string, selected_candidate_id string"
    first = spark.createDataFrame([(f"PMC{n}/t{k}", "reviewed", "valid", "llm", None) for n in range(1, 6) for k in range(3)], schema)
    again = spark.createDataFrame([("PMC2/t0", "reviewed", "failed", None, None)], schema)
    records.write_output(first, str(tmp_path), "reviews", 2)
    path = records.write_output(again, str(tmp_path), "reviews", 2)
    got = sorted((r["table_uid"], r["final_status"]) for r in records.read_output(spark, path, schema).collect())
    assert got == sorted([(f"PMC{n}/t{k}", "valid") for n in (1, 3, 4, 5) for k in range(3)] + [("PMC2/t0", "failed")])
    with pytest.raises(ValueError, match="without decided_by"):
        records.write_output(first.drop("decided_by"), str(tmp_path), "reviews")
    with pytest.raises(ValueError, match="unknown output"):
        records.write_output(first, str(tmp_path), "letters")


def test_reasons_attempts_and_decisions(spark):
    errors = spark.createDataFrame([("table_layout_error", 3, ["x"]), ("table_layout_error", None, ["x"]), ("paper_raster_limit_exceeded", 2, ["slots", "9"]), ("time_limit", None, []), (None, 1, [])], "e string, t int, a array<string>")
    got = [r[0] for r in errors.select(records.failure_reason(F.col("e"), F.col("t"), F.col("a"))).collect()]
    assert got == ["table 3 invalid layout: x", "invalid table layout: x", "table 2 paper raster limit slots exceeded (? > 9)", "time_limit", None]
    observed = spark.createDataFrame([("r", "PMC1", "q"), ("r", "PMC1", "p"), ("r", "PMC2", "q")], "run_id string, pmc_id string, query string")
    proposed = spark.createDataFrame([("r", "PMC1"), ("r", "PMC3"), ("r", "PMC1")], "run_id string, pmc_id string")
    attempts = spark.createDataFrame([("r", "PMC1", 1, "failed", "x"), ("r", "PMC1", 2, "complete", None), ("s", "PMC1", 3, "failed", "y")], "run_id string, pmc_id string, seq long, status string, detail string")
    papers = records.run_papers(observed, proposed, attempts)
    assert {r["pmc_id"]: (r["decision"], r["status"], r["detail"], r["attempts"]) for r in papers.collect()} == {"PMC1": ("selected", "complete", None, 2), "PMC2": ("offered", None, None, 0), "PMC3": ("rejected", None, None, 0)}
    runs = spark.createDataFrame([("r", "topic"), ("empty", "other")], "run_id string, topic string")
    made = {r["run_id"]: r.asDict() for r in records.run_manifests(runs, observed, papers).collect()}
    assert (made["r"]["topic"], made["r"]["queries"], made["r"]["selected"], made["r"]["rejected"], made["r"]["complete"], made["empty"]["selected"]) == ("topic", 2, 1, 1, 1, 0)


def test_answers_of_another_program_do_not_count(spark, tmp_path):
    path, now = str(tmp_path / "log"), guidelines.program_hash(["a rule"])
    row = lambda seq, answer: spark.createDataFrame([(seq, "Flag", "Word", answer, "b/1")], "seq long, text string, rule_type string, answer string, batch_id string")
    guidelines.append_answers(path, row(1, "Old"), now)
    guidelines.append_answers(path, row(2, "New"), now)
    guidelines.append_answers(path, row(3, "Other"), guidelines.program_hash(["another rule"]))
    assert [tuple(r) for r in guidelines.latest(spark.read.json(path), now).collect()] == [("Flag", "Word", "New")]


def test_licences(spark):
    rows = [(1, "<article><license xmlns:xlink='l'><b><ext-link href='later'/></b></license></article>"), (2, "<a"), (3, None), (4, "<article/>"), (5, "<article><license license-type=''>" + "x" * 2000 + "</license></article>")]
    got = {r["key"]: r for r in articles.provenance(spark.createDataFrame(rows, "k int, xml string"), "k", "xml").collect()}
    assert got["1"]["license"]["license_url"] == "later" and got["1"]["license"]["license_type"] == "unknown"
    assert got["2"]["license"] is None and got["2"]["bytes"] == 2 and got["3"]["license"] is None and got["3"]["sha256"] is None
    assert got["4"]["license"]["status"] == "missing" and len(got["5"]["license"]["license_text_excerpt"]) == 1024 and got["5"]["license"]["license_type"] == ""


def test_status_of_json_bodies(spark):
    rows = [(None, "search"), ("[1]", "search"), ('{"result": {"uids": [1]}}', "summary"), ('{"result": {"uids": {}}}', "summary"), ('{"esearchresult": 1}', "search"), ('{"esearchresult": {"idlist": ["1"]}}', None), ("nothing", "search")]
    got = [r[0] for r in spark.createDataFrame(rows, "b string, k string").select(ids.json_status(F.col("b"), F.col("k"))).collect()]
    shape = "invalid(unexpected_json_shape)"
    assert got == ["invalid(empty_body)", shape, "ok", shape, shape, shape, "invalid(malformed_json)"]
