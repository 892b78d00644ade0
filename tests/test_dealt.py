"""Tables dealt by table_uid once: what is done by table moves nothing."""

import pytest

from tablewright.operators import geometry
from tablewright.plans import fixtures, layout_queries, record_queries, table_queries  # noqa: F401

SF = "/root/testdata/sf0.001"


def test_places_equal_the_statement(spark):
    lineitem = spark.read.parquet(f"{SF}/lineitem.parquet")
    said = spark.sql(f"WITH {fixtures.FIXTURE_CTES.replace('FROM lineitem', 'FROM {lineitem}')} SELECT * FROM named", lineitem=lineitem)
    made = fixtures.texts(spark, SF)
    assert said.dtypes == made.dtypes
    assert made.count() == said.count() and made.exceptAll(said).isEmpty()


BY_TABLE = "c1_lines c3_line_counts c4_bit_costs c6_purities c7_selection c11_prior_choice a7_contrast a18_cell_accuracy e1_data_places e7_relational g1_shape g3_plain_grids g17_boundary_regions x10_slots_to_raster".split()


@pytest.mark.parametrize("name", BY_TABLE)
def test_query_by_table_deals_nothing_again(spark, name):
    plan = table_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_unions_by_table_are_kept_in_buckets(spark):
    layout_queries.candidates(spark, SF)
    for name in ("r10_segmentation_checks", "g12_layout_labels", "g13_layouts", "g16_subtables"):
        plan = table_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan


def test_differences_count_rows(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "table_uid string, x int")
    stored = rows(("a", 1), ("a", 1), ("a", 2), (None, 3), ("b", None), ("b", None))
    computed = rows(("a", 1), ("a", 2), (None, 3), ("b", None), ("c", 5))
    found = sorted((r[0], str(r[1]), r[2]) for r in geometry.differences(stored, computed).collect())
    assert found == [("a", "1", "stored"), ("b", "None", "stored"), ("c", "5", "computed")]


def test_rows_that_agree_are_not_dealt_to_be_compared(spark):
    plan = table_queries.QUERIES["g21_record_audit"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "Exchange hashpartitioning" not in plan.split("LeftAnti", 1)[1]
