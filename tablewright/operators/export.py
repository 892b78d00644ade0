"""Agreed tables as header trees and unmerged data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.operators.geometry import TABLE, column_paths, row_paths


def data_places(slots: DataFrame, cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """(table_uid, row_idx, col_idx, text) of the data region of the chosen boundary, merged cells repeated."""
    inside = chosen.select(TABLE, "hmd", "vmd").join(slots, TABLE).where("row_idx >= hmd AND col_idx >= vmd")
    return inside.join(cells.select(TABLE, "cell_id", "text"), [TABLE, "cell_id"]).select(TABLE, "row_idx", "col_idx", "text")


def data_grids(places: DataFrame) -> DataFrame:
    """The data of a table as rows of texts."""
    rows = places.groupBy(TABLE, "row_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", "text"))), lambda s: s["text"]).alias("texts"))
    return rows.groupBy(TABLE).agg(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "texts"))), lambda s: s["texts"]).alias("data"))


def header_nodes(slots: DataFrame, chosen: DataFrame) -> DataFrame:
    """(table_uid, cell_id, first_col, last_col, parent_id, n_parents): header cells over the data columns; the
    parent is the one cell over the whole of a cell's top row, null for roots; several parents are an error."""
    return header_nodes_of(slots, chosen.select(TABLE, F.lit("").alias("candidate_id"), "hmd", "vmd")).drop("candidate_id")


def header_nodes_of(slots: DataFrame, candidates: DataFrame) -> DataFrame:
    """header_nodes of any number of candidates a table, with candidate_id."""
    key = [TABLE, "candidate_id"]
    head = candidates.select(*key, "hmd", "vmd").join(slots, TABLE).where("row_idx < hmd AND col_idx >= vmd")
    node = head.groupBy(*key, "cell_id").agg(F.min("row_idx").alias("top"), F.min("col_idx").alias("first_col"), F.max("col_idx").alias("last_col"))
    over = slots.select(TABLE, F.col("row_idx").alias("over_row"), F.col("col_idx").alias("over_col"), F.col("cell_id").alias("over_id"))
    above = node.withColumn("over_row", F.col("top") - 1).join(over, [TABLE, "over_row"]).where("over_col BETWEEN first_col AND last_col")
    parents = above.groupBy(*key, "cell_id").agg(F.min("over_id").alias("parent_id"), F.countDistinct("over_id").alias("n_parents"))
    return node.join(parents, [*key, "cell_id"], "left").select(*key, "cell_id", "first_col", "last_col", "parent_id", F.coalesce("n_parents", F.lit(0)).alias("n_parents"))


def transposed(slots: DataFrame) -> DataFrame:
    return slots.select(TABLE, F.col("col_idx").alias("row_idx"), F.col("row_idx").alias("col_idx"), "cell_id")


def relational(slots: DataFrame, cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per data place with its column header path, row header path (texts joined by ' > ') and text."""
    def named(paths: DataFrame, line: str, path: str) -> DataFrame:
        steps = paths.select(TABLE, "line", F.posexplode("path").alias("step", "cell_id")).join(cells.select(TABLE, "cell_id", "text"), [TABLE, "cell_id"])
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("step", "text"))), lambda s: s["text"]), " > ")
        return steps.groupBy(TABLE, F.col("line").alias(line)).agg(joined.alias(path))

    places = data_places(slots, cells, chosen)
    return places.join(named(column_paths(slots, chosen), "col_idx", "column_path"), [TABLE, "col_idx"], "left").join(named(row_paths(slots, chosen), "row_idx", "row_path"), [TABLE, "row_idx"], "left")


def header_json(nodes: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_uid, forest): header nodes as nested JSON [{text: [children]}], children by their first column. A
    table's nodes are at most its header cells, so one group is small."""
    import json

    import pandas as pd

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        below: dict = {}
        for row in part.sort_values(["first_col", "cell_id"]).itertuples():
            below.setdefault(-1 if pd.isna(row.parent_id) else int(row.parent_id), []).append((int(row.cell_id), row.text or ""))

        def tree(parent: int) -> list:
            return [{text: tree(cell)} for cell, text in below.get(parent, [])]

        return pd.DataFrame({"table_uid": [key[0]], "forest": [json.dumps(tree(-1), ensure_ascii=False)]})

    named = nodes.join(cells.select(TABLE, "cell_id", "text"), [TABLE, "cell_id"])
    return named.select(TABLE, "cell_id", "parent_id", "first_col", "text").groupBy(TABLE).applyInPandas(build, "table_uid string, forest string")


def entries(reviews: DataFrame, candidates: DataFrame, shapes: DataFrame, nodes: DataFrame) -> DataFrame:
    """One entry a reviewed table: final_status, and of a valid one candidate_id, hmd, vmd and export_error:
    unknown_candidate, out_of_range, not_a_forest (a header cell under several) or null.
    reviews: table_uid, final_status, candidate_id; nodes: header_nodes with candidate_id."""
    torn = nodes.where("n_parents > 1").select(TABLE, "candidate_id").distinct().withColumn("torn", F.lit(True))
    known = candidates.select(TABLE, "candidate_id", "hmd", "vmd").join(shapes.select(TABLE, "n_rows", "n_cols"), TABLE).join(torn, [TABLE, "candidate_id"], "left")
    valid = reviews.select(TABLE, "final_status", F.when(F.col("final_status") == "valid", F.col("candidate_id")).alias("candidate_id"))
    error = (
        F.when(F.col("final_status") != "valid", None).when(F.col("hmd").isNull(), "unknown_candidate")
        .when((F.col("hmd") >= F.col("n_rows")) | (F.col("vmd") >= F.col("n_cols")), "out_of_range").when(F.col("torn"), "not_a_forest")
    )
    found = valid.join(known, [TABLE, "candidate_id"], "left")
    return found.select(TABLE, "final_status", F.when(F.col("hmd").isNotNull(), F.col("candidate_id")).alias("candidate_id"), "hmd", "vmd", error.alias("export_error"))


def separator_texts(slots: DataFrame, cells: DataFrame, separators: DataFrame) -> DataFrame:
    """(table_uid, row_idx, text): the texts of the cells on rows set aside, in order of columns, a cell once, joined
    by ' | '; empty ones left out. separators: table_uid, row_idx."""
    at = slots.join(separators.select(TABLE, "row_idx"), [TABLE, "row_idx"]).groupBy(TABLE, "row_idx", "cell_id").agg(F.min("col_idx").alias("first"))
    said = at.join(cells.select(TABLE, "cell_id", "text"), [TABLE, "cell_id"])
    parts = F.sort_array(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("first", "text"))))
    return said.groupBy(TABLE, "row_idx").agg(F.array_join(F.transform(parts, lambda s: s["text"]), " | ").alias("text"))


def corner_nodes(slots: DataFrame, chosen: DataFrame) -> DataFrame:
    """header_nodes of the corner: the header cells over the header columns."""
    beside = slots.join(chosen.select(TABLE, F.col("vmd").alias("_side")), TABLE).where(F.col("col_idx") < F.col("_side")).drop("_side")
    return header_nodes(beside, chosen.where("vmd > 0").select(TABLE, "hmd", F.lit(0).alias("vmd")))


def layout_separator_texts(held: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_uid, candidate_id, row_idx, text): the texts of the cells that a layout sets aside, row by row, in order
    of columns, a cell once, joined by ' | '; empty ones left out. held: as of layouts.roles."""
    aside = held.where("role = 'separator'").groupBy(TABLE, "candidate_id", "row_idx", "cell_id").agg(F.min("col_idx").alias("first"))
    said = aside.join(cells.select(TABLE, "cell_id", "text"), [TABLE, "cell_id"], "left")
    parts = F.sort_array(F.collect_list(F.when(F.coalesce("text", F.lit("")) != "", F.struct("first", "text"))))
    return said.groupBy(TABLE, "candidate_id", "row_idx").agg(F.array_join(F.transform(parts, lambda s: s["text"]), " | ").alias("text"))
