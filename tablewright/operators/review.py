"""Review answers held against candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions.text import index_ranges
from tablewright.operators.geometry import TABLE

MAX_SLOTS, MAX_CHARS, MAX_CELL, MAX_CONTEXT = 2500, 60_000, 200, 1500


def queue(tables: DataFrame) -> DataFrame:
    """ask, or the first reason to skip a table. tables: selected, quarantined, n_candidates, selected_candidate_id, n_slots, n_chars."""
    reason = (
        F.when(~F.col("selected"), "not_selected").when(F.col("quarantined"), "quarantined").when(F.col("n_candidates") == 0, "parser_abstained")
        .when(F.col("selected_candidate_id").isNull(), "no_selected_candidate").when((F.col("n_slots") > MAX_SLOTS) | (F.col("n_chars") > MAX_CHARS), "too_large").otherwise("ask")
    )
    return tables.select(TABLE, reason.alias("decision"))


def table_lines(slots: DataFrame, cells: DataFrame) -> DataFrame:
    """(table_uid, row_idx, line): a row as 'row r: c0* "text" | c1 < | c2 ^', a cell's text where it begins, marked * if its
    tag is th, ^ and < where it goes on down or right. cells: table_uid, cell_id, row_idx, col_idx, text, tag (optional)."""
    tag = F.col("tag") if "tag" in cells.columns else F.lit(None).cast("string")
    at = slots.join(cells.select(TABLE, "cell_id", F.col("row_idx").alias("top"), F.col("col_idx").alias("side"), "text", tag.alias("tag")), [TABLE, "cell_id"])
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\\s+", " "))
    short = F.when(F.length(text) > MAX_CELL, F.concat(F.substring(text, 1, MAX_CELL), F.lit(" [...]"))).otherwise(text)
    begins = (F.col("row_idx") == F.col("top")) & (F.col("col_idx") == F.col("side"))
    down, right = F.col("row_idx") > F.col("top"), F.col("col_idx") > F.col("side")
    shown = F.when(begins, F.concat(F.lit('"'), F.replace(short, F.lit('"'), F.lit('\\"')), F.lit('"'))).when(down & right, "^<").when(down, "^").otherwise("<")
    mark = F.when(begins & (F.col("tag") == "th"), "* ").otherwise(" ")
    part = F.concat(F.lit("c"), F.col("col_idx").cast("string"), mark, shown)
    rows = at.groupBy(TABLE, "row_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("col_idx", part.alias("p")))), lambda s: s["p"]), " | ").alias("line"))
    return rows.withColumn("line", F.concat(F.lit("row "), F.col("row_idx").cast("string"), F.lit(": "), F.col("line")))


def context_line(name: str, value: Column) -> Column:
    """'Label: ...' and a line end, at most MAX_CONTEXT characters of the text; nothing for no text."""
    text = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), "\\s+", " "))
    short = F.when(F.length(text) > MAX_CONTEXT, F.concat(F.substring(text, 1, MAX_CONTEXT), F.lit(" [...]"))).otherwise(text)
    return F.when(text == "", "").otherwise(F.concat(F.lit(f"{name}: "), short, F.lit("\n")))


def parse_descriptions(candidates: DataFrame) -> DataFrame:
    """(table_uid, candidate_id, description) of candidates in words: their counts, or each subtable's rows, columns and
    counts and the rows set aside. candidates: as of layouts.table_candidates."""
    part = lambda s: F.concat(F.lit("a subtable of rows "), index_ranges(s["rows"]), F.lit(" and columns "), index_ranges(s["columns"]), F.format_string(" with H = %d, V = %d", s["hmd"], s["vmd"]))
    parts = candidates.select(TABLE, "candidate_id", F.posexplode("subtables").alias("k", "s")).select(TABLE, "candidate_id", F.struct("k", part(F.col("s")).alias("t")).alias("p"))
    said = parts.groupBy(TABLE, "candidate_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"]), "; ").alias("said"))
    rows = candidates.withColumn("aside", F.sort_array(F.array_distinct(F.transform("separators", lambda x: x["row_idx"])))).select(TABLE, "candidate_id", "kind", "hmd", "vmd", "aside", index_ranges(F.col("aside")).alias("ranges"))
    full = F.when(F.size("aside") == 0, F.concat("said", F.lit("."))).otherwise(F.concat("said", F.lit("; rows "), "ranges", F.lit(" are set aside as separators.")))
    return rows.join(said, [TABLE, "candidate_id"]).select(TABLE, "candidate_id", F.when(F.col("kind") == "layout", full).otherwise(F.format_string("H = %d, V = %d.", "hmd", "vmd")).alias("description"))


def table_blocks(lines: DataFrame, shapes: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(table_uid, block): a table's lines between BEGIN TABLE and END TABLE, after its label, caption and notes where a
    context (table_uid, label, caption, notes array<string>) has them."""
    body = lines.groupBy(TABLE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_idx", "line"))), lambda s: s["line"]), "\n").alias("body"))
    head = F.format_string("BEGIN TABLE (%d rows x %d columns)\n", "n_rows", "n_cols")
    at = body.join(shapes, TABLE)
    if context is None:
        return at.select(TABLE, F.concat(head, "body", F.lit("\nEND TABLE")).alias("block"))
    told = context.select(TABLE, F.concat(context_line("Label", F.col("label")), context_line("Caption", F.col("caption")), context_line("Notes", F.array_join("notes", " "))).alias("told"))
    return at.join(told, TABLE, "left").select(TABLE, F.concat(F.coalesce("told", F.lit("")), head, "body", F.lit("\nEND TABLE")).alias("block"))


def answer_fields(answer: Column, n_rows: Column, n_cols: Column) -> dict[str, Column]:
    """verdict (confirmed, counts or retry), hmd, vmd and reason of an answer in JSON.

    parse_correct is true or false or the text of either. Unless it is true, column_header_rows and
    row_header_columns give the counts: whole numbers, or the text of an integer, from 0 to the table's size. A
    reason of over 500 characters is cut and marked so.
    """
    read = F.try_parse_json(answer)
    get = lambda name, kind: F.try_variant_get(read, f"$.{name}", kind)
    is_text = lambda name: F.schema_of_variant(F.try_variant_get(read, f"$.{name}", "variant")) == "STRING"

    def count(name: str, most: Column) -> Column:
        text, number = get(name, "string"), get(name, "double")
        whole = F.when(is_text(name), F.when(text.rlike("^\\s*[+-]?[0-9]{1,9}\\s*$"), F.trim(text).cast("int"))).when(F.schema_of_variant(F.try_variant_get(read, f"$.{name}", "variant")) == "BOOLEAN", None).when(number == F.floor(number), number.cast("int"))
        return F.when((whole >= 0) & (whole <= most), whole)

    right = get("parse_correct", "string")
    truth = F.when(right.isin("true", "false"), right == "true")
    h, v = (F.when(~truth, count(n, most)) for n, most in (("column_header_rows", n_rows), ("row_header_columns", n_cols)))
    verdict = F.when(truth, "confirmed").when(h.isNotNull() & v.isNotNull(), "counts").otherwise("retry")
    reason = F.coalesce(F.when(is_text("reason"), get("reason", "string")), F.lit(""))
    usable = lambda x: F.when(verdict == "counts", x)
    return {"verdict": verdict, "hmd": usable(h), "vmd": usable(v), "reason": F.when(F.length(reason) > 500, F.concat(F.substring(reason, 1, 500), F.lit(" [...]"))).otherwise(reason)}


def reviewable_counts(candidates: DataFrame) -> DataFrame:
    """(table_uid, candidate_id, hmd, vmd): the counts that an answer must give to mean a candidate. A plain boundary
    has its own. A layout of one subtable is read from the table's top down to its last header row; one of several
    is never meant. candidates: kind, hmd, vmd, subtables array<struct<rows array<int>, hmd, vmd>>."""
    sub = F.try_element_at("subtables", F.lit(1))
    layout = F.col("kind") == "layout"
    h = F.when(sub["hmd"] == 0, 0).otherwise(F.try_element_at(sub["rows"], sub["hmd"]) + 1)
    meant = candidates.where(~layout | (F.size("subtables") == 1))
    return meant.select(TABLE, "candidate_id", F.when(F.col("kind") == "layout", h).otherwise(F.col("hmd")).alias("hmd"), F.when(F.col("kind") == "layout", sub["vmd"]).otherwise(F.col("vmd")).alias("vmd"))


def result_audit(results: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables with no result or several, and results for no table: table_uid, n_results, known."""
    n = results.groupBy(TABLE).agg(F.count("*").alias("n_results"))
    both = tables.select(TABLE).distinct().withColumn("known", F.lit(True)).join(n, TABLE, "full")
    return both.select(TABLE, F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("known", F.lit(False)).alias("known")).where("n_results <> 1 OR NOT known")


def segmentations(candidates: DataFrame, shapes: DataFrame) -> DataFrame:
    """(table_uid, candidate_id, segmentation): separator rows in order, and the rectangles of the subtables by first
    column, then first row. candidates as for reviewable_counts, with columns and the separators' rows too."""
    whole = F.array(F.struct(F.lit(0).alias("first_col"), F.lit(0).alias("first_row"), (F.col("n_rows") - 1).alias("last_row"), (F.col("n_cols") - 1).alias("last_col"), F.col("hmd").alias("head_rows"), F.col("vmd").alias("side_cols")))
    parts = F.array_sort(F.transform("subtables", lambda s: F.struct(F.array_min(s["columns"]).alias("first_col"), F.array_min(s["rows"]).alias("first_row"), F.array_max(s["rows"]).alias("last_row"), F.array_max(s["columns"]).alias("last_col"), s["hmd"].alias("head_rows"), s["vmd"].alias("side_cols"))))
    layout = F.col("kind") == "layout"
    rows = F.when(layout, F.sort_array(F.array_distinct(F.transform("separators", lambda s: s["row_idx"])))).otherwise(F.array().cast("array<int>"))
    at = candidates.join(shapes.select(TABLE, "n_rows", "n_cols"), TABLE)
    return at.select(TABLE, "candidate_id", F.struct(rows.alias("separator_rows"), F.when(layout, parts).otherwise(whole).alias("subtables")).alias("segmentation"))


def segmentation_verdicts(answers: DataFrame, known: DataFrame, free: bool = False) -> DataFrame:
    """(table_uid, final_status, candidate_id): valid with the candidate that an answer's segmentation equals, else
    unparseable; of a `free` arm every answer is valid, without a candidate. Both: table_uid, segmentation."""
    if free:
        return answers.select(TABLE, F.lit("valid").alias("final_status"), F.lit(None).cast("string").alias("candidate_id"))
    equal = known.groupBy(TABLE, F.to_json("segmentation").alias("as_json")).agg(F.min("candidate_id").alias("candidate_id"))
    found = answers.withColumn("as_json", F.to_json("segmentation")).join(equal, [TABLE, "as_json"], "left")
    return found.select(TABLE, F.when(F.col("candidate_id").isNotNull(), "valid").otherwise("unparseable").alias("final_status"), "candidate_id")


def decide(answers: DataFrame, candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """One result per answered table: valid with the proposed candidate if confirmed, valid with the candidate that
    has the answered counts, else unparseable; unreviewed if no answer was usable. answers: table_uid, verdict, hmd, vmd."""
    by_counts = candidates.select(TABLE, "hmd", "vmd", F.col("candidate_id").alias("matched"))
    found = answers.join(selected.select(TABLE, "selected_candidate_id"), TABLE, "left").join(by_counts, [TABLE, "hmd", "vmd"], "left")
    status = F.when(F.col("verdict") == "retry", "unreviewed").when((F.col("verdict") == "confirmed") & F.col("selected_candidate_id").isNotNull(), "valid").when((F.col("verdict") == "counts") & F.col("matched").isNotNull(), "valid").otherwise("unparseable")
    chosen = F.when(status == "valid", F.when(F.col("verdict") == "confirmed", F.col("selected_candidate_id")).otherwise(F.col("matched")))
    return found.select(TABLE, status.alias("final_status"), chosen.alias("candidate_id"))


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("pmc_id", "final_status").agg(F.count("*").alias("n"))


def nearest(targets: DataFrame, candidates: DataFrame, most: int = 3) -> DataFrame:
    """The candidates nearest to each given boundary, by steps, then in candidate order."""
    steps = F.abs(F.col("hmd") - F.col("at_hmd")) + F.abs(F.col("vmd") - F.col("at_vmd"))
    met = targets.select(TABLE, F.col("hmd").alias("at_hmd"), F.col("vmd").alias("at_vmd")).join(candidates, TABLE).withColumn("steps", steps)
    place = F.row_number().over(W.partitionBy(TABLE, "at_hmd", "at_vmd").orderBy("steps", "ord"))
    return met.withColumn("place", place).where(F.col("place") <= most).select(TABLE, "at_hmd", "at_vmd", "candidate_id", "steps", "place")


def segmentation_checks(rectangles: DataFrame, shapes: DataFrame) -> DataFrame:
    """Places that an answer's rectangles (table_uid, first_row, last_row, first_col, last_col) cover once, more than once, and not at all."""
    places = rectangles.select(TABLE, F.explode(F.sequence("first_row", "last_row")).alias("r"), "first_col", "last_col").select(TABLE, "r", F.explode(F.sequence("first_col", "last_col")).alias("c"))
    per = places.groupBy(TABLE, "r", "c").agg(F.count("*").alias("k")).groupBy(TABLE).agg(F.count_if(F.col("k") == 1).alias("once"), F.count_if(F.col("k") > 1).alias("overlapping"))
    return per.join(shapes.select(TABLE, (F.col("n_rows") * F.col("n_cols")).alias("places")), TABLE).select(TABLE, "once", "overlapping", (F.col("places") - F.col("once") - F.col("overlapping")).alias("uncovered"))
