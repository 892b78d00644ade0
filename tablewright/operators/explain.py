"""Why a boundary is not among a table's candidates: broken rules with their witnesses, in words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.functions.text import and_list, shortened
from tablewright.operators.geometry import RULE_ORDER, TABLE, separators, strip_separators
from tablewright.operators.repair import facts, witnesses
from tablewright.sources.shared import kept

#: Cells named in a message, cells listed with a violation, and characters shown of a text.
NAMED, LISTED, SHOWN, NEAREST = 3, 5, 30, 3

# Categories and wording of the published explanations.
CATEGORIES = {
    7: "no_headers_or_no_data", 8: "no_headers_or_no_data", 9: "header_row_required", 0: "boundary_cuts_merged_cell", 1: "boundary_cuts_merged_cell",
    2: "missing_hierarchy_evidence", 3: "missing_hierarchy_evidence", 4: "inverted_hierarchy", 5: "inverted_hierarchy", 6: "spanning_cell_in_last_header_row",
}
ALL_DATA = "With no header rows and no row-header columns the table would be all data, which the parser never proposes (rule 7)."
NO_DATA = "This leaves no data: %s (rule 8)."
EVERY_ROW, EVERY_COLUMN = "every row the parser keeps would be a header row", "every column would be a row-header column"
EVERY_BOTH = "every row the parser keeps would be a header row and every column a row-header column"
MESSAGES = {
    9: "With no header row the table may have no merged cell, but it has %s; the parser reads a merged cell as a sign of a header row (rule 9).",
    0: "The line between the row-header columns and the data, left of column %d, runs through %s (rule 0).",
    1: "The line below the last header row, row %d, runs through %s (rule 1).",
    2: "In header %s no cell right of the row headers spans columns that the next header row splits, so nothing shows that %s below (rule 2).%s",
    3: "In row-header %s no cell below the header spans rows that the next column splits, so nothing shows that %s to the right (rule 3).%s",
    4: "In the header, %s %s cells that the row above keeps apart (rule 4).",
    5: "In the row headers, %s %s cells that the column to its left keeps apart (rule 5).",
    6: "Row %d is the last header row, so each of its cells must label a single column, but %s %s several (rule 6).",
}
IT_HEADS, THEY_HEAD, IT_GROUPS, THEY_GROUP = "it heads the header row", "they head the header rows", "it groups the column", "they group the columns"
ONE_EMPTY, SOME_EMPTY = " One of the cells there is empty.", " %d of the cells there are empty."
OUTSIDE = "H = %d, V = %d does not fit a table of %d rows and %d columns."
OFFERED, NOT_OFFERED = "H = %d, V = %d is candidate %s.", "H = %d, V = %d is not a parser candidate. "
SET_ASIDE = "The parser sets aside %s (covered by a single cell), so it checks %d header row(s). "
ENDS_ASIDE = "The header ends on %s, which the parser sets aside because a single cell covers it; it reads the boundary as H = %d, V = %d%s."
WHICH_IS = ", which is candidate %s"
ONLY_TITLES = "Every row below the header is covered by a single cell across the data columns, so the parser sets them all aside and no data is left."
NO_RULE = "The boundary breaks no rule, but the parser does not offer it."


def indices(one: str, many: str, values: Column) -> Column:
    """'row 3' or 'rows 3, 5 and 6'."""
    texts = F.transform(values, lambda x: x.cast("string"))
    return F.when(F.size(values) == 1, F.concat(F.lit(f"{one} "), texts[0])).otherwise(F.concat(F.lit(f"{many} "), and_list(texts)))


def cell_phrase(cell: Column) -> Column:
    """'cell 12 "Gender" (row 2, columns 0-2)', or 'empty cell ...'."""
    span = lambda one, many, a, b: F.when(a == b, F.concat(F.lit(f"{one} "), a.cast("string"))).otherwise(F.concat(F.lit(f"{many} "), a.cast("string"), F.lit("-"), b.cast("string")))
    where = F.concat(F.lit(" ("), span("row", "rows", cell["first_row"], cell["last_row"]), F.lit(", "), span("column", "columns", cell["first_col"], cell["last_col"]), F.lit(")"))
    return F.when(cell["empty"], F.concat(F.lit("empty cell "), cell["cell_id"].cast("string"), where)).otherwise(F.concat(F.lit("cell "), cell["cell_id"].cast("string"), F.lit(' "'), cell["text"], F.lit('"'), where))


def violations(slots: DataFrame, cells: DataFrame, targets: DataFrame) -> DataFrame:
    """The rules that boundaries inside their tables break, once the rows that one cell covers are set aside: table_uid,
    hmd, vmd, place (from 1, in the order of reporting), rule, category, count of the witness cells, cells (the first
    five: cell_id, text, empty, first and last row and column), rows, columns (of the table) and message.

    The witnesses of rules 2 and 3 are the header rows and columns without evidence; their cells are the empty ones
    there. One row for each boundary and broken rule; cells are looked up by one join.
    """
    rest = strip_separators(slots)
    rows = rest.select(TABLE, "source_row").distinct().groupBy(TABLE).agg(F.sort_array(F.collect_list("source_row")).alias("kept"))
    asked = targets.select(TABLE, "hmd", "vmd").distinct().join(rows, TABLE).withColumn("kept_hmd", F.size(F.filter("kept", lambda x: x < F.col("hmd"))))
    found = witnesses(rest.drop("source_row"), asked.select(TABLE, F.col("kept_hmd").alias("hmd"), "vmd")).withColumnRenamed("hmd", "kept_hmd")
    at = kept(asked.join(found, [TABLE, "kept_hmd", "vmd"]))
    none = F.array().cast("array<int>")
    kinds = {7: (F.col("no_header"), none), 8: (F.col("no_rows") | F.col("no_columns"), none), 2: (F.size("rows_2") > 0, none), 3: (F.size("columns_3") > 0, none)}
    kinds |= {n: (F.size(f"cells_{n}") > 0, F.col(f"cells_{n}")) for n in (9, 0, 1, 4, 5, 6)}
    tests = F.array(*[F.when(kinds[n][0], F.struct(F.lit(k).alias("order"), F.lit(n).alias("rule"), kinds[n][1].alias("ids"))) for k, n in enumerate(RULE_ORDER)])
    broken = at.select("*", F.explode(F.array_compact(tests)).alias("b")).select("*", "b.*").drop("b")
    key = [TABLE, "hmd", "vmd", "rule"]

    told = facts(slots, cells).select(TABLE, "cell_id", shortened(F.col("text"), SHOWN).alias("text"), "empty", "first_row", "last_row", "first_col", "last_col")
    by_cell = broken.select(*key, F.posexplode("ids").alias("pos", "cell_id"))
    # the empty cells in rows (columns) without evidence, in order of rows (columns), each where it is met first
    spots = rest.join(facts(slots, cells).where("empty").select(TABLE, "cell_id"), [TABLE, "cell_id"])
    met = broken.where("rule IN (2, 3)").select(*key, "kept_hmd", "rows_2", "columns_3").join(spots, TABLE)
    in_rows = (F.col("rule") == 2) & F.array_contains("rows_2", F.col("row_idx")) & (F.col("col_idx") >= F.col("vmd"))
    in_columns = (F.col("rule") == 3) & F.array_contains("columns_3", F.col("col_idx")) & (F.col("row_idx") >= F.col("kept_hmd"))
    place = F.when(F.col("rule") == 2, F.struct(F.col("row_idx").alias("a"), F.col("col_idx").alias("b"))).otherwise(F.struct(F.col("col_idx").alias("a"), F.col("row_idx").alias("b")))
    first = met.where(in_rows | in_columns).groupBy(*key, "cell_id").agg(F.min(place).alias("at"))
    empties = first.select(*key, (F.row_number().over(W.partitionBy(*key).orderBy("at")) - 1).cast("int").alias("pos"), "cell_id")
    named = by_cell.unionByName(empties).join(told, [TABLE, "cell_id"])
    listed = F.array_sort(F.collect_list(F.when(F.col("pos") < LISTED, F.struct("pos", "cell_id", "text", "empty", "first_row", "last_row", "first_col", "last_col"))))
    per = named.groupBy(*key).agg(F.count("*").cast("int").alias("count"), listed.alias("cells"))
    full = broken.join(per, key, "left").withColumn("count", F.coalesce("count", F.lit(0)))

    n, v, last = F.col("count"), F.col("vmd"), F.element_at("kept", F.greatest(F.col("kept_hmd"), F.lit(1)))
    shown = F.transform(F.slice(F.coalesce("cells", F.array().cast("array<struct<pos:int,cell_id:int,text:string,empty:boolean,first_row:int,last_row:int,first_col:int,last_col:int>>")), 1, NAMED), cell_phrase)
    phrase = and_list(F.when(n > NAMED, F.concat(shown, F.array(F.concat((n - NAMED).cast("string"), F.lit(" more"))))).otherwise(shown))
    verb = F.when(n == 1, "spans").otherwise("span")
    table_rows = F.transform("rows_2", lambda i: F.get("kept", i))
    empty = F.when(n == 0, "").when(n == 1, ONE_EMPTY).otherwise(F.format_string(SOME_EMPTY, n))
    say = lambda k, *args: F.format_string(MESSAGES[k], *args)
    rule = F.col("rule")
    left = F.when(F.col("no_rows") & F.col("no_columns"), EVERY_BOTH).when(F.col("no_rows"), EVERY_ROW).otherwise(EVERY_COLUMN)
    message = (
        F.when(rule == 7, ALL_DATA).when(rule == 8, F.format_string(NO_DATA, left)).when(rule == 9, say(9, phrase)).when(rule == 0, say(0, v, phrase)).when(rule == 1, say(1, last, phrase))
        .when(rule == 2, say(2, indices("row", "rows", table_rows), F.when(F.size("rows_2") == 1, IT_HEADS).otherwise(THEY_HEAD), empty))
        .when(rule == 3, say(3, indices("column", "columns", F.col("columns_3")), F.when(F.size("columns_3") == 1, IT_GROUPS).otherwise(THEY_GROUP), empty))
        .when(rule == 4, say(4, phrase, verb)).when(rule == 5, say(5, phrase, verb)).otherwise(say(6, last, phrase, verb))
    )
    category = F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), rule)
    none_ = F.array().cast("array<int>")
    return full.select(
        TABLE, "hmd", "vmd", F.row_number().over(W.partitionBy(TABLE, "hmd", "vmd").orderBy("order")).alias("place"), "rule", category.alias("category"), "count", F.transform("cells", lambda c: c.dropFields("pos")).alias("cells"),
        F.when(rule == 2, table_rows).otherwise(none_).alias("rows"), F.when(rule == 3, F.col("columns_3")).otherwise(none_).alias("columns"), message.alias("message"),
    )


def explain(slots: DataFrame, cells: DataFrame, targets: DataFrame, candidates: DataFrame) -> DataFrame:
    """An explanation of each boundary (table_uid, hmd, vmd): category (of the first broken rule, offered, not_offered or
    out_of_range), categories (each once, in order), summary, violations (as of violations(), in order), set_aside rows,
    kept_hmd (the header rows that are left once rows are set aside, null out of range) and nearest, up to three
    candidates by steps, then their order. candidates: table_uid, candidate_id, ord and the counts hmd and vmd that mean
    them. A target with a null count is left out; see explained_counts for how many."""
    key = [TABLE, "hmd", "vmd"]
    asked = targets.where("hmd IS NOT NULL AND vmd IS NOT NULL").select(*key).distinct()
    size = slots.groupBy(TABLE).agg((F.max("row_idx") + 1).alias("n_rows"), (F.max("col_idx") + 1).alias("n_cols"), F.sort_array(F.collect_set("row_idx")).alias("every"))
    aside = separators(slots).groupBy(TABLE).agg(F.sort_array(F.collect_list("row_idx")).alias("set_aside"))
    ints = "array<int>"
    sized = asked.join(size, TABLE).join(aside, TABLE, "left").withColumn("set_aside", F.coalesce("set_aside", F.array().cast(ints)))
    inside = F.col("hmd").between(0, F.col("n_rows")) & F.col("vmd").between(0, F.col("n_cols"))
    heads = F.filter(F.array_except("every", "set_aside"), lambda r: r < F.col("hmd"))
    sized = sized.withColumn("inside", inside).withColumn("kept_hmd", F.when(inside, F.size(heads))).withColumn("read_hmd", F.when(inside, F.coalesce(F.array_max(heads) + 1, F.lit(0))))

    same = candidates.groupBy(*key).agg(F.min_by("candidate_id", "ord").alias("offered"))
    reading = same.select(TABLE, F.col("hmd").alias("read_hmd"), "vmd", F.col("offered").alias("read_as"))
    near = asked.select(TABLE, F.col("hmd").alias("h"), F.col("vmd").alias("v")).join(candidates.select(TABLE, "candidate_id", "ord", "hmd", "vmd"), TABLE)
    near = near.withColumn("steps", F.abs(F.col("hmd") - F.col("h")) + F.abs(F.col("vmd") - F.col("v")))
    near = near.withColumn("k", F.row_number().over(W.partitionBy(TABLE, "h", "v").orderBy("steps", "ord"))).where(F.col("k") <= NEAREST)
    near = near.groupBy(TABLE, F.col("h").alias("hmd"), F.col("v").alias("vmd")).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "candidate_id", F.col("hmd").alias("hmd"), F.col("vmd").alias("vmd")))), lambda s: s.dropFields("k")).alias("nearest"))

    known = kept(sized.join(same, key, "left").join(reading, [TABLE, "read_hmd", "vmd"], "left").join(near, key, "left"))
    open_ = known.where("inside AND offered IS NULL")
    found = kept(violations(slots, cells, open_))
    fields = ("place", "rule", "category", "count", "cells", "rows", "columns", "message")
    gathered = found.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*fields))), lambda s: s.dropFields("place")).alias("violations"))
    data = open_.join(slots, TABLE).where("row_idx >= read_hmd AND col_idx >= vmd AND NOT array_contains(set_aside, row_idx)").groupBy(*key, "row_idx").agg(F.countDistinct("cell_id").alias("ids"), F.count("*").alias("places"))
    titles = data.groupBy(*key).agg(F.bool_and((F.col("ids") == 1) & (F.col("places") > 1)).alias("titles"), F.sort_array(F.collect_list(F.when((F.col("ids") == 1) & (F.col("places") > 1), F.col("row_idx")))).alias("title_rows"))
    out = known.join(gathered, key, "left").join(titles, key, "left")

    h, v = F.col("hmd"), F.col("vmd")
    span = F.when(F.col("read_hmd") < h, F.sequence("read_hmd", h - 1)).otherwise(F.array().cast(ints))
    which = F.when(F.col("read_as").isNull(), "").otherwise(F.format_string(WHICH_IS, "read_as"))
    apart = F.col("read_hmd") != h
    silent = F.when(apart, F.format_string(ENDS_ASIDE, indices("row", "rows", span), "read_hmd", "vmd", which)).when(F.coalesce("titles", F.lit(True)), ONLY_TITLES).otherwise(NO_RULE)
    kind = found.select(F.array(F.struct(*[F.col(x) for x in fields[1:]])).alias("v")).schema["v"].dataType
    lone = F.array(F.struct(F.lit(None).cast("int").alias("rule"), F.lit("not_offered").alias("category"), F.lit(0).alias("count"), F.array().alias("cells"), F.when(apart, span).otherwise(F.coalesce("title_rows", F.array().cast(ints))).alias("rows"), F.array().cast(ints).alias("columns"), silent.alias("message"))).cast(kind)
    listed = F.when(~F.col("inside") | F.col("offered").isNotNull(), F.array().cast(kind)).otherwise(F.coalesce("violations", lone))
    out = out.withColumn("violations", listed)
    categories = F.when(~F.col("inside"), F.array(F.lit("out_of_range"))).when(F.col("offered").isNotNull(), F.array(F.lit("offered"))).otherwise(F.array_distinct(F.transform("violations", lambda x: x["category"])))
    before = F.filter("set_aside", lambda r: r < h)
    note = F.when(F.size(before) == 0, "").otherwise(F.format_string(SET_ASIDE, indices("row", "rows", before), "kept_hmd"))
    summary = (
        F.when(~F.col("inside"), F.format_string(OUTSIDE, "hmd", "vmd", "n_rows", "n_cols")).when(F.col("offered").isNotNull(), F.format_string(OFFERED, "hmd", "vmd", "offered"))
        .otherwise(F.concat(F.format_string(NOT_OFFERED, "hmd", "vmd"), note, F.array_join(F.transform("violations", lambda x: x["message"]), " ")))
    )
    return out.select(
        *key, categories[0].alias("category"), categories.alias("categories"), summary.alias("summary"), "violations", F.when(F.col("inside"), F.col("set_aside")).otherwise(F.array().cast(ints)).alias("set_aside"), "kept_hmd",
        F.coalesce("nearest", F.array().cast("array<struct<candidate_id:string,hmd:int,vmd:int>>")).alias("nearest"),
    )


def explained_counts(explained: DataFrame, targets: DataFrame, repaired: DataFrame) -> DataFrame:
    """What a run comes to: (what, value, status, n): explained and excluded targets (those with a null count); tables by
    category; tables breaking each rule; and tables by category and repair status (repaired: table_uid, hmd, vmd, status)."""
    row = lambda d, what, value, status: d.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), value.alias("value"), status.alias("status"), "n")
    none = F.lit(None).cast("string")
    missing = targets.where("hmd IS NULL OR vmd IS NULL").groupBy()
    rules = explained.select(TABLE, F.explode("violations.rule").alias("rule")).where("rule IS NOT NULL").distinct()
    both = explained.join(repaired.select(TABLE, "hmd", "vmd", "status"), [TABLE, "hmd", "vmd"])
    return (
        row(explained.groupBy(), "explained", none, none).unionByName(row(missing, "excluded", none, none)).unionByName(row(explained.groupBy("category"), "category", F.col("category"), none))
        .unionByName(row(rules.groupBy("rule"), "rule", F.col("rule").cast("string"), none)).unionByName(row(both.groupBy("category", "status"), "repair", F.col("category"), F.col("status")))
    )
